"""Token counts of a byte-level BPE vocabulary, by finite-state transducers.

Two machines, compiled once on the driver and sent to the workers. The outer one cuts a text into pretokens; it needs a character, its
two neighbours and the two after an apostrophe, so that it is evaluated for all places of a piece at once. The inner one reads
the bytes of a pretoken and emits tokens: a transition holds the change of the number of tokens, and states are made when first
reached. A long text is cut into chunks. A chunk's map takes the state before it to a count and the state after it. A state of
both machines is given by the text since the last place where a pretoken starts whatever came before; so a map keeps what stands
before its first such place, the count between, and what stands after the last one. Maps compose associatively and are
folded by a prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import pieces, prefix, ranges, raw

LIMIT = 512
#: Characters of a chunk of a long text.
CHUNK = 1 << 20
#: States of the inner machine, and pretokens with known counts, that a worker keeps at most before it starts afresh.
MOST_STATES, MOST_KNOWN = 300_000, 3_000_000
SPACE, BLANK, LETTER, NUMBER, OTHER, EDGE = 0, 1, 2, 3, 4, 9


def character_classes() -> np.ndarray:
    """Class of every code point, by Unicode property."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, everything):
            out[[ord(c) for c in m[0]]] = kind
    out[32] = SPACE
    return out


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The inner machine: bytes of a pretoken -> number of tokens.

    The tokens of a text under the merges are the one sequence whose neighbours all survive merging as a pair. So the last
    token of a prefix is the one suffix of it that is a token and whose neighbour is the last token of what is before. A
    state holds, for every place from which a longer token may still come, the trie node reached, the last token before
    that place and how many tokens fewer were emitted there.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or spec.get("normalizer"):
            raise ValueError("added tokens that take white space or whole words, and normalizers, are not supported")
        cutter = spec.get("pre_tokenizer") or {}
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError(f"only pretokens of the byte-level pattern without a leading space are supported, not {cutter}")
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte pair merges are supported")
        alphabet = byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = lambda s: bytes(alphabet[c] for c in s)
        self.rank = {(code(a), code(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        #: node * 256 + byte -> node of the trie of tokens, whether a node has any further one, and its token
        self.trie: dict[int, int] = {}
        self.more, self.token = bytearray(1), [None]
        for t in tokens:
            at = 0
            for b in t:
                to = self.trie.get(at << 8 | b)
                if to is None:
                    self.trie[at << 8 | b] = to = len(self.token)
                    self.more[at] = 1
                    self.more.append(0)
                    self.token.append(None)
                at = to
            self.token[at] = t
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids = {((0, b"", 0),): 0}
        self.states = [((0, b"", 0),)]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, text: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = self.merge(a + b) == [a, b]
        return self.pairs[a, b]

    def move(self, state: int, byte: int) -> tuple[int, int]:
        alive, last, change = [], None, 0
        for node, before, fewer in self.states[state]:
            to = self.trie.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if last is None and token is not None and self.stays(before, token):
                last, change = token, fewer + 1
            if self.more[to]:
                alive.append((to, before, fewer))
        key = (*((n, b, f - change) for n, b, f in alive), (0, last, 0))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = out = (self.ids[key], change)
        return out

    def count(self, pretoken: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.clear()
        state, total, moves = 0, 0, self.moves
        for byte in pretoken:
            step = moves[state].get(byte) or self.move(state, byte)
            state = step[0]
            total += step[1]
        return total


class Counter:
    """Both machines, and the counts of pretokens seen."""

    def __init__(self, path: str):
        self.inner = Transducer(path)
        self.classes = character_classes()
        self.known: dict[bytes, int] = {}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.inner.special, key=len, reverse=True)) or "(?!)")

    def starts(self, chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether a pretoken starts at each character; ``edges`` are places where texts start."""
        n = len(chars)
        kind = self.classes[chars]
        before, after = np.full(n, EDGE, np.uint8), np.full(n, EDGE, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        inner = edges[(edges > 0) & (edges < n)]
        before[inner], after[inner - 1] = EDGE, EDGE
        blank, blank_before = kind <= BLANK, before <= BLANK
        out = np.where(blank, ~blank_before | (after > BLANK) & (after != EDGE), np.where(blank_before, before == BLANK, kind != before))
        out |= before == EDGE
        at = np.flatnonzero((chars == 39) & out & (after == LETTER))
        if len(at):
            ends = np.append(inner, n)
            end = ends[np.searchsorted(ends, at, side="right")]
            one = chars[at + 1]
            two = np.where(at + 2 < end, chars[np.minimum(at + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            size = np.where(short, 2, np.where(long, 3, 0))
            at, size, end = at[size > 0], size[size > 0], end[size > 0]
            out[at + 1] = False
            nxt = at + size
            out[nxt[nxt < end]] = True
        return out

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Counts of the pretokens; equal ones are looked up once, and new ones go through the inner machine."""
        keys = ranges(prefix(data), start, end)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        alike = first[back]
        # hashes only group: every byte is compared with that of the first of the group
        same = (end - start) == (end - start)[alike]
        place = np.arange(len(data)) + np.repeat(start[alike] - start, end - start)
        differ = data != data[np.minimum(place, len(data) - 1)]
        same &= ~np.logical_or.reduceat(differ, start)
        whole, known = data.tobytes(), self.known
        if len(known) > MOST_KNOWN:
            known.clear()

        def number(i: int) -> int:
            pretoken = whole[start[i] : end[i]]
            got = known.get(pretoken)
            if got is None:
                known[pretoken] = got = self.inner.count(pretoken)
            return got

        out = np.array([number(i) for i in first.tolist()], np.int64)[back]
        for i in np.flatnonzero(~same).tolist():
            out[i] = number(i)
        return out

    def count(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text, without special tokens."""
        if not len(data):
            return np.zeros(len(offs) - 1, np.int64)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000), out=place[1:])
        start = place[np.flatnonzero(self.starts(chars, np.searchsorted(place, offs)))]
        end = np.append(start[1:], len(data))
        number = self.lookup(data, start, end)
        total = np.concatenate([[0], np.cumsum(number)])
        cut = np.searchsorted(start, offs)
        return total[cut[1:]] - total[cut[:-1]]

    def plain(self, text: str) -> int:
        data = np.frombuffer(text.encode(), np.uint8)
        return int(self.count(data, np.array([0, len(data)]))[0])

    def state_map(self, chunk: str) -> StateMap:
        """A chunk's map: a blank after another character starts a pretoken whatever came before."""
        chars = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
        blank = self.classes[chars] <= BLANK
        sure = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        if not len(sure):
            return StateMap(chunk, None, "")
        a, b = int(sure[0]), int(sure[-1])
        return StateMap(chunk[:a], self.plain(chunk[a:b]), chunk[b:])

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        if y.count is None:
            return StateMap(x.head + y.head, None, "") if x.count is None else StateMap(x.head, x.count, x.tail + y.head)
        if x.count is None:
            return StateMap(x.head + y.head, y.count, y.tail)
        return StateMap(x.head, x.count + self.plain(x.tail + y.head) + y.count, y.tail)

    def long(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text by chunks: neighbouring maps are composed in rounds, as in a parallel scan."""
        maps = [self.state_map(text[a : a + chunk]) for a in range(0, len(text), chunk)] or [StateMap("", None, "")]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return self.plain(m.head) + (0 if m.count is None else m.count + self.plain(m.tail))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each row. A special string in a text is one token and parts the text, as by default in the library."""
        data, offs = raw(column, lower=False, stop=None)
        size = np.diff(offs)
        out = np.zeros(len(size), np.int64)
        whole = data.tobytes()
        odd = size > CHUNK
        for s in self.inner.special:
            mark, at = s.encode(), whole.find(s.encode())
            while at >= 0:
                r = int(np.searchsorted(offs, at, side="right")) - 1
                if at + len(mark) <= offs[r + 1]:
                    odd[r] = True
                at = whole.find(mark, at + 1)
        if not odd.any():
            return size, self.count(data, offs)
        plain = [b"" if odd[r] else whole[offs[r] : offs[r + 1]] for r in range(len(size))]
        out = self.count(np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in plain])]))
        for r in np.flatnonzero(odd):
            parts = self.cut.split(whole[offs[r] : offs[r + 1]].decode())  # at the leftmost, of those the longest
            out[r] = len(parts) - 1 + sum(self.long(p) for p in parts if p)
        return size, out


@dataclass
class StateMap:
    head: str
    count: int | None
    tail: str


def _count_batches(batches: Iterator[pa.RecordBatch], counter: Counter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in pieces(batch.column(1), 1 << 20):
            part = batch.slice(a, b - a)
            size, tokens = counter.texts(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text) under the vocabulary file at ``path``.

    The count is that of the tokenizers library for a byte-level BPE file, without added special tokens. Null and empty
    texts have 0 of both; doc_id may be null or repeated; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    machines = docs.sparkSession.sparkContext.broadcast(Counter(path))  # a few MB for a vocabulary; a worker unpacks it once and serves many tasks
    counted = rows.mapInArrow(lambda it: _count_batches(it, machines.value), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
