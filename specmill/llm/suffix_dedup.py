"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

The suffixes are sampled without loss: of every 100-byte window one anchor is taken, the leftmost place where a 20-byte string of
least hash starts. Equal windows have equal anchors at equal offsets, so only suffixes at anchors need an index. An entry of a suffix
array is the suffix at an anchor, as far as windows with this anchor reach, and what stands before it in them. A batch of texts
is sorted into one array for each range of the hash of the first 20 bytes. The arrays of a range meet in one task, where the
family is kept: a new array is merged with levels of its size, geometrically, and in the order of bytes equal neighbours show.
At the end common prefixes of neighbours give the windows that entries share though they differ elsewhere. All strings
are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deltas, pack, undeltas, unpack
from .shared import Scratch
from .textkernel import PART, U, _RI, mix, pieces, powers, prefix, raw

WINDOW, GRAM = 100, 20
BEFORE = WINDOW - GRAM
#: Bytes of a key: the suffix, the bytes before it from right to left, and the lengths of both plus one; what is too short ends in zeros.
KEY = WINDOW + BEFORE + 2
#: Text bytes of one batch of the index, and of the texts that one range of hashes is made for.
BATCH_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
_LAST = np.int64(2**63 - 1)
COLUMNS = "bucket int, kind int, block binary"
#: Spans that a task holds before it sends them on.
HELD = 400_000


class Entries:
    """Entries of a suffix array: key (rows of KEY bytes), d, t (document), pos (start of the first window)."""

    def __init__(self, key, d, t, pos):
        self.c = (key, d, t, pos)

    def __len__(self) -> int:
        return len(self.c[0])

    def take(self, at) -> Entries:
        return Entries(*(x[at] for x in self.c))

    def before(self) -> np.ndarray:
        """Bytes before the anchor in the first window."""
        return self.c[0][:, -1].astype(np.int64) - 1

    def windows(self) -> np.ndarray:
        """Number of windows: the suffix of the last one starts so many bytes nearer to the anchor."""
        return self.before() - (WINDOW - (self.c[0][:, -2].astype(np.int64) - 1)) + 1

    def order(self) -> np.ndarray:
        """The order of the suffixes' bytes, then of those before. Runs that are in order already merge in linear time."""
        return np.argsort(np.ascontiguousarray(self.c[0]).view(f"S{KEY}").ravel(), kind="stable")

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate(x) for x in zip(*(p.c for p in parts), strict=True)))


EMPTY = Entries(np.zeros((0, KEY), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def scan(e: Entries) -> tuple[Entries, Entries]:
    """Sorts; of entries with equal keys the earliest stays, the others are returned as repeated."""
    e = e.take(e.order())
    key = e.c[0]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[1:] == key[:-1]).all(1)
    runs = np.flatnonzero(same[1:] | same[:-1])
    if not len(runs):
        return e, EMPTY
    run = np.cumsum(~same[runs])
    _, d, t, pos = (x[runs] for x in e.c)
    order = np.lexsort((pos, t, d, run))
    d, t, pos, run = d[order], t[order], pos[order], run[order]
    again = np.zeros(len(runs), bool)
    again[1:] = run[1:] == run[:-1]
    # rows with equal doc_id and text are one document: the same place twice is no repetition
    place = np.zeros(len(runs), bool)
    place[1:] = again[1:] & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (pos[1:] == pos[:-1])
    for column, x in zip(e.c[1:], (d, t, pos), strict=True):
        column[runs] = x
    keep, found = np.ones(len(e), bool), np.zeros(len(e), bool)
    keep[runs[again]] = False
    found[runs[again & ~place]] = True
    return e.take(keep), e.take(found)


class Family:
    """Levels of geometrically growing size; ``add`` merges a batch with levels up to its size and returns what repeats."""

    def __init__(self) -> None:
        self.levels: list[Entries] = []

    def add(self, batch: Entries) -> Entries:
        batch, found = scan(batch)
        out = [found]
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch, found = scan(Entries.join([self.levels.pop(), batch]))
            out.append(found)
        self.levels.append(batch)
        return Entries.join(out)

    def close(self) -> tuple[Entries, Entries]:
        """The one level left, and what repeats between levels."""
        if not self.levels:
            return EMPTY, EMPTY
        out, batch = [EMPTY], self.levels.pop()
        while self.levels:
            batch, found = scan(Entries.join([self.levels.pop(), batch]))
            out.append(found)
        return batch, Entries.join(out)


def shared_windows(e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first window, windows): runs of windows of the sorted, different entries that stand earlier in another entry.

    Entries that share a window with so many bytes before the anchor follow one another, and share the suffix as far as the window
    reaches: the least common prefix of neighbours tells. Of those, the ones with the same bytes before the anchor share it.
    """
    key = e.c[0]
    none = np.zeros(0, np.int64)
    if len(e) < 2:
        return none, none, none
    differ = key[1:, :WINDOW] != key[:-1, :WINDOW]
    common = np.where(differ.any(1), differ.argmax(1), WINDOW)
    near = np.zeros(len(e) + 1, bool)
    near[1:-1] = common >= GRAM
    sub = np.flatnonzero(near[1:] | near[:-1])
    if not len(sub):
        return none, none, none
    # of neighbours in ``sub`` the common prefix is that of neighbours in ``e`` where they are, and less than GRAM elsewhere
    common = np.where(np.diff(sub) == 1, common[sub[:-1]], 0)
    s = e.take(sub)
    most = s.before()
    least = most - s.windows() + 1
    left, anchor = s.c[0][:, WINDOW : WINDOW + BEFORE], s.c[3].astype(np.int64) + most
    again = np.zeros((len(s), BEFORE + 1), bool)
    h = np.zeros(len(s), np.uint64)
    for n in range(BEFORE + 1):  # windows with n bytes before the anchor
        if n:
            h = (h + left[:, n - 1] + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        run = np.concatenate([[0], np.cumsum(common < WINDOW - n)])
        at = np.flatnonzero((least <= n) & (n <= most))
        order = at[np.lexsort((anchor[at], s.c[2][at], s.c[1][at], h[at], run[at]))]
        a, b = order[:-1], order[1:]
        same = (run[a] == run[b]) & (h[a] == h[b])
        same[same] = (left[a[same], :n] == left[b[same], :n]).all(1)
        again[b[same], n] = True
    change = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, first = np.nonzero(change == 1)
    _, after = np.nonzero(change == -1)
    # more bytes before the anchor are an earlier window
    return sub[entry], most[entry] - (after - 1), after - first


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the 20-byte string at, key, row and first window within the row, for each anchor."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint64), EMPTY.c[0], np.zeros(0, np.int64), EMPTY.c[3]
    h = prefix(data)
    inv = powers(_RI, n + 1)
    g = mix((h[GRAM:] - h[:-GRAM]) * inv[: n + 1 - GRAM])
    low = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, s = WINDOW - GRAM + 1, 1
    while s * 2 <= span:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    m = n - WINDOW + 1
    low = np.minimum(low[:m], low[span - s : span - s + m])
    # windows that cross the end of a row do not count
    inside = np.ones(m, bool)
    for end in offs[1:-1]:
        inside[max(0, end - WINDOW + 1) : end] = False
    anchor = (low & U(0xFFFFFFFF)).astype(np.int64)
    anchor[~inside] = -1
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.concatenate([head[1:], [m]])
    good = anchor[head] >= 0
    head, end = head[good], end[good]
    at = anchor[head]
    k = mix(g[at] + U(1))  # mixed again: hashes that are least of many are small, and k is cut into ranges
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + WINDOW)[at]
    after, before = end - 1 + WINDOW - at, at - head
    key = np.empty((len(at), KEY), np.uint8)
    key[:, :WINDOW] = view[:, BEFORE:] * (np.arange(WINDOW) < after[:, None])
    key[:, WINDOW:-2] = view[:, BEFORE - 1 :: -1] * (np.arange(BEFORE) < before[:, None])
    key[:, -2], key[:, -1] = after + 1, before + 1
    row = np.searchsorted(offs, head, side="right") - 1
    return k, key, row, (head - offs[row]).astype(np.uint32)


def _documents_of(d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different documents, and the number of each entry's."""
    order = np.lexsort((t, d))
    head = np.ones(len(d), bool)
    head[1:] = (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1])
    number = np.empty(len(d), np.uint32)
    number[order] = np.cumsum(head) - 1
    return d[order][head], t[order][head], number


def _out(k: np.ndarray, e: Entries, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch by range of k: kind 1 its sorted entries, kind 0 what repeats within the batch."""
    part = (((k >> U(32)) * U(parts)) >> U(32)).astype(np.int32)
    rows: list[tuple[int, int, bytes]] = []
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        kept, found = scan(e.take(order[cut[p] : cut[p + 1]]))
        key, d, t, pos = kept.c
        body = key[:, :-2]
        there = np.concatenate([np.arange(WINDOW) < key[:, -2:-1].astype(np.int64) - 1, np.arange(BEFORE) < key[:, -1:].astype(np.int64) - 1], axis=1)
        rows.append((p, 1, pack(body[there], key[:, -2].copy(), key[:, -1].copy(), *_documents_of(d, t), pos, level=5)))
        if len(found):
            rows.append((p, 0, pack(*_documents_of(*found.c[1:3]), found.c[3], found.windows().astype(np.uint32))))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "kind", "block"])


def _in(block: bytes) -> Entries:
    body, after, before, d, t, number, pos = unpack(block)
    key = np.zeros((len(pos), KEY), np.uint8)
    there = np.concatenate([np.arange(WINDOW) < after[:, None].astype(np.int64) - 1, np.arange(BEFORE) < before[:, None].astype(np.int64) - 1], axis=1)
    key[:, :-2][there] = body
    key[:, -2], key[:, -1] = after, before
    return Entries(key, d[number], t[number], pos)


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(_LAST)).to_numpy(zero_copy_only=False)


def anchor_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> (part, kind, block)"""
    have: list[tuple[np.ndarray, Entries]] = []
    size = 0
    for batch in batches:
        d, t = _doc_ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in pieces(batch.column(2)):
            data, offs = raw(batch.column(2).slice(a, b - a), lower=False, stop=None)
            step = PART if b - a == 1 else len(data) + 1
            for at in range(0, len(data), step):  # a long text in parts, each with its windows whole
                part = data[at : at + step + WINDOW - 1]
                k, key, row, pos = anchors(part, offs if b - a > 1 else np.array([0, len(part)]))
                have.append((k, Entries(key, d[a + row], t[a + row], (pos + np.uint32(at)).astype(np.uint32))))
                size += min(step, len(data) - at)
                if size >= BATCH_BYTES:
                    yield from _out(np.concatenate([x for x, _ in have]), Entries.join([x for _, x in have]), parts)
                    have, size = [], 0
    if have:
        yield from _out(np.concatenate([x for x, _ in have]), Entries.join([x for _, x in have]), parts)


class Spans:
    """Spans of documents on their way, as starts and lengths: packed by bucket of the document."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def put(self, d: np.ndarray, t: np.ndarray, pos: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((d, t, pos.astype(np.uint32), (windows + (WINDOW - 1)).astype(np.uint32)))
        self.size += len(d)
        if self.size > HELD:
            yield self.sent()

    def sent(self) -> pa.RecordBatch:
        rows: list[tuple[int, int, bytes]] = []
        if self.size:
            d, t, pos, ln = (np.concatenate(x) for x in zip(*self.held, strict=True))
            bucket = np.mod(d ^ t, self.buckets)
            order = np.lexsort((pos, t, d, bucket))
            cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                at = order[cut[k] : cut[k + 1]]
                rows.append((k, 0, pack(deltas(d[at]), deltas(t[at]), pos[at], ln[at])))
        self.held, self.size = [], 0
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["bucket", "kind", "block"])


def family_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(part, kind, block), sorted by part -> spans of documents."""
    family, at, spans = Family(), None, Spans(buckets)

    def put(e: Entries) -> Iterator[pa.RecordBatch]:
        if len(e):
            yield from spans.put(*e.c[1:], e.windows())

    def ended() -> Iterator[pa.RecordBatch]:
        left, found = family.close()
        yield from put(found)
        entry, first, number = shared_windows(left)
        if len(entry):
            _, d, t, pos = left.c
            yield from spans.put(d[entry], t[entry], pos[entry] + first, number)

    for batch in batches:
        for part, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if at is not None and part != at:
                yield from ended()
                family = Family()
            at = part
            if kind:
                yield from put(family.add(_in(block.as_py())))
            else:
                d, t, number, pos, windows = unpack(block.as_py())
                yield from spans.put(d[number], t[number], pos, windows)
    yield from ended()
    yield spans.sent()


def _with_text(docs: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """One bucket of documents in a partition, its spans before its texts; what else ``docs`` has goes along."""
    bucket = F.pmod(F.col("th").bitwiseXOR(F.coalesce("doc_id", F.lit(int(_LAST)))), F.lit(buckets)).cast("int")
    both = docs.withColumns({"kind": F.lit(9), "bucket": bucket}).unionByName(spans, allowMissingColumns=True)
    return both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")


class Found:
    """The spans of a bucket's documents."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.at: dict[tuple[int, int], tuple[int, int]] | None = None

    def add(self, block: bytes) -> None:
        d, t, pos, ln = unpack(block)
        self.parts.append([undeltas(d), undeltas(t), pos.astype(np.int64), ln.astype(np.int64)])

    def of(self, doc_id: int | None, th: int) -> np.ndarray | None:
        if self.at is None:
            self.at = {}
            if self.parts:
                d, t, pos, ln = (np.concatenate(x) for x in zip(*self.parts, strict=True))
                order = np.lexsort((pos, t, d))
                d, t, self.spans = d[order], t[order], np.stack([pos[order], ln[order]])
                head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
                self.at = {(x, y): (a, b) for x, y, a, b in zip(d[head].tolist(), t[head].tolist(), head.tolist(), [*head[1:].tolist(), len(d)], strict=True)}
                self.parts = []
        place = self.at.get((int(_LAST) if doc_id is None else doc_id, th))
        return None if place is None else self.spans[:, place[0] : place[1]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int | None, int, bytes, np.ndarray | None]]:
    """(batch, row, doc_id, th, text, spans) for each row with a text; spans is None where there are none."""
    found = Found()
    for batch in batches:
        kinds, texts, blocks = batch.column("kind").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("block")
        ids, ths = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        for r, kind in enumerate(kinds):
            if kind == 9:
                yield batch, r, ids[r], ths[r], texts[r].as_py() or b"", found.of(ids[r], ths[r])
            else:
                found.add(blocks[r].as_py())


def removed(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal removed runs, from spans in the order of their starts."""
    start, ln = spans
    end = np.maximum.accumulate(start + ln)
    head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[head], np.concatenate([end[head[1:] - 1], end[-1:]])


def result_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
    rows: list[tuple] = []
    size = 0
    for _, _, doc_id, th, text, spans in _documents(batches):
        kept, runs, gone = text, [], 0
        if spans is not None:
            start, end = removed(spans)
            kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
            runs = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            gone = len(text) - len(kept)
        rows.append((doc_id, th, len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        size += len(kept) * with_text + 200
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def text_hash(doc_id: Column | str, text: Column | str) -> Column:
    """Tells rows of one doc_id apart: 32 bits, as every entry carries it, or 64 where the id is null."""
    whole = F.xxhash64(text)
    return F.when(F.isnull(doc_id), whole).otherwise(whole.bitwiseAND(F.lit(0xFFFFFFFF)))


def _found(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """Repeated bytes of the documents (doc_id, th, text), as lists by bucket of documents; the number of buckets."""
    scratch = Scratch(spark, "suffix_dedup")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    blocks = docs.select("doc_id", "th", "text").mapInArrow(lambda it: anchor_batches(it, parts), "part int, kind int, block binary")
    met = blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return scratch.write(met.mapInArrow(lambda it: family_batches(it, parts), COLUMNS)), parts


def suffix_dedup(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without bytes that an earlier string of 100 bytes has.

    Returns doc_id, th (a hash of the text), n_bytes, n_removed, spans (start, end of the maximal removed runs),
    kept_sha256 and kept (the bytes left; null without ``with_text``). Null and empty texts have 0 bytes. Earlier means a
    smaller doc_id, or an earlier start in the same document; null doc_ids come last; rows of one doc_id with other texts
    are ordered by the hash of their text, and rows equal in both are one document, each with the same result. Hot
    passages meet as one entry a batch: a batch keeps the earliest of equal entries and settles the rest at once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", text_hash("doc_id", "text").alias("th"), "text")
    spans, parts = _found(spark, docs)
    schema = "doc_id long, th long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary"
    return _with_text(docs, spans, parts).mapInArrow(lambda it: result_batches(it, with_text), schema)


def _kept_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with a text, the repeated bytes taken out; those of which nothing but white space is left go."""
    now, at, texts = None, [], []

    def sent() -> pa.RecordBatch:
        rows = now.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *rows.column("rest").flatten()], ["text", *names])

    for batch, r, _, _, whole, spans in _documents(batches):
        if batch is not now:
            if at:
                yield sent()
            now, at, texts = batch, [], []
        if spans is not None:
            start, end = removed(spans)
            whole = b"".join(whole[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(whole)], strict=True))
            if not whole.strip():
                continue
        at.append(r)
        texts.append(whole.decode("utf-8", errors="ignore"))
    if at:
        yield sent()


def suffix_dedup_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes taken out of ``text``, and n_chars, where there is one, made to fit.

    A character of which bytes are taken goes as a whole. A row goes if it loses bytes and only white space is left.
    """
    names = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # names are replaced by numbers inside, so that no column can clash with those of the work
    rest = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("doc_id").cast("long"), text).alias("th"), text.alias("text"), rest.alias("rest"))
    spans, parts = _found(spark, rows.select("doc_id", "th", "text"))
    kinds = dict(docs.dtypes)
    inner = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(["text string", *(f"{c} {kinds[n]}" for c, n in zip(inner, names, strict=True))])
    out = _with_text(rows, spans, parts).mapInArrow(lambda it: _kept_batches(it, inner), schema)
    value = {n: F.col(c) for n, c in zip(names, inner, strict=True)} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return out.select(*(value[c].alias(c) for c in docs.columns))
