"""Quality: a sparse ensemble of rules over text statistics.

Shallow trees propose rules, each a path of threshold conditions; an L1 logistic fit keeps a few of them with weights, and
the rules kept are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample, remainder
from .textkernel import _R, _RI, U, Words, at_least, mix, powers, prefix, raw, word_parts

SAMPLE = 20_000
STATS = ["n_bytes", "n_words", "word_len", "upper", "digit", "bang", "symbol", "mark", "pipe", "high", "line_words", "line_again", "word_again", "gram_again", "longest", "lines", "comma", "stop_end"]
Rule = list[tuple[int, bool, float]]  # statistic, above?, threshold

_KIND = np.zeros(256, np.int64)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#$%&*@^~<>=+{}[]\\", b".;:?'\"()-_/", b"|", bytes(range(128, 256)), b"\n", b",")):
    for _c in _chars:
        _KIND[_c] = _n + 1


_STOPS = list(b".!?")


class OpenLine(NamedTuple):
    """What a part of a long row leaves to the next one: the sum and length of the line that is cut, and the byte before the cut."""

    total: np.ndarray = np.zeros(1, np.uint64)
    length: int = 0
    byte: int = 10


class Measures:
    """Counts of some rows, or of one part of a long row, from which their statistics follow; parts add up."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, words: Words, opened: OpenLine = OpenLine(), last: bool = True):
        """``data``, ``offs``: the bytes as they stand, without stops. ``opened``: the line that the part before left; the end of a part that is not the last closes no line."""
        n = len(offs) - 1
        kind = _KIND[data]
        self.size, self.count = np.diff(offs), words.counts()
        length = words.end - words.start
        self.length = at_least(length, words.first, np.add, np.int64(0))
        self.longest = at_least(length, words.first, np.maximum, np.int64(0))
        self.kinds = np.zeros((n, 10), np.int64)
        for k in range(1, 10):
            total = np.concatenate([[0], np.cumsum(kind == k)])
            self.kinds[:, k] = total[offs[1:]] - total[offs[:-1]]
        line_end = np.flatnonzero(data == 10)
        stops = np.isin(data[np.maximum(line_end - 1, 0)], _STOPS) & (line_end > offs[np.searchsorted(offs, line_end, side="right") - 1])
        if len(line_end) and line_end[0] == 0:
            stops[0] = opened.byte in _STOPS
        closed, per_line = np.concatenate([[0], np.cumsum(stops)]), np.searchsorted(line_end, offs)
        self.closed = closed[per_line[1:]] - closed[per_line[:-1]]
        cuts = np.unique(np.concatenate([line_end + 1, offs]))
        start, end = cuts[:-1], cuts[1:]
        owner = np.searchsorted(offs, start, side="right") - 1
        trimmed = np.where(data[end - 1] <= 32, end - 1, end) if len(data) else end.copy()
        self.opened, done = OpenLine(), np.ones(len(start), bool)
        if not last and data[-1] != 10:
            done[-1], trimmed[-1] = False, end[-1]
        h = prefix(data)
        total, line = (h[trimmed] - h[start]) * powers(_RI, len(h))[start], trimmed - start
        if opened.length:
            total[:1] = opened.total + total[:1] * np.array([pow(_R, opened.length, 2**64)], U)
            line[0] += opened.length
        if not last:
            self.opened = OpenLine(byte=int(data[-1])) if done[-1] else OpenLine(total[-1:], int(line[-1]), int(data[-1]))
        filled = done & (line >= 10)
        self.open = np.zeros(n, np.int64)  # rows that do not end with a line feed have one line more
        full = self.size > 0
        self.open[full] = data[offs[1:][full] - 1] != 10
        sh, sh_first = words.shingles(3)
        self.hashes = [
            (mix(total[filled]), owner[filled]),
            (words.hash, np.repeat(np.arange(n), self.count)),
            (sh, np.repeat(np.arange(n), np.diff(sh_first))),
        ]

    def add(self, more: Measures) -> None:
        """The next part of the same row."""
        for name in ("size", "count", "length", "kinds", "closed"):
            setattr(self, name, getattr(self, name) + getattr(more, name))
        self.longest, self.open, self.opened = np.maximum(self.longest, more.longest), np.where(more.size > 0, more.open, self.open), more.opened
        self.hashes = [tuple(np.concatenate(x) for x in zip(a, b, strict=True)) for a, b in zip(self.hashes, more.hashes, strict=True)]

    def statistics(self) -> np.ndarray:
        """One row of STATS for each text; all are finite, 0 for an empty text."""
        n = len(self.size)
        out = np.zeros((n, len(STATS)))
        per, size = np.maximum(self.count, 1), np.maximum(self.size, 1)
        lines = self.kinds[:, 8] + self.open
        out[:, 0], out[:, 1], out[:, 2] = self.size, self.count, self.length / per
        for at, k in ((3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6), (9, 7), (15, 8), (16, 9)):
            out[:, at] = self.kinds[:, k] / (per if at in (5, 6, 7, 8, 16) else size)
        out[:, 10] = self.count / np.maximum(lines, 1)
        for at, (hashes, owner) in zip((11, 12, 13), self.hashes, strict=True):  # share of items that repeat an earlier one
            o = np.lexsort((hashes, owner))
            same = (hashes[o][1:] == hashes[o][:-1]) & (owner[o][1:] == owner[o][:-1])
            out[:, at] = np.bincount(owner[o][1:][same], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
        out[:, 14], out[:, 17] = self.longest, self.closed / np.maximum(self.kinds[:, 8], 1)
        return out


def statistics(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, statistics) of pieces of the rows."""
    for a, b, words in word_parts(column):
        if words.head:
            data, offs = raw(column.slice(a, b - a), lower=False, stop=None)
            at, whole = 0, None
        if words.head and words.tail:
            yield a, b, Measures(data, offs, words).statistics()
            continue
        # lowering keeps the number of characters: the part as it stands ends after as many as the part in lower case has
        n = int(np.count_nonzero(words.data & 0xC0 != 0x80))
        heads = np.flatnonzero(data[at : at + 4 * n + 1] & 0xC0 != 0x80)
        end = len(data) if words.tail or len(heads) <= n else at + int(heads[n])
        more = Measures(data[at:end], np.array([0, end - at]), words, whole.opened if whole else OpenLine(), last=end == len(data))
        at = end
        if whole is None:
            whole = more
        else:
            whole.add(more)
        if words.tail:
            yield a, b, whole.statistics()


def _statistics_batches(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, x in statistics(batch.column("text")):
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x[:, j].copy()) for j in range(len(STATS)))], [*kept, *STATS])


def with_statistics(rows: DataFrame, kept: str) -> DataFrame:
    names = [x.split()[0] for x in kept.split(", ")]
    return rows.select(*names, "text").mapInArrow(lambda it: _statistics_batches(it, names), ", ".join([kept, *(f"{s} double" for s in STATS)]))


def grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int) -> list[tuple[Rule, float]]:
    """A tree of second-order gain: every node's rule, with its leaf value (0 within)."""
    out: list[tuple[Rule, float]] = []

    def node(at: np.ndarray, rule: Rule, left: int) -> None:
        best = (1e-3, -1, 0.0)
        total_g, total_h = g[at].sum(), h[at].sum()
        if left and len(at) >= 40:
            for c in columns:
                place = np.searchsorted(cuts[c], x[at, c], side="left")  # x <= cut number ``place``
                sg, sh = np.bincount(place, g[at], len(cuts[c]) + 1).cumsum()[:-1], np.bincount(place, h[at], len(cuts[c]) + 1).cumsum()[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), c, cuts[c][int(gain.argmax())])
        if rule:
            out.append((rule, 0.0 if best[1] >= 0 else -total_g / (total_h + 1)))
        if best[1] >= 0:
            above = x[at, best[1]] > best[2]
            node(at[~above], [*rule, (best[1], False, best[2])], left - 1)
            node(at[above], [*rule, (best[1], True, best[2])], left - 1)

    node(np.arange(len(x)), [], depth)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for c, above, cut in rule:
        ok &= (x[:, c] > cut) == above
    return ok


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, l1: float = 1e-3, seed: int = 5) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept, and the rules that the L1 logistic fit keeps with their weights."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return bias, []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, c], np.linspace(0.01, 0.99, 40))) for c in range(x.shape[1])]
    f, rules = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        pick = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        for rule, value in grow(x[pick], cuts, (p - y)[pick], (p * (1 - p))[pick], rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False), depth):
            if value:
                f += 0.2 * value * holds(rule, x)
            key = tuple(sorted(rule))
            rules[key] = list(key)
    rules = [r for r in rules.values() if 0.002 < holds(r, x).mean() < 0.998]
    if not rules:
        return bias, []
    m = np.stack([holds(r, x) for r in rules], 1).astype(np.float32)
    mean, scale = m.mean(0), m.std(0)
    z = (m - mean) / scale
    lipschitz = 0.25 * float(np.linalg.eigvalsh(z.T @ z / len(y))[-1]) + 0.25
    w, b, v, vb, t = np.zeros(z.shape[1]), bias, np.zeros(z.shape[1]), bias, 1.0
    for _ in range(300):  # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        new = v - z.T @ (p - y) / len(y) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / lipschitz, 0)
        nb, nt = vb - (p - y).mean() / lipschitz, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = np.flatnonzero(w)
    return float(b - (w * mean / scale).sum()), [(rules[k], float(w[k] / scale[k])) for k in kept]


def compile_rules(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as a column over the statistics. Conditions are grouped by the number of rules so that the expression stays flat."""
    terms = []
    for rule, weight in rules:
        ok = F.lit(True)
        for c, above, cut in rule:
            ok = ok & ((F.col(STATS[c]) > cut) if above else (F.col(STATS[c]) <= cut))
        terms.append(F.when(ok, F.lit(weight)).otherwise(F.lit(0.0)))
    total = F.lit(bias)
    for a in range(0, len(terms), 16):
        part = terms[a]
        for t in terms[a + 1 : a + 16]:
            part = part + t
        total = total + part
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Learns from rows whose crc32 remainder by 5 is not 0."""
    got = with_statistics(labelled_sample(docs, labels, "quality", 5, 0, sample), "doc_id long, label int").toArrow().sort_by([("doc_id", "ascending")])
    x = np.stack([got.column(s).to_numpy() for s in STATS], 1) if got.num_rows else np.zeros((0, len(STATS)))
    return fit(x, (got.column("label").to_numpy() > 0).astype(np.float64))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), from statistics of the whole text.

    Null and empty texts have statistics of 0 and are scored like any other; a null doc_id is not held out and never used
    to learn; repeated rows get equal scores. Without labels of both kinds every score is the same constant.
    """
    bias, rules = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_statistics(rows, "doc_id long").withColumn("score", compile_rules(bias, rules))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
