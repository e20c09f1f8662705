"""Toxicity: a factorization machine over hashed terms.

Terms are words and their first four and six bytes. Beside a weight, each term has a short vector; the inner product
of two vectors is the weight of the pair, so a pair such as an insult with the mention of a group counts where neither
word does alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .labelled import labelled_sample, remainder
from .textkernel import U, Words, mix, ranges, word_parts

BITS, FACTORS = 18, 4
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Most frequent terms among which pairs are screened, and the chi-square that a pair must reach: of its million pairs none does by chance.
PAIRED, PAIR_CHI = 1500, 45.0


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def active(self) -> np.ndarray:
        return (self.w != 0) | (self.v != 0).any(1)

    def score(self, number: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        total = self.bias + np.bincount(row, self.w[term], number)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            total += 0.5 * (np.bincount(row, x, number) ** 2 - np.bincount(row, x * x, number))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def terms(words: Words, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each row's distinct terms; only those ``active``, if given."""
    row = np.repeat(np.arange(len(words.offs) - 1), words.counts())
    rows, buckets = [], []
    for kind, most in enumerate((None, 4, 6)):
        h = words.hash if most is None else ranges(words.h, words.start, np.minimum(words.end, words.start + most))
        bucket = (mix(h + U(kind)) >> U(64 - BITS)).astype(np.int64)
        keep = slice(None) if active is None else active[bucket]
        rows.append(row[keep])
        buckets.append(bucket[keep])
    key = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
    return key >> BITS, key & ((1 << BITS) - 1)


def chi_square(seen: np.ndarray, with_label: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Statistic of what stands in ``seen`` of n rows, ``with_label`` of them labelled, against the label, with continuity correction."""
    gap = np.maximum(np.abs(with_label * n - seen * pos) - n / 2, 0)
    return gap**2 * n / (np.maximum(seen * (n - seen), 0.5) * pos * (n - pos))


def paired(data: list[tuple[int, np.ndarray]], seen: np.ndarray, out: np.ndarray, pos: float) -> np.ndarray:
    """Terms, among the most frequent of ``out``, that tell nothing alone but stand beside another of them in rows of a telling label."""
    n = len(data)
    chosen = out[(seen[out] >= 20) & (seen[out] <= 0.9 * n)]
    chosen = chosen[np.argsort(-seen[chosen], kind="stable")[:PAIRED]]
    place = np.full(len(seen), -1)
    place[chosen] = np.arange(len(chosen))
    both, labelled = (np.zeros((len(chosen), len(chosen)), np.float32) for _ in range(2))
    for a in range(0, n, 1000):  # products of blocks of rows
        x = np.zeros((len(data[a : a + 1000]), len(chosen)), np.float32)
        for k, (_, found) in enumerate(data[a : a + 1000]):
            at = place[found]
            x[k, at[at >= 0]] = 1
        both += x.T @ x
        y = np.array([d[0] for d in data[a : a + 1000]], bool)
        labelled += x[y].T @ x[y]
    chi = chi_square(both.astype(np.float64), labelled.astype(np.float64), n, pos)
    np.fill_diagonal(chi, 0)
    return chosen[(chi > PAIR_CHI).any(1)]


def fit(data: list[tuple[int, np.ndarray]], least_steps: int = 6000, batch: int = 64, least_chi: float = 20.0, l1: float = 1e-5, l2: float = 1e-4, seed: int = 11) -> Machine:
    """Proximal AdaGrad on the logistic loss. data: label and term buckets of each row.

    Terms whose chi-square against the label is below ``least_chi`` stay out, as most hashed terms are noise for a few
    thousand rows, unless a pair of them has one of PAIR_CHI or more.
    """
    size = 1 << BITS
    w, v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    y = np.array([d[0] for d in data], np.float32)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 10)
        return Machine(float(np.log(share / (1 - share))), w, v)
    n, pos = len(y), float(y.sum())
    with_label, seen = np.zeros(size), np.zeros(size)
    for label, found in data:
        seen[found] += 1
        if label:
            with_label[found] += 1
    used = chi_square(seen, with_label, n, pos) > least_chi
    used[paired(data, seen, np.flatnonzero((seen > 0) & ~used), pos)] = True
    rows = [d[1][used[d[1]]] for d in data]
    rng = np.random.default_rng(seed)
    v[used] = rng.normal(0, 0.05, (int(used.sum()), FACTORS))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-1, np.float32), 1.0
    for _ in range(max(6, -(-least_steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            n = len(pick)
            length = np.array([len(rows[i]) for i in pick])
            row, term = np.repeat(np.arange(n), length), np.concatenate([rows[i] for i in pick])
            x = v[term]
            sums = np.stack([np.bincount(row, x[:, f], n) for f in range(FACTORS)], 1)
            squares = np.stack([np.bincount(row, x[:, f] ** 2, n) for f in range(FACTORS)], 1)
            z = bias + np.bincount(row, w[term], n) + 0.5 * (sums**2 - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / n
            gb += g.sum() ** 2
            bias -= 0.2 * g.sum() / np.sqrt(gb)
            each, at = np.unique(term, return_inverse=True)
            dw = np.bincount(at, g[row], len(each))
            gw[each] += dw**2
            step = 0.2 / np.sqrt(gw[each])
            new = w[each] - step * dw
            w[each] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            dv = np.stack([np.bincount(at, g[row] * (sums[row, f] - x[:, f]), len(each)) for f in range(FACTORS)], 1) + l2 * v[each]
            gv[each] += dv**2
            v[each] -= 0.05 * dv / np.sqrt(gv[each])
    return Machine(bias, w, v)


def term_batches(batches: Iterator[pa.RecordBatch], text: int, active: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, row, bucket) of pieces of the batches; a long row's terms are gathered over its parts."""
    for batch in batches:
        for a, b, words in word_parts(batch.column(text)):
            row, term = terms(words, active)
            if not words.head:
                term = np.union1d(before, term)
                row = np.zeros(len(term), np.int64)
            before = term
            if words.tail:
                yield batch.slice(a, b - a), row, term


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, row, term in term_batches(batches, 1):
        cut = np.searchsorted(row, np.arange(len(part) + 1))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(term.astype(np.int32)))], ["doc_id", "label", "terms"])


def _scores(batches: Iterator[pa.RecordBatch], model: Machine) -> Iterator[pa.RecordBatch]:
    for part, row, term in term_batches(batches, 1, model.active()):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(len(part), row, term))], ["doc_id", "score"])


def _clean(batches: Iterator[pa.RecordBatch], model: Machine, text: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for part, row, term in term_batches(batches, text, model.active()):
        yield part.filter(pa.array(model.score(len(part), row, term) < threshold))


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled rows -> one row, the model packed."""
    rows = sorted(((i, int(y > 0), t.values.to_numpy().copy()) for batch in batches for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)), key=lambda r: r[0])
    model = fit([(y, t) for _, y, t in rows])
    at = np.flatnonzero(model.active())
    yield pa.RecordBatch.from_arrays([pa.array([pack(np.array([model.bias]), at.astype(np.int32), model.w[at], model.v[at].ravel())], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learns from rows whose crc32 remainder by 3 is not 1. The sample is fitted in one task, which its bound allows; the driver gets the model alone."""
    chosen = labelled_sample(docs, labels, "toxic", 3, 1, sample)
    terms_of = chosen.mapInArrow(_features, "doc_id long, label int, terms array<int>").repartition(1)
    row = terms_of.mapInArrow(_fit_batches, "model binary").first()
    if row is None:  # a plan over a table known to be empty runs no task
        return fit([])
    bias, at, w, v = unpack(row[0])
    model = Machine(float(bias[0]), np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    model.w[at], model.v[at] = w, v.reshape(-1, FACTORS)
    return model


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), the whole text scored.

    Only the text is an input of the score. Null and empty texts get the score of a text without terms; a null doc_id is
    not held out and never used to learn; repeated rows get equal scores. Without labels of both kinds every score
    is a constant near the share of toxic rows.
    """
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose score is below ``threshold``."""
    model, text = train(docs, labels, sample), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _clean(it, model, text, threshold), docs.schema)
