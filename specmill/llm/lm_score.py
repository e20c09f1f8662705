"""LM scoring by stupid backoff: count tables of n-grams by hash range, joined to the n-grams of the documents.

Documents are put in chunks, which are written once, so that every later step sees the same ones. A chunk's n-grams are exploded, summed
within the chunk and sent to the ranges of their hash, one packed row a chunk and range. A range adds up the counts of all
chunks, which is its part of the count table, joins them to the n-grams of each chunk and sends the totals back in their order.
So a frequent n-gram is one entry a chunk, never one a document. The chunk then sums the scores of its documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deltas, pack, undeltas, unpack
from .shared import Scratch
from .textkernel import U, Hashes, _C, mix

ORDER, BACKOFF = 3, 0.4
#: Text bytes of a chunk, and of the texts whose n-grams one range of hashes is made for, at most.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Bits of an n-gram's hash.
BITS = 56


def grams(words: Hashes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that end an n-gram of this order within their text, and its hash."""
    n = len(words.hash)
    place = np.arange(n)
    start = np.repeat(words.first[:-1], words.counts())
    place = place[place - start >= order - 1]
    h = words.hash[place] * _C[0]
    for k in range(1, order):
        h = h + words.hash[place - k] * _C[k]
    return place, mix(h + U(order)) >> U(64 - BITS)


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (key, size, block): chunks of rows, compressed, with their text bytes."""
    ids, texts, size = [], [], 0

    def made() -> pa.RecordBatch:
        table = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(texts)], ["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_batch(table)
        block = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["key", "size", "block"])

    for batch in batches:
        column = batch.column(1).cast(pa.large_string()).fill_null("")
        length = pc.binary_length(column).to_numpy(zero_copy_only=False)
        at = 0
        for r in range(len(column)):
            size += int(length[r])
            if size >= CHUNK_BYTES:
                ids.append(batch.column(0).slice(at, r + 1 - at))
                texts.append(column.slice(at, r + 1 - at))
                yield made()
                ids, texts, size, at = [], [], 0, r + 1
        if at < len(column):
            ids.append(batch.column(0).slice(at))
            texts.append(column.slice(at))
    if ids:
        yield made()


def rows_of(block: bytes) -> tuple[pa.Array, pa.Array]:
    """doc_ids and texts of a chunk."""
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(block)) as r:
        batch = next(iter(r))
    return batch.column(0), batch.column(1)


def count_batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(key, block) of chunks -> (part, key, block): distinct n-grams of a chunk, with counts, by range of their hash."""
    edges = np.array([(p << BITS) // parts for p in range(parts)] + [1 << BITS], np.uint64)
    for batch in batches:
        for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = Hashes(rows_of(block.as_py())[1])
            tables = [np.unique(grams(words, m)[1], return_counts=True) for m in range(1, ORDER + 1)]
            cuts = [np.searchsorted(h, edges) for h, _ in tables]
            ids, rows = [], []
            for p in range(parts):
                cols = []
                for (h, c), cut in zip(tables, cuts, strict=True):
                    cols += [deltas(h[cut[p] : cut[p + 1]]), c[cut[p] : cut[p + 1]].astype(np.uint32)]
                if any(len(c) for c in cols):
                    ids.append(p)
                    rows.append(pack(*cols))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([key] * len(ids), pa.binary()), pa.array(rows, pa.binary())], ["part", "key", "block"])


def total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by part -> (key, part, block): the totals of each block's n-grams, in its order."""
    part, keys, blocks = None, [], []

    def added() -> pa.RecordBatch:
        totals: list[list[np.ndarray]] = [[] for _ in blocks]
        columns = [unpack(b) for b in blocks]
        for m in range(ORDER):
            h = [undeltas(c[2 * m]) for c in columns]
            _, where = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(where, np.concatenate([c[2 * m + 1] for c in columns]))
            total = (total.astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64))[where] if len(where) else np.zeros(0, np.uint32)
            for k, x in enumerate(np.split(total, np.cumsum([len(x) for x in h])[:-1])):
                totals[k].append(x)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([part] * len(keys), pa.int32()), pa.array([pack(*t) for t in totals], pa.binary())], ["key", "part", "block"])

    for batch in batches:
        for p, key, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if p != part and keys:
                yield added()
                keys, blocks = [], []
            part = p
            keys.append(key)
            blocks.append(block)
    if keys:
        yield added()


def counts_of(words: Hashes, order: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word the count of the n-gram that it ends: in all documents, and in all but its own; 0 where there is none."""
    whole, out = np.zeros(len(words.hash), np.int64), np.zeros(len(words.hash), np.int64)
    place, h = grams(words, order)
    where = np.unique(h, return_inverse=True)[1]
    whole[place] = count = total[where].astype(np.int64)
    more = np.flatnonzero(count > 1)  # an n-gram that stands once in the corpus stands in no other document
    row = np.searchsorted(words.first, place[more], side="right")
    _, pair, own = np.unique((row << 32) | where[more], return_inverse=True, return_counts=True)
    out[place[more]] = count[more] - own[pair]
    return whole, out


def score_chunk(words: Hashes, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log scores of each text but for the size of the corpus, and how often that divides."""
    n = len(words.hash)
    at = np.arange(n) - np.repeat(words.first[:-1], words.counts())
    value, left = np.zeros(n), np.ones(n, bool)
    for m in range(ORDER, 1, -1):
        hit = left & (at >= m - 1) & (counts[m - 1] > 0)
        place = np.flatnonzero(hit)
        value[place] = np.log(counts[m - 1][place] / counts[m - 2][place - 1]) + np.log(BACKOFF) * (np.minimum(at[place], ORDER - 1) - (m - 1))
        left &= ~hit
    place = np.flatnonzero(left)
    value[place] = np.log(np.maximum(counts[0][place], 0.5)) + np.log(BACKOFF) * np.minimum(at[place], ORDER - 1)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (value, left.astype(np.int64))]
    return tuple(s[words.first[1:]] - s[words.first[:-1]] for s in sums)


def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, block) sorted by key and part: a chunk (part -1), then its totals -> sums of its documents."""
    key, chunk, found = None, b"", []

    def scored() -> pa.RecordBatch:
        ids, texts = rows_of(chunk)
        words = Hashes(texts)
        both = [counts_of(words, m + 1, np.concatenate([f[m] for f in found] or [np.zeros(0, np.uint32)])) for m in range(ORDER)]
        columns = [x for k in (1, 0) for x in score_chunk(words, [b[k] for b in both])]
        return pa.RecordBatch.from_arrays([ids, pa.array(words.counts()), *map(pa.array, columns)], ["doc_id", "n_words", "value", "ends", "whole_value", "whole_ends"])

    for batch in batches:
        for k, part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != key:
                if key is not None:
                    yield scored()
                key, found = k, []
            if part < 0:
                chunk = block.as_py()
            else:
                found.append(unpack(block.as_py()))
    if key is not None:
        yield scored()


def lm_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score, total_log_score, corpus_log_score for every row of ``docs`` (doc_id, text).

    total_log_score is the sum over the words of the logarithm of the stupid backoff score with trigrams: the count of the longest
    n-gram that other documents have, by that of its context, times 0.4 for each step of backing off; the single word is
    divided by the number of words, and one that no other document has counts one half. Counts are those of all documents
    but the scored one, whose own n-grams would always be found. log_score is the mean over the words. corpus_log_score is the mean
    with the counts of all documents, the scored one among them. Words are as in the hashing kernel. Null, empty and wordless
    texts have 0 words and scores of 0; repeated rows are other documents to each other; doc_id may be null.
    """
    scratch = Scratch(spark, "lm_scores")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunks = scratch.write(rows.mapInArrow(chunk_batches, "key binary, size long, block binary"))
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    counted = chunks.select("key", "block").mapInArrow(lambda it: count_batches(it, parts), "part int, key binary, block binary")
    totals = counted.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(total_batches, "key binary, part int, block binary")
    both = totals.unionByName(chunks.select("key", F.lit(-1).alias("part"), "block"))
    schema = "doc_id long, n_words long, value double, ends long, whole_value double, whole_ends long"
    done = scratch.write(both.repartition("key").sortWithinPartitions("key", "part").mapInArrow(score_batches, schema))
    scratch.drop(0)
    total = float(done.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    others, words = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1.0)), F.greatest(F.col("n_words"), F.lit(1))
    score = F.col("value") - F.when(F.col("ends") > 0, F.col("ends") * F.log(others)).otherwise(0.0)
    whole = F.col("whole_value") - F.when(F.col("whole_ends") > 0, F.col("whole_ends") * F.log(F.lit(max(total, 1.0)))).otherwise(0.0)
    return done.select("doc_id", "n_words", (score / words).alias("log_score"), score.alias("total_log_score"), (whole / words).alias("corpus_log_score"))
