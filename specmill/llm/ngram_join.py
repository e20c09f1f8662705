"""N-gram Jaccard join: MinHash banding, pairs that meet in a band verified on whole shingle sets, classes of linked documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, connected_components
from .textkernel import U, at_least, mix, signature, word_parts

N_WORDS = 5
THRESHOLD = 0.8
#: Documents of one block, and shingles of one block, of a large bucket.
BLOCK_DOCS, BLOCK_SHINGLES = 300, 400_000


def bands_for(threshold: float, recall: float = 0.9995, rows: int = 4) -> int:
    """Bands of ``rows`` MinHash values so that a pair at the threshold meets in one with probability ``recall``; above it the probability is higher."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int = N_WORDS) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, th) -> (doc_id, th, node, n_sh, bands): ``node`` is the hash of the word sequence, null without words."""
    mult = _multipliers(bands * rows)
    most = np.uint64(2**64 - 1)
    for batch in batches:
        for a, b, words in word_parts(batch.column(1)):
            sh, first = words.shingles(n)
            low = np.stack([at_least((sh * m) >> U(20), first, empty=most) for m in mult], 1)
            number, count, sums = np.diff(first), words.counts(), words.sums(1)
            if not words.head:
                low, number, count, sums = np.minimum(low, whole[0]), number + whole[1], count + whole[2], sums + whole[3]
            whole = low, number, count, sums
            if not words.tail:
                continue
            keys = np.empty((b - a, bands), np.uint64)
            for band in range(bands):
                acc = np.full(b - a, band + 1, np.uint64)
                for r in range(rows):
                    acc = mix(acc * U(0x9E3779B97F4A7C15) + low[:, band * rows + r])
                keys[:, band] = acc
            part = batch.slice(a, b - a)
            node = pa.array(_signed(signature(sums, count)), mask=number == 0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(_signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, pa.array(number), flat], ["doc_id", "th", "node", "n_sh", "bands"])


@dataclass
class Doc:
    node: int
    side: int
    many: int
    bands: np.ndarray
    shingles: np.ndarray


def _compare(docs: list[Doc], band: int, across: bool, threshold: float) -> Iterator[tuple[int, int, int]]:
    """Links of a block of a bucket or between two: (node, linked documents, root). Pairs that met in an earlier band count there."""
    n = len(docs)
    size = np.array([len(d.shingles) for d in docs])
    side, many = np.array([d.side for d in docs]), np.array([d.many for d in docs])
    earlier = np.stack([d.bands[:band] for d in docs])
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    all_sh = np.concatenate([d.shingles for d in docs])
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(all_sh, kind="stable")
    s, owner = all_sh[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    end = np.concatenate([head[1:], [len(s)]])
    run_of = np.empty(len(s), np.int64)
    run_of[order] = np.repeat(np.arange(len(head)), end - head)
    bounds = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        new = np.arange(n) < i
        if across:
            new &= side != side[i]
        new[:i] &= ~(earlier[:i] == earlier[i]).any(1)
        new &= (1 + threshold) * np.minimum(size, size[i]) >= threshold * (size + size[i]) - 1e-9
        todo = np.flatnonzero(new)
        if not len(todo):
            continue
        if len(todo) <= 8:
            both = np.array([np.isin(docs[j].shingles, docs[i].shingles, assume_unique=True).sum() for j in todo])
        else:
            mine = run_of[bounds[i] : bounds[i + 1]]
            length = end[mine] - head[mine]
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(head[mine], length)
            both = np.bincount(owner[place], minlength=n)[todo]
        hit = todo[both * (1 + threshold) >= threshold * (size[todo] + size[i]) - 1e-9]
        links[i] += many[hit].sum()
        links[hit] += many[i]
        for j in hit.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    for i in np.flatnonzero(links).tolist():
        yield docs[i].node, int(links[i]), docs[find(i)].node


def verify_batches(batches: Iterator[pa.RecordBatch], threshold: float, n: int = N_WORDS) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, i, j, side, node, many, bands, text), those of one (band, key, i, j) together -> (node, links, root)."""
    unit, docs = None, []
    out: list[tuple[int, int, int]] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "side", "node", "many")]
        for a, b, words in word_parts(batch.column("text")):
            sh, first = words.shingles(n)
            for r in range(a, b):
                mine = np.unique(sh[first[r - a] : first[r - a + 1]])
                if not words.head:
                    mine = np.union1d(whole, mine)
                whole = mine
                if not words.tail:
                    continue
                band, key, i, j, side, node, many = (c[r] for c in cols)
                if (band, key, i, j) != unit:
                    if len(docs) > 1:
                        out.extend(_compare(docs, unit[0], unit[2] != unit[3], threshold))
                    unit, docs = (band, key, i, j), []
                docs.append(Doc(node, side, many, batch.column("bands")[r].values.to_numpy(), mine))
            if len(out) > 20_000:
                yield flush()
    if len(docs) > 1:
        out.extend(_compare(docs, unit[0], unit[2] != unit[3], threshold))
    yield flush()


def _classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, recall: float = 0.9995, rows: int = 4) -> DataFrame:
    """doc_id, th, node, label, class_id, n_links of every row; node and label are null without words."""
    scratch = Scratch(spark, "ngram_join")
    bands = bands_for(threshold, recall, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("th", F.xxhash64("text"))
    sketch = scratch.write(hashed.mapInArrow(lambda it: sketch_batches(it, bands, rows, n), "doc_id long, th long, node long, n_sh long, bands array<long>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min(first).alias("rep"), F.count("*").alias("many"), F.first("n_sh").alias("n_sh"), F.first("bands").alias("bands"))
    nodes = scratch.write(nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("rep_th"), "many", "n_sh", "bands"))
    member = nodes.select("node", "n_sh", F.posexplode("bands").alias("band", "key"))
    # buckets of equal members are compared once, in the first band: most pairs meet in several
    print_of = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in (0, 1)]
    bucket = member.groupBy("band", "key").agg(F.count("*").alias("c"), F.sum("n_sh").alias("sh"), *print_of).where("c > 1")
    bucket = bucket.groupBy("c", "sh", "p0", "p1").agg(F.min("band").alias("band"), F.min_by("key", "band").alias("key"))
    # a bucket's blocks: documents and shingles of each are bounded; every pair of blocks is one unit of work
    bucket = bucket.select("band", "key", F.greatest(F.lit(1), F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("sh") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    met = member.join(bucket, ["band", "key"]).groupBy("node").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("met"))
    placed = scratch.write(met.join(nodes.drop("n_sh"), "node"))
    # always a shuffle of both sides: a broadcast would hold only while the groups are few
    one = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select(one.alias("one"), F.xxhash64("text").alias("rep_th"), "text")
    texts = texts.join(placed.withColumn("one", F.coalesce(F.col("rep").cast("string"), F.lit(""))).hint("merge"), ["one", "rep_th"])
    work = texts.select("node", "many", "bands", "text", F.explode("met").alias("met")).select("node", "many", "bands", "text", "met.*")
    work = work.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "node", "many", "bands", "text")
    work = work.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "side", "node")
    found = scratch.write(work.mapInArrow(lambda it: verify_batches(it, threshold, n), "node long, links long, root long"))
    label = connected_components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    marked = nodes.select("node", "rep", "many").join(links, "node", "left").join(label, "node", "left").select("node", "rep", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    least = marked.groupBy("label").agg(F.min("rep").alias("class_id"))
    marked = scratch.write(marked.join(least, "label").select("node", "label", "class_id", "n_links"))
    joined = sketch.select("doc_id", "th", "node").join(marked, "node", "left")
    return joined.select("doc_id", "th", "node", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def ngram_join(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, recall: float = 0.9995, rows: int = 4) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its class of near-duplicates: doc_id, class_id, n_links.

    Two texts are linked where the Jaccard similarity of their sets of ``n``-word shingles is ``threshold`` or more.
    class_id is the smallest doc_id of those joined by links; n_links counts the other rows linked to the row, exact
    copies among them. Exact copies (same words in order, by a 64-bit hash) are collapsed first and share one node, so that a
    group of copies costs one comparison. Nodes that share a MinHash band are compared on their whole shingle sets, once, in the
    first band that they share; large buckets in pairs of bounded blocks that return counts and a spanning forest, never the pairs.

    Null, empty and wordless texts are a class of their own (class_id = doc_id, 0 links). Texts of fewer than ``n``
    words have one shingle of all their words. Repeated rows are copies of each other; rows whose doc_id is null
    take part and get the class_id of the rest of their class (null if there is none). Other columns are ignored.
    """
    return _classes(spark, docs, threshold, n, recall, rows).select("doc_id", "class_id", "n_links")


def one_of_each(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, with one row of each class: that of the smallest doc_id (null last), then of the smallest hash of its text. Wordless texts all stay."""
    classes = _classes(spark, docs.select("doc_id", "text"), threshold, n)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    first = classes.where("label is not null").groupBy("label").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.th").alias("th"), F.lit(True).alias("words"))
    wordless = classes.where("label is null").select(F.col("doc_id").alias("id"), "th", F.lit(False).alias("words")).distinct()
    kept = first.unionByName(wordless).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("one"), "th", "words")
    # the columns of docs go in a struct, so that none can clash with those of the work
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("one"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.struct("*").alias("row"))
    met = keyed.join(kept.hint("merge"), ["one", "th"])
    number = F.row_number().over(Window.partitionBy("one", "th").orderBy("th"))
    return met.withColumn("number", number).where("number = 1 or not words").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
