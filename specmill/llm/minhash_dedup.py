"""MinHash near-dedup: fast similarity sketches in bands, exact verification, components of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import bands_for
from .shared import Scratch, connected_components
from .textkernel import _R, _RI, U, Hashes, at_least, mix, pieces, powers, prefix, raw

N_WORDS, THRESHOLD, RECALL, BAND_ROWS = 4, 0.8, 0.9999, 4
#: Documents of one unit of comparison, and shingles of one.
UNIT_DOCS, UNIT_SHINGLES = 300, 400_000
#: Bytes of a long row that are hashed at once.
PART = 1 << 20
#: Bits of a sketch's value that tell its round; the rest is the hash.
ROUND_BITS = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, polynomial) of the runs without white space."""
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[0::2], edge[1::2]
    h = prefix(data)
    return start, end, (h[end] - h[start]) * powers(_RI, len(h))[start]


class BlankWords(Hashes):
    """Hashes of the words of some rows, where white space alone separates and only A-Z are lower-cased. A long row is hashed in parts; the word at a cut, of any length, is carried over."""

    def __init__(self, column: pa.Array):
        data, offs = raw(column, lower=False)
        if len(column) > 1 or len(data) <= PART:
            data = _LOWER[data]
            start, _, value = _words(data)
            self.hash, self.first = mix(value), np.searchsorted(start, offs)
            return
        found, value, length = [], 0, 0
        for a in range(0, len(data), PART):
            part = _LOWER[data[a : a + PART]]
            start, end, values = _words(part)
            if length and len(start) and start[0] == 0:  # the word goes on
                value = (value + int(values[0]) * pow(_R, length, 2**64)) % 2**64
                length += int(end[0])
                if end[0] == len(part):
                    continue
                start, end, values = start[1:], end[1:], values[1:]
            if length:
                found.append(np.array([value], np.uint64))
                value = length = 0
            if len(end) and end[-1] == len(part):
                value, length = int(values[-1]), int(end[-1] - start[-1])
                values = values[:-1]
            found.append(values)
        self.hash = mix(np.concatenate(found))  # the row ends with a separator, so that no word is open
        self.first = np.array([0, len(self.hash)])


def shingle_sets(column: pa.Array, n: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and each row's first."""
    sh, first = BlankWords(column).shingles(n)
    if len(first) == 2:
        sh = np.unique(sh)
        return sh, np.array([0, len(sh)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[new], np.searchsorted(row[new], np.arange(len(first)))


def fast_sketch(sets: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A sketch of ``t`` coordinates of each set, in rounds over all sets whose sketch has empty coordinates.

    In each of the first ``t`` rounds every member is placed into one coordinate by a hash of its own for the round, with the round and then
    the hash as its value; in the next ``t`` rounds all members go to one coordinate, the rounds' number less t, so that
    all are full at the end. The least value stays, so an earlier round is never overwritten. Of a large set one round fills nearly all, so that the
    work is |set| + t log t; values of two sets agree in a coordinate with the probability of their Jaccard similarity, and
    the number of agreements is concentrated as if members were drawn without replacement. Empty sets stay empty (the largest number).
    """
    if not 1 <= t <= 1 << (ROUND_BITS - 1):
        raise ValueError("sketch size out of range")
    rows = len(first) - 1
    out = np.full(rows * t, 2**64 - 1, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    for k in range(2 * t):
        x = mix(sets * U(0x9E3779B97F4A7C15) + U(0xD1B54A32D192ED03 * (k + 1) % 2**64))
        place = ((x >> U(32)) * U(t) >> U(32)).astype(np.int64) if k < t else k - t
        np.minimum.at(out, row * t + place, (U(k) << U(64 - ROUND_BITS)) | (mix(x) >> U(ROUND_BITS)))
        unfilled = (out.reshape(rows, t) == U(2**64 - 1)).any(1)
        go = unfilled[row]
        sets, row = sets[go], row[go]
        if not len(row):
            break
    return out.reshape(rows, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, t = sketch.shape
    keys = np.empty((n, t // rows), np.uint64)
    for band in range(t // rows):
        acc = np.full(n, band + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + sketch[:, band * rows + r])
        keys[:, band] = acc
    return keys


def sketch_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, th) -> (doc_id, th, node, n_shingles, bands): ``node`` is a hash of the shingle set, null for an empty one."""
    for batch in batches:
        for a, b in pieces(batch.column(1)):
            part = batch.slice(a, b - a)
            sets, first = shingle_sets(part.column(1), n)
            number = np.diff(first)
            node = mix(at_least(mix(sets ^ U(0xA0761D6478BD642F)), first, np.add) + number.astype(np.uint64))
            keys = band_keys(fast_sketch(sets, first, bands * rows), rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            node = pa.array(node.view(np.int64), mask=number == 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, pa.array(number), flat], ["doc_id", "th", "node", "n_shingles", "bands"])


@dataclass
class Doc:
    node: int
    label: int
    home: int | None
    side: int
    bands: np.ndarray
    shingles: np.ndarray


def link(docs: list[Doc], band: int, across: bool, threshold: float) -> np.ndarray:
    """The component of each document of a unit, as the number of its first one, from the components that ``label`` gives.

    A pair is compared on the whole sets, unless it is in one component by then; was together in a unit before (``home``); shares a
    band before ``band``, where it is compared; or has sizes that exclude the threshold.
    """
    n = len(docs)
    size = np.array([len(d.shingles) for d in docs])
    side = np.array([d.side for d in docs])
    home = np.array([-1 - i if d.home is None else 0 for i, d in enumerate(docs)]), np.array([d.home or 0 for d in docs])
    _, at, where = np.unique([d.label for d in docs], return_index=True, return_inverse=True)
    comp = at[where]
    earlier = np.stack([d.bands[:band] for d in docs])
    every = np.concatenate([d.shingles for d in docs])
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    s, owner = every[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    end = np.concatenate([head[1:], [len(s)]])
    run_of = np.empty(len(s), np.int64)
    run_of[order] = np.repeat(np.arange(len(head)), end - head)
    bounds = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        new = comp != comp[i]
        new[: i + 1] = False
        if across:
            new &= side != side[i]
        new &= (home[0] != home[0][i]) | (home[1] != home[1][i])
        new &= (1 + threshold) * np.minimum(size, size[i]) >= threshold * (size + size[i]) - 1e-9
        if band:
            new &= ~(earlier == earlier[i]).any(1)
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
        for j in todo[both * (1 + threshold) >= threshold * (size[todo] + size[i]) - 1e-9].tolist():
            if comp[j] != comp[i]:
                low, high = sorted((comp[i], comp[j]))
                comp[comp == high] = low
    return comp


def units(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[Doc]]]:
    """Documents of each (band, key, i, j) from rows in their order; a node that comes twice counts once."""
    unit, docs = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "node", "label", "home", "side")]
        for a, b in pieces(batch.column("text")):
            sets, first = shingle_sets(batch.column("text").slice(a, b - a), n)
            for r in range(a, b):
                band, key, i, j, node, label, home, side = (c[r] for c in cols)
                if (band, key, i, j) != unit:
                    if len(docs) > 1:
                        yield unit, docs
                    unit, docs = (band, key, i, j), []
                if not docs or docs[-1].node != node:
                    docs.append(Doc(node, label, home, side, batch.column("bands")[r].values.to_numpy(), sets[first[r - a] : first[r - a + 1]].copy()))
    if len(docs) > 1:
        yield unit, docs


def settle_batches(batches: Iterator[pa.RecordBatch], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    """The first round: (node, label, home) of every document of a unit. The first of a unit is the bucket's pivot, which is in all of its units."""
    for (band, key, i, _), docs in units(batches, n):
        comp = link(docs, 0, False, threshold)
        home = int(mix(np.array([(key ^ (band << 32) ^ i * 0x9E3779B97F4A7C15) % 2**64], np.uint64)).view(np.int64)[0])
        nodes = np.array([d.node for d in docs])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[comp]), pa.array([None] + [home] * (len(docs) - 1), pa.int64())], ["node", "label", "home"])


def edge_batches(batches: Iterator[pa.RecordBatch], threshold: float, n: int) -> Iterator[pa.RecordBatch]:
    """The second round: (a, b) of labels that a link joins."""
    for (band, _, i, j), docs in units(batches, n):
        label = np.array([d.label for d in docs])
        root = label[link(docs, band, i != j, threshold)]
        edges = np.unique(np.stack([label, root], 1)[label != root], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _blocks(docs: str, shingles: str):
    return F.greatest(F.lit(1), F.ceil(F.col(docs) / UNIT_DOCS), F.ceil(F.col(shingles) / UNIT_SHINGLES)).cast("int")


_UNIT = ["band", "key", "i", "j"]


def _dealt(work: DataFrame) -> DataFrame:
    return work.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "node")


def minhash_dedup(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, n: int = N_WORDS, recall: float = RECALL, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Two documents are linked where the Jaccard similarity of their sets of ``n``-word shingles is ``threshold`` or more; component_id is the
    smallest doc_id that links reach, kept tells whether it is the row's own. Candidates share a band of the sketch (``recall`` is that of a pair at
    the threshold; above it, it is higher); every link is confirmed on the whole sets of 64-bit shingle hashes. Equal sets are one node.

    Buckets of a band may be of any size. In the first round every node goes to one bucket, its largest; there it is compared within a unit of
    bounded size that holds the bucket's pivot, so that a group of near-copies costs its size and not the square. In the second
    round only buckets that hold nodes of several components which have not met go on: all but the bucket's largest component are compared with
    the rest, in pairs of bounded blocks. Pairs that are in one component by then are not compared.

    Null, empty and blank texts have no shingle and no link. Texts of fewer than ``n`` words have one shingle, the whole sequence. Repeated rows
    are in one component, and all of them are kept or none. A null doc_id is never a component_id unless all ids of the component are null; such rows
    are kept. Very long texts are hashed in parts, words of any length among them. Other columns are ignored.
    """
    scratch = Scratch(spark, "minhash_dedup")
    bands = bands_for(threshold, recall, rows)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sketch = scratch.write(hashed.mapInArrow(lambda it: sketch_batches(it, bands, rows, n), "doc_id long, th long, node long, n_shingles long, bands array<long>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min(first).alias("rep"), F.first("n_shingles").alias("n_sh"), F.first("bands").alias("bands"))
    nodes = scratch.write(nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "n_sh", "bands"))
    one = F.coalesce(F.col("rep").cast("string"), F.lit("")).alias("one")
    texts = hashed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("one"), "th", "text")

    # buckets of equal members are one, in their first band
    member = nodes.select("node", "n_sh", F.posexplode("bands").alias("band", "key"))
    print_of = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in (0, 1)]
    bucket = member.groupBy("band", "key").agg(F.count("*").alias("c"), *print_of).where("c > 1")
    bucket = scratch.write(bucket.groupBy("c", "p0", "p1").agg(F.min("band").alias("band"), F.min_by("key", "band").alias("key")).select("band", "key", "c"))

    # first round: every node in its largest bucket, whose units all hold its pivot
    largest = F.max(F.struct("c", (-F.col("band")).alias("minus"), "key", "n_sh")).alias("m")
    chosen = member.join(bucket, ["band", "key"]).groupBy("node").agg(largest).select("node", (-F.col("m.minus")).alias("band"), "m.key", "m.n_sh")
    chosen = scratch.write(chosen)
    pivot = chosen.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("c"), F.sum("n_sh").alias("sh")).where("c > 1")
    pivot = pivot.select("band", "key", "pivot", _blocks("c", "sh").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    seats = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    seated = chosen.drop("n_sh").join(pivot, ["band", "key"]).select("node", "band", "key", seats.alias("seats"))
    seated = scratch.write(seated.join(nodes.select("node", one, "th"), "node"))
    # always a shuffle of both sides: a broadcast would hold only while the groups are few
    work = texts.join(seated.hint("merge"), ["one", "th"]).select("band", "key", F.explode("seats").alias("i"), "node", "text")
    work = work.select("band", "key", "i", F.lit(0).alias("j"), "node", F.col("node").alias("label"), F.lit(None).cast("long").alias("home"), F.lit(0).alias("side"), F.array().cast("array<long>").alias("bands"), "text")
    met = _dealt(work).mapInArrow(lambda it: settle_batches(it, threshold, n), "node long, label long, home long")
    met = scratch.write(met.groupBy("node").agg(F.min("label").alias("label"), F.min("home").alias("home")))

    # second round: buckets with several components that have not been together in a unit
    labelled = nodes.select("node", "n_sh", "bands").join(met, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.write(labelled)
    member = labelled.select("node", "label", "home", "n_sh", F.posexplode("bands").alias("band", "key")).join(bucket.select("band", "key"), ["band", "key"])
    several = member.groupBy("band", "key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("home").alias("h0"), F.max("home").alias("h1"), F.count_if(F.col("home").isNull()).alias("none"))
    several = several.where("l0 < l1 and (none > 0 or h0 < h1)").select("band", "key")
    member = scratch.write(member.join(several, ["band", "key"]))
    parts = member.groupBy("band", "key", "label").agg(F.count("*").alias("c"), F.sum("n_sh").alias("sh"))
    parts = parts.groupBy("band", "key").agg(F.sum("c").alias("c"), F.sum("sh").alias("sh"), F.max(F.struct("c", "sh", "label")).alias("g"))
    parts = parts.select("band", "key", _blocks("c", "sh").alias("blocks"), F.col("g.label").alias("main"), F.col("g.c").alias("gc"), F.col("g.sh").alias("gsh"), (F.col("c") - F.col("g.c")).alias("rc"), (F.col("sh") - F.col("g.sh")).alias("rsh"))
    whole = F.col("blocks") == 1
    plan = parts.select("band", "key", F.when(~whole, F.col("main")).alias("main"), F.when(whole, 1).otherwise(_blocks("rc", "rsh")).alias("rb"), F.when(whole, 0).otherwise(_blocks("gc", "gsh")).alias("gb"))
    placed = member.select("node", "band", "key", "label", "home").join(plan, ["band", "key"])
    in_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    side = F.when(in_main, F.col("rb") + F.pmod(F.xxhash64("node"), F.greatest("gb", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), "rb")).cast("int")
    others = F.when(in_main, F.sequence(F.lit(0), F.col("rb") - 1)).otherwise(F.sequence(F.lit(0), F.col("rb") + F.col("gb") - 1))
    placed = placed.select("node", "label", "home", "band", "key", side.alias("side"), others.alias("others"))
    placed = placed.groupBy("node").agg(F.first("label").alias("label"), F.first("home").alias("home"), F.collect_list(F.struct("band", "key", "side", "others")).alias("seats"))
    placed = scratch.write(placed.join(nodes.select("node", one, "th", "bands"), "node"))
    work = texts.join(placed.hint("merge"), ["one", "th"]).select("node", "label", "home", "bands", "text", F.explode("seats").alias("s"))
    work = work.select("node", "label", "home", "bands", "text", "s.band", "s.key", "s.side", F.explode("s.others").alias("other"))
    work = work.select("band", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "label", "home", "side", "bands", "text")
    edges = scratch.write(_dealt(work).mapInArrow(lambda it: edge_batches(it, threshold, n), "a long, b long"))

    joined = connected_components(scratch, edges)
    final = labelled.select("node", "label").join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    final = final.join(nodes.select("node", "rep"), "node")
    least = final.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = scratch.write(final.join(least, "label").select("node", "component_id"))
    rows_of = sketch.select("doc_id", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows_of.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
e as (from l union all select b, a from l),
r as (select doc_id as a, doc_id as c from documents union select e.b as a, r.c from r join e on e.a = r.a),
c as (select a as doc_id, min(c) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from documents d join c using (doc_id) left join n using (doc_id)
"""
