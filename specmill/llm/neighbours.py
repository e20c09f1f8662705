"""Approximate nearest neighbours as a block matrix join: int8 tiles with error bounds, survivors in double precision.

The product of int8 tiles gives every inner product within a known error. A candidate can be among the k nearest only if
its upper bound reaches the k-th best lower bound, so what is dropped is proven not to be; recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

K, EVERY = 20, 20
#: Query rows of a tile, candidate rows of a block, and candidate rows that one unit of work is meant to see at most.
QUERY_TILE, BLOCK, UNIT = 16384, 4096, 131072
#: Components whose int8 products add up exactly in float32, and the relative error allowed for rounding in the bounds.
EXACT, ROUNDING = 1024, 1e-6
#: Queries multiplied at once.
STRIP = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as float32, exact in products), scale, norm of the quantised row and norm of its error."""
    scale = np.abs(x).max(1) / 127.0
    rounded = np.rint(x / scale[:, None])
    error = np.linalg.norm(x - rounded * scale[:, None], axis=1)
    return rounded.astype(np.int8), scale, np.linalg.norm(rounded * scale[:, None], axis=1), error


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed in the order of the components."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * c[:, k]
    return out


class Tile:
    """The queries of one unit and their heaps."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.q, self.scale, self.norm, self.error = quantise(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        rounded, scale, norm, error = quantise(x)
        whole = np.linalg.norm(x, axis=1)
        tile = rounded.astype(np.float32 if x.shape[1] <= EXACT else np.float64).T
        order = np.argsort(ids)
        for a in range(0, len(self.ids), STRIP):
            b = min(a + STRIP, len(self.ids))
            near = (self.q[a:b].astype(tile.dtype) @ tile).astype(np.float64)
            near *= self.scale[a:b, None]
            near *= scale
            bound = self.norm[a:b, None] * error + self.error[a:b, None] * whole + ROUNDING * (self.norm[a:b, None] + self.error[a:b, None]) * whole
            # rows of the query's id; the one of its very vector is the query itself, any other is a candidate
            first, last = (np.searchsorted(ids, self.ids[a:b], side=side, sorter=order) for side in ("left", "right"))
            q = np.repeat(np.arange(b - a), last - first)
            c = order[np.arange(len(q)) - np.repeat(np.cumsum(last - first) - last, last - first)]
            own = (self.x[a + q] == x[c]).all(1)
            near[q[own], c[own]] = -np.inf
            low = near - bound
            least = self.least[a:b]
            if low.shape[1] >= self.k:
                least = np.maximum(least, np.partition(low, -self.k, axis=1)[:, -self.k])
            near += bound
            i, j = np.nonzero((near >= least[:, None]) & (near > -np.inf))
            score = exact(self.x[a + i], x[j])
            for q, s, v in zip((a + i).tolist(), score.tolist(), (-ids[j]).tolist(), strict=True):
                heap = self.heaps[q]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, v))
                elif (s, v) > heap[0]:
                    heapq.heapreplace(heap, (s, v))
            for q in np.unique(a + i).tolist():
                if len(self.heaps[q]) == self.k:
                    self.least[q] = self.heaps[q][0][0]

    def result(self) -> pa.RecordBatch:
        rows = [(int(i), -v, s) for i, heap in zip(self.ids, self.heaps, strict=True) for s, v in heap]
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy()
    return flat.reshape(len(batch), -1)


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x, dim), sorted by dim -> (dim, ids, rows): blocks of rows of one dimension as bytes."""
    for batch in batches:
        dim = batch.column("dim").to_numpy()
        for d in np.unique(dim).tolist():
            part = batch.filter(pa.array(dim == d))
            x = _matrix(part)
            ids = part.column("vec_id").to_numpy()
            cut = range(0, len(x), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(cut), pa.int32()), pa.array([ids[a : a + BLOCK].tobytes() for a in cut], pa.binary()), pa.array([x[a : a + BLOCK].tobytes() for a in cut], pa.binary())], ["dim", "ids", "rows"])


def product_batches(batches: Iterator[pa.RecordBatch], k: int, sort: str) -> Iterator[pa.RecordBatch]:
    """Blocks of a unit (dim, tile, part) together, its queries (kind 0) first -> the k best candidates seen of each query."""
    key, queries, tile = None, [], None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["dim"], r["tile"], r["part"]) != key:
                if tile is not None:
                    yield tile.result()
                key, queries, tile = (r["dim"], r["tile"], r["part"]), [], None
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["rows"], sort).reshape(len(ids), -1).astype(np.float64)
            if r["kind"] == 0:
                queries.append((ids, x))
            elif queries:
                if tile is None:
                    tile = Tile(np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), k)
                tile.add(ids, x)
    if tile is not None:
        yield tile.result()


def nearest(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, the
    ``k`` others of largest inner product, ties to the smaller id; fewer where there are fewer.

    Vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows of null id. Rows
    equal in id and vector count once; of an id with several vectors the smallest in array order is the query, and each is a
    candidate, of that query only those with another vector than its own. Vectors of other lengths are not compared.
    Queries come in tiles and candidates in blocks; every (tile, part of the candidates) is one unit of work, so neither
    side has to fit anywhere.
    """
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    kind, sort = ("float", "<f4") if kind == "float" else ("double", "<f8")
    x = F.col("embedding").cast(f"array<{kind}>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = good.where(finite & F.exists("x", lambda v: v != 0))
    good = Scratch(spark, "nearest").write(good.distinct().withColumn("dim", F.size("x")))
    good_queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    number = good.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    tiles = max(1, -(-number.q // QUERY_TILE))
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-number.n // UNIT), min(cores // tiles, -(-number.n // BLOCK)))

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(block_batches, "dim int, ids binary, rows binary")

    query_blocks = good_queries.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
    query_blocks = query_blocks.repartition(tiles, "tile").mapInArrow(_tiled_blocks, "dim int, tile int, ids binary, rows binary")
    query_blocks = query_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
    candidates = blocks(good).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    candidates = candidates.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("kind", F.lit(1))
    both = query_blocks.unionByName(candidates).repartition(max(cores, tiles * parts), "dim", "tile", "part").sortWithinPartitions("dim", "tile", "part", "kind")
    found = both.mapInArrow(lambda it: product_batches(it, k, sort), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tiled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        for t in np.unique(tile).tolist():
            for out in block_batches(iter([batch.filter(pa.array(tile == t))])):
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array([t] * len(out), pa.int32()), out.column(1), out.column(2)], ["dim", "tile", "ids", "rows"])


ORACLE = """
with v as (
  select distinct vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x) as score
  from (select vec_id, min(x) as x from v where vec_id % 20 = 0 group by vec_id) q join v c on len(q.x) = len(c.x) and not (q.vec_id = c.vec_id and q.x = c.x)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
