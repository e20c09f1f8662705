"""Which class a line or vector belongs to: known names first, found by an automaton, then the nearest class centroids with their margins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .retrieval import tokens

#: Whole parts of 1 that components are rounded to: sums and products stay exact.
GRID = 1 << 20
#: Aliases, and numbers of centroids, that are sent to every task at once; more aliases are joined, more numbers go in several passes.
MOST_ALIASES, MOST_NUMBERS = 100_000, 4_000_000


def on_grid(v: Column) -> Column:
    """A vector in whole parts of GRID; null if it is null, empty, or holds a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.round(x.cast("double") * GRID).cast("long")))


def centroids(vectors: DataFrame, dims: int) -> DataFrame:
    """(class_id, n, centroid) over (class_id, v): the mean of each class, component by component, in whole parts.

    Each component is a sum of its own, so that partial sums of a class are one row a task and no vector is taken apart for a shuffle.
    Vectors of another length than ``dims`` take no part.
    """
    rows = vectors.where("class_id is not null").select("class_id", on_grid(F.col("v")).alias("g")).where(F.size("g") == dims)
    sums = rows.groupBy("class_id").agg(F.count("*").alias("n"), *(F.sum(F.col("g")[i]).alias(f"s{i}") for i in range(dims)))
    return sums.select("class_id", "n", F.array(*(F.floor(F.col(f"s{i}") / F.col("n")) for i in range(dims))).alias("centroid"))


def _nearest(batches: Iterator[pa.RecordBatch], names: pa.Array, matrix: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """(id, g) -> (id, class_id, score), the ``top`` + 1 nearest classes of each; products of whole numbers below 2**53 are exact."""
    size = np.sqrt((matrix * matrix).sum(1))
    for batch in batches:
        g = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(batch), -1)
        own = np.sqrt((g * g).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (g @ matrix.T) / (own[:, None] * size[None, :])
        score = np.where(np.isfinite(score), score, 0.0)
        best = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
        at = np.repeat(np.arange(len(batch)), best.shape[1])
        ids = batch.column(0).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([ids, names.take(pa.array(best.ravel())), pa.array(score[at, best.ravel()])], ["id", "class_id", "score"])


def nearest_classes(vectors: DataFrame, means: DataFrame, dims: int, top: int = 3) -> DataFrame:
    """(id, rank, class_id, score, margin) over (id, v): the ``top`` classes by cosine, ties to the smaller class, with the distance to the next one (null for the last class of all).

    The centroids are one row a class. They are sent to tasks in parts of at most MOST_NUMBERS numbers; several parts take one pass over the vectors each.
    """
    rows = vectors.select("id", on_grid(F.col("v")).alias("g")).where(F.size("g") == dims)
    kind, label = vectors.schema["id"].dataType.simpleString(), means.schema["class_id"].dataType.simpleString()
    many = max(1, MOST_NUMBERS // dims)
    numbered = means.withColumn("part", F.floor((F.row_number().over(Window.orderBy("class_id")) - 1) / many))
    found = None
    for part in range(-(-means.count() // many)):
        known = sorted((r.class_id, r.centroid) for r in numbered.where(F.col("part") == part).collect())  # at most MOST_NUMBERS numbers
        names, matrix = pa.array([k for k, _ in known], to_arrow_type(means.schema["class_id"].dataType)), np.array([c for _, c in known], np.float64)
        near = rows.mapInArrow(lambda it, n=names, m=matrix: _nearest(it, n, m, top), f"id {kind}, class_id {label}, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = rows.select("id", F.lit(None).cast(label).alias("class_id"), F.lit(0.0).alias("score")).where("false")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "class_id")
    ranked = found.select("id", F.row_number().over(order).alias("rank"), "class_id", "score", (F.col("score") - F.lead("score").over(order)).alias("margin"))
    return ranked.where(F.col("rank") <= top)


def spoken(text: Column) -> Column:
    """A text as its tokens between single blanks, with one at each end."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _longest(batches: Iterator[pa.RecordBatch], words: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, alias, start): the longest alias in each text, the first of equal length."""
    machine = _automaton(words)
    for batch in batches:
        ids, found, starts = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            best = min(((-len(w), end - len(w) + 1, w) for end, w in machine.iter(text)), default=None)
            if best:
                ids.append(i)
                starts.append(best[1])
                found.append(best[2])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], ["id", "alias", "start"])


def _looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``alias_lookup`` by a join of runs of tokens with the table of aliases. An id is one text."""
    sizes = known.select((F.size(F.split("alias", " ")) - 2).alias("size")).distinct().agg(F.collect_set("size").alias("sizes"))
    said = rows.select("id", tokens(F.col("text")).alias("w")).where("size(w) > 0").crossJoin(F.broadcast(sizes))
    starts = said.select("id", "w", F.explode(F.filter("sizes", lambda n: n <= F.size("w"))).alias("size"))
    runs = starts.select("id", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    runs = runs.select("id", "at", F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("at"), F.col("size")), " "), F.lit(" ")).alias("alias"))
    hits = runs.join(known.hint("merge"), "alias")
    best = F.min(F.struct((-F.length("alias")).alias("minus"), "at", "alias", "target", "n_targets")).alias("b")
    first = hits.groupBy("id").agg(best).select("id", "b.alias", "b.target", "b.n_targets")
    # an alias begins where it is first found, since both stand between blanks
    placed = rows.select("id", spoken(F.col("text")).alias("text")).join(first.hint("merge"), "id")
    start = (F.expr("locate(alias, text)") - 1).cast("long")
    return placed.select("id", F.trim("alias").alias("alias"), start.alias("start"), "target", "n_targets").where("start >= 0")


def alias_lookup(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, alias, start, target, n_targets) of rows (id, text) that hold an alias of (alias, target) as whole tokens: the longest, the first of these, and its smallest target.

    Up to MOST_ALIASES aliases are one automaton, which is built once a worker and reads a text once. More are a table: the runs of tokens of a text that are as long as some alias
    are joined with it, so that no alias goes through the driver and the work grows with the texts and the distinct lengths of aliases. n_targets above 1 tells of an alias that is claimed twice.
    """
    known = aliases.select(spoken(F.col("alias")).alias("alias"), "target").where("length(alias) > 2")
    known = known.groupBy("alias").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n_targets"))
    kind = rows.schema["id"].dataType.simpleString()
    words = tuple(sorted(r.alias for r in known.select("alias").limit(MOST_ALIASES + 1).collect()))
    if len(words) > MOST_ALIASES:
        return _looked_up(rows, known)
    found = None
    if words:
        said = rows.select("id", spoken(F.col("text")).alias("text"))
        found = said.mapInArrow(lambda it: _longest(it, words), f"id {kind}, alias string, start long")
    if found is None:
        return rows.select("id", F.lit(None).cast("string").alias("alias"), F.lit(0).cast("long").alias("start")).where("false").join(known, "alias")
    best = F.min(F.struct((-F.length("alias")).alias("minus"), "start", "alias")).alias("b")
    return found.groupBy("id").agg(best).select("id", "b.alias", "b.start").join(known, "alias").select("id", F.trim("alias").alias("alias"), "start", "target", "n_targets")


def scoped(named: DataFrame, ranked: DataFrame, least_margin: float) -> DataFrame:
    """(id, class_id, how): the alias's target where there is one, else the nearest class if it is ``least_margin`` ahead, else null and ``class_uncertain``."""
    first = ranked.where("rank = 1").select("id", F.col("class_id").alias("near"), "margin")
    both = named.select("id", "target").join(first, "id", "full_outer")
    clear = F.coalesce(F.col("margin") >= least_margin, F.col("near").isNotNull())
    how = F.when(F.col("target").isNotNull(), "alias").when(clear, "centroid").otherwise("class_uncertain")
    return both.select("id", F.coalesce("target", F.when(clear, F.col("near").cast("string"))).alias("class_id"), how.alias("how"))
