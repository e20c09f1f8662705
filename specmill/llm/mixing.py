"""Mixing sources to target weights: weighted sampling with exponential keys, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2
#: Ranges of the key within a source are cut by its logarithm: RANGE_WIDTH / number each, so that one of them holds RANGE_WIDTH / e of the source by number at
#: most. The number is RANGES, or more by RANGE_ROWS; only the range where the budget ends is sorted.
RANGES, RANGE_ROWS, RANGE_WIDTH = 4096, 100_000, 4.0
#: Below every range.
NO_RANGE = -(1 << 62)
#: Sources whose plan is small enough to be sent to every task.
MOST_BROADCAST = 50_000


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from the md5 of the doc_id as text: the same in every run and in SQL."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame) -> DataFrame:
    """(skey, source, source_size) -> with ``target``: the shares by weight, filled like water up to each source's cap.

    With sources in the order of cap by weight, those before the first that stays below its cap are full; the level is what
    is left by the weight that is left. One row a source is all that this sorts.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(number - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(MOST_EPOCHS)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.lit(SHARE) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("level", level).withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    # the first source that is not full has the level; later ones would give the same or more
    first = F.first("level", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("target", F.coalesce(F.least(F.col("cap"), first * F.col("weight")), F.col("cap"))).select("skey", "source", "source_size", "target")


def mix_sources(spark: SparkSession, docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source).

    A source whose target is a whole number of epochs and a part takes every document for each whole epoch, and then
    documents in the order of their exponential key -ln(u) / quality until the part's budget: the document at its end is
    in if more than half of it fits. ``quality`` is a positive column of ``docs``, such as the score of a classifier; without one, or where it is null, not positive or not finite, texts of
    about six characters a word rank highest, a rule of thumb that SQL can follow. Null texts have size 0; a null source is
    a source of its own and comes last; equal keys are ordered by doc_id (null last), size and a hash of the text; repeated rows
    are documents of their own. A source of size 0 takes its rows as often as its whole epochs, 0 words each.

    A source may hold any share of the rows: sums by range of the key find the range where its budget ends, and only that
    range is sorted.
    """
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = (F.lit(None) if quality is None else quality).cast("double").alias("given")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), given)
    rows = rows.select("doc_id", "source", "given", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.length("text").alias("chars"), F.xxhash64("text").alias("th"))
    by_length = F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("chars") / F.greatest(F.col("size"), F.lit(1)) - 6.0) / 6.0)
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / F.when((F.col("given") > 0) & (F.col("given") < float("inf")), F.col("given")).otherwise(by_length))
    rows = scratch.write(rows.withColumn("skey", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))).drop("chars", "given"))
    number = max(RANGES, 1 << (rows.count() // RANGE_ROWS).bit_length())
    # of documents of one quality exp(-1) at most have their key within a factor e, so ranges of the logarithm are small whatever the quality is
    within_double = F.greatest(F.least(F.col("key"), F.lit(1e300)), F.lit(1e-300))
    rows = rows.withColumn("range", F.floor(F.log(within_double) * (number / RANGE_WIDTH)))

    ranges = scratch.write(rows.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size")))
    plan = targets(ranges.groupBy("skey").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size")))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int"))
    plan = plan.withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.write(plan)
    in_order = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.select("skey", "range", "range_size", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)).alias("before"))
    ends = sums.join(plan.select("skey", "part"), "skey").where("before < part").groupBy("skey").agg(F.max("range").alias("end_range"), F.max("before").alias("end_before"))
    plan = scratch.write(plan.join(ends, "skey", "left").drop("source"))
    if plan.count() <= MOST_BROADCAST:  # one row a source; beyond that a join on the source, which Spark splits where it is skewed
        plan = F.broadcast(plan)

    rows = rows.join(plan, "skey").withColumn("end_range", F.coalesce("end_range", F.lit(NO_RANGE)))
    within = Window.partitionBy("skey", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    at_end = rows.where("range = end_range").withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("end_before"))
    at_end = at_end.withColumn("more", (F.col("before") + F.col("size") / 2 < F.col("part")).cast("int")).drop("before")
    others = rows.where("range <> end_range").withColumn("more", (F.col("range") < F.col("end_range")).cast("int"))
    done = others.unionByName(at_end).withColumn("copies", F.col("epochs") + F.col("more"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "th")


def mixed_rows(spark: SparkSession, docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the number of the epoch in ``epoch`` (in place of a column of that name)."""
    one = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))]
    plan = mix_sources(spark, docs, quality).select(one[0].alias("one"), one[1].alias("skey"), "th", "copies")
    plan = plan.groupBy("one", "skey", "th").agg(F.max("copies").alias("copies")).where("copies > 0")
    # the columns of docs go in a struct, so that none can clash with those of the work
    keyed = docs.select(one[0].alias("one"), one[1].alias("skey"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), F.struct("*").alias("row"))
    met = keyed.join(plan.hint("merge"), ["one", "skey", "th"]).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return met.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "epoch"), "epoch")


ORACLE = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, length(coalesce(text, '')) as chars from documents),
k as (
  select *, -ln((('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + abs(chars / greatest(size, 1) - 6.0) / 6.0)) as key from s),
g as (select source, sum(size)::double as source_size from s group by source),
n as (select *, [3.0, 1.0, 2.0][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1]::double as weight from g),
f as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (o rows between current row and unbounded following) as lv, 2 * source_size / weight as fill
  from n window o as (order by 2 * source_size / weight, encode(source) nulls last)),
t as (select source, source_size, least(2 * source_size, weight * (select arg_min(lv, fill) from f where lv <= fill)) as target from f),
p as (select *, case when source_size = 0 then 0 else floor(target / source_size) end as epochs from t),
r as (
  select k.doc_id, k.size, p.*, coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from k join p on k.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  (size * (epochs + case when before + size / 2 < target - epochs * source_size then 1 else 0 end))::bigint as taken
from r
"""
