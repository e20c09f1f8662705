"""Queries on calibrated confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as C
from . import adapter as A
from .registry import register

GRADED = """graded_v as (select event_id, event_type as method, least(floor(value), 100)::double as confidence, user_id % 3 <> 0 as reviewed,
  json_extract_string(props, '$.k')::int < least(floor(value), 100) as correct from events)"""
#: The least-squares step function at a value is the largest, over starts at or below it, of the smallest mean to ends at or above it.
BLOCKS = f"""{GRADED}, c as (select method, confidence, count(*) as n, sum(correct::int) as k from graded_v where reviewed and correct is not null and confidence is not null group by all),
  s as (select *, sum(n) over w as cn, sum(k) over w as ck from c window w as (partition by method order by confidence)),
  m as (select i.method, i.confidence, a.confidence as start, min((e.ck - a.ck + a.k) / (e.cn - a.cn + a.n)) as mean
    from s i join s a on a.method = i.method and a.confidence <= i.confidence join s e on e.method = i.method and e.confidence >= i.confidence group by all),
  g as (select method, confidence, max(mean) as mean from m group by all),
  blocks_v as (select method, min(confidence) as low, max(confidence) as high, sum(n)::bigint as n, sum(k)::bigint as n_correct, sum(k) / sum(n) as p from g join c using (method, confidence) group by method, mean)"""
LIMITS = f"""{BLOCKS}, d as (select method, low, sum(n) over w as above, sum(n - n_correct) over w as wrong from blocks_v window w as (partition by method order by low desc)),
  limits_v as (select method, min(low) filter (wrong * 1000 <= above * 20) as threshold, coalesce(max(above) filter (wrong * 1000 <= above * 20), 0)::bigint as n_accepted,
    coalesce(max(wrong) filter (wrong * 1000 <= above * 20), 0)::bigint as n_wrong, max(above)::bigint as n_reviews from d group by method)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations with a confidence; those of two users in three are reviewed, and right if their grade is below the confidence."""
    confidence = F.least(F.floor("value"), F.lit(100)).cast("double")
    grade = F.get_json_object("props", "$.k").cast("int")
    return A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("group"), confidence.alias("confidence"), (F.col("user_id") % 3 != 0).alias("reviewed"), (grade < confidence).alias("correct"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.isotonic_blocks(_graded(spark, sf_dir).where("reviewed"))


@register("confidence_calibration", f"with {BLOCKS} select * from blocks_v")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).withColumnRenamed("group", "method")


@register("confidence_thresholds", f"with {LIMITS} select * from limits_v")
def confidence_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.thresholds(_blocks(spark, sf_dir)).withColumnRenamed("group", "method")


@register(
    "confidence_routing",
    f"""with {LIMITS}, r as (select event_id, v.confidence, threshold, coalesce(
        (select arg_max(p, low) from blocks_v b where b.method = v.method and b.low <= v.confidence), (select arg_min(p, low) from blocks_v b where b.method = v.method and v.confidence is not null)) as p
      from graded_v v left join limits_v using (method))
    select event_id, p, case when p is null then 'unscored' when confidence >= threshold then 'auto' else 'review' end as route from r""",
)
def confidence_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return C.routed(_graded(spark, sf_dir).select("event_id", "group", "confidence"), blocks, C.thresholds(blocks)).select("event_id", "p", "route")
