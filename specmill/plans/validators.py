"""Queries on the checks of extracted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import validators as V
from ..sources.scratch import Steps
from . import adapter as A
from .registry import register

NUMBERED = "n_v as (select l_orderkey as tender_id, l_linenumber as a, l_partkey % 9 + 1 as b from lineitem)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = A.table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("tender_id"), F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_partkey") % 9 + 1).cast("string")).alias("line_no"))


@register(
    "numbering_gaps",
    f"""with {NUMBERED}, k as (select distinct tender_id, '' as parent, a::bigint as own from n_v union select distinct tender_id, a::varchar, b::bigint from n_v),
    g as (select tender_id, parent, own, coalesce((select max(x.own) from k x where x.tender_id = k.tender_id and x.parent = k.parent and x.own < k.own), 0) as after from k
      where own > 1 and not exists (select 1 from k x where x.tender_id = k.tender_id and x.parent = k.parent and x.own = k.own - 1))
    select tender_id, parent, after, own as before, own - after - 1 as n_missing from g""",
)
def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbering_gaps(_numbered(spark, sf_dir))


@register(
    "stated_counts",
    f"""with {NUMBERED}, s as (select o_orderkey as tender_id, unnest(range(1, 4)) as section, o_custkey % 4 as stated from orders)
    select s.tender_id, s.section, s.stated, count(a) as found from s left join n_v on n_v.tender_id = s.tender_id and a = section group by all having count(a) <> s.stated""",
)
def stated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sections of every order against a count that the customer states."""
    orders = A.table(spark, sf_dir, "orders")
    sections = orders.select(F.col("o_orderkey").alias("tender_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("section"), (F.col("o_custkey") % 4).alias("stated"))
    return V.stated_counts(sections, _numbered(spark, sf_dir))


@register(
    "inherited_attributes",
    f"""with recursive {A.LINES}, l as (
      select line_id, case when ln = 1 and tender_id % 50 = 0 then line_id - 1 + (select count(*) from lines_v x where x.tender_id = v.tender_id) when ln = 2 and tender_id % 41 = 0 then -1 when ln > 1 and (tender_id + ln) % 5 <> 0 then line_id - 1 end as up,
        case when ln % 2 = 0 then brand end as brand, case when ln % 3 <> 2 then qty::varchar end as size, case when ln = 1 then letter end as letter from lines_v v),
    w as (select line_id, line_id as at, up, 0 as depth, brand, size, letter from l
      union all select w.line_id, l.line_id, l.up, depth + 1, l.brand, l.size, l.letter from w join l on l.line_id = w.up where depth < 60),
    r as (select line_id, max(depth) as depth, bool_or(up = -1) as broken, arg_min(brand, depth) filter (brand is not null) as brand, arg_min(size, depth) filter (size is not null) as size, arg_min(letter, depth) filter (letter is not null) as letter from w group by line_id)
    select line_id, case when depth >= 60 then l.brand else r.brand end as brand, case when depth >= 60 then l.size else r.size end as size, case when depth >= 60 then l.letter else r.letter end as letter,
      case when depth >= 60 then 'cycle' when broken then 'missing_parent' when l.up is null then 'own' else 'inherited' end as status from l join r using (line_id)""",
)
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that inherit from the line before them: in some orders from none that exists, in some in a ring."""
    lines = A.lines(spark, sf_dir)
    ln, size = F.col("line_no").cast("long"), F.element_at("attributes", "size")
    lines = lines.withColumn("n", F.count("*").over(Window.partitionBy("tender_id")))
    up = F.when((ln == 1) & (F.col("tender_id") % 50 == 0), F.col("line_id") - 1 + F.col("n")).when((ln == 2) & (F.col("tender_id") % 41 == 0), F.lit(-1)).when((ln > 1) & ((F.col("tender_id") + ln) % 5 != 0), F.col("line_id") - 1)
    bag = F.create_map(F.lit("brand"), F.when(ln % 2 == 0, F.element_at("attributes", "brand")), F.lit("size"), F.when(ln % 3 != 2, size), F.lit("letter"), F.when(ln == 1, F.element_at("attributes", "insulation_class")))
    done = V.inherited(Steps(spark, "inherited"), lines.select("line_id", up.alias("inherit_from"), bag.alias("attributes")))
    return done.select("line_id", *(F.element_at("attributes", k).alias(k) for k in ("brand", "size", "letter")), "status")
