"""Queries on the hard filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hardfilter as H
from ..sources.scratch import Steps
from . import adapter as A
from .registry import register

MARKS = ("CE", "UL", "IEC", "GS")


def _members(bits, marks):
    named = F.array(*(F.when(F.expr(f"{bits} & {1 << i}") > 0, m) for i, m in enumerate(marks)))
    return F.filter(named, lambda m: m.isNotNull())


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, certificates, size and an adjustable range of each part; every 13th has no certificates on file, every 11th no range."""
    part = A.table(spark, sf_dir, "part")
    each = [
        ("brand", H.offer(txt=F.col("p_brand")), F.lit(True)),
        ("size", H.offer(lo=F.col("p_size").cast("double")), F.lit(True)),
        ("certificates", H.offer(members=_members("p_partkey", MARKS)), F.col("p_partkey") % 13 != 0),
        ("rating", H.offer(lo=F.col("p_size").cast("double"), hi=(F.col("p_size") + F.col("p_partkey") % 20).cast("double")), F.col("p_partkey") % 11 != 0),
    ]
    entries = F.filter(F.array(*(F.when(known, F.struct(F.lit(n).alias("key"), o.alias("value"))) for n, o, known in each)), lambda e: e.isNotNull())
    return part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("class_id"), F.map_from_entries(entries).alias("has"))


@register(
    "hard_filter_ladder",
    f"""with {A.LINES}, p as (select p_partkey as id, p_type as class, p_brand as brand, p_size::double as size, p_size + p_partkey % 20 as hi, p_partkey & 15 as marks, p_partkey % 13 <> 0 as has_m, p_partkey % 11 <> 0 as has_r from part),
    w as (select a as class, b as to_class from (select p_type as a, lead(p_type) over (order by p_type) as b from (select distinct p_type from part)) where b is not null),
    l as (select line_id, class_id as class, qty, brand, line_id % 4 as need from lines_v where class_id is not null),
    s as (select distinct class, qty, brand, need from l),
    j as (
      select s.*, p.id, p.class = s.class as own, p.brand = s.brand as b, case when need = 0 then true when has_m then marks & need = need end as m, p.size >= qty as z, case when has_r then p.size <= qty and qty <= hi end as r
      from s join p on p.class = s.class or p.class = (select to_class from w where w.class = s.class)),
    k as (
      select class, qty, brand, need, count(*) filter (own and b and m and z and r) as n0, min(id) filter (own and b and m and z and r) as f0,
        count(*) filter (own and m and z and r) as n1, min(id) filter (own and m and z and r) as f1, count(*) filter (own and z and r) as n2, min(id) filter (own and z and r) as f2,
        count(*) filter (own and r) as n3, min(id) filter (own and r) as f3, count(*) filter (r) as n4, min(id) filter (r) as f4,
        count(*) filter (own and b and z and coalesce(m, true) and coalesce(r, true) and (m is null or r is null)) as nu
      from j group by all),
    a as (select *, case when n0 > 0 then 0 when n1 > 0 then 1 when n2 > 0 and need > 0 then 2 when n3 > 0 then 3 when n4 > 0 then 4 end as step from k)
    select lines_v.line_id, (case when l.need = 0 and step > 1 then step - 1 else step end)::int as level,
      case when step >= 1 then 'brand' else '' end || case when step >= 2 and l.need > 0 then ',certificates' else '' end || case when step >= 3 then ',size' else '' end as dropped, coalesce(step = 4, false) as widened,
      coalesce(case step when 0 then n0 when 1 then n1 when 2 then n2 when 3 then n3 when 4 then n4 end, 0) as n_eligible, case step when 0 then f0 when 1 then f1 when 2 then f2 when 3 then f3 when 4 then f4 end as first_product, coalesce(nu, 0) as n_unverifiable
    from lines_v left join l using (line_id) left join a on a.class = l.class and a.qty = l.qty and a.brand = l.brand and a.need = l.need""",
)
def hard_filter_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line against the products of its class: brand, certificates and size may be relaxed, in this order; the range is critical and never is."""
    lines = A.lines(spark, sf_dir).withColumn("marks", F.col("line_id") % 4)
    qty = F.col("qty").cast("double")
    needs = F.array(
        H.need("brand", "eq", txt=F.element_at("attributes", "brand"), place=1),
        H.need("certificates", "superset", members=_members("marks", MARKS[:2]), place=2),
        H.need("size", "gte", num=qty, place=3),
        H.need("rating", "range_contains", num=qty),
    )
    lines = lines.select("line_id", "class_id", F.filter(needs, lambda n: (n["op"] != "superset") | (F.size(n["members"]) > 0)).alias("needs"))
    classes = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("c")).distinct().agg(F.array_sort(F.collect_set("c")).alias("c"))
    crosswalk = classes.select(F.explode(F.arrays_zip(F.col("c").alias("from_class"), F.slice("c", F.lit(2), F.size("c")).alias("to_class"))).alias("x")).select("x.*").where("to_class is not null")
    done = H.hard_filter(Steps(spark, "hardfilter"), lines, _products(spark, sf_dir), crosswalk)
    return done.withColumn("dropped", F.array_join("dropped", ","))
