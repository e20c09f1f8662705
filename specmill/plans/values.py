"""Queries on values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import adapter as A
from .registry import register


@register(
    "document_numbers",
    """with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[0-9]+(?:[.,٫٬][0-9]+)*')) as token from documents),
    k as (select *, len(token) - len(replace(token, '.', '')) as points, len(token) - len(replace(token, ',', '')) as commas, regexp_extract(token, '[.,]', 0) as first_mark,
      right(regexp_replace(token, '[^.,]', '', 'g'), 1) as last_mark, len(regexp_extract(token, '[.,]([^.,]*)$', 1)) as after from t),
    v as (select *, case
      when points + commas = 0 then 0
      when points > 0 and commas > 0 then case when last_mark = ',' and commas = 1 then 1 when last_mark = '.' and points = 1 then -1 else 0 end
      when points + commas > 1 then case when points > 0 then 1 else -1 end
      when after = 3 and not (token[1] = '0' and token[2] = first_mark) then 0 else case when commas = 1 then 1 else -1 end end as vote from k),
    d as (select doc_id, case when sum(vote) > 0 then ',' else '.' end as mark from v group by doc_id),
    n as (select v.doc_id, token, mark, case
      when (case mark when '.' then points else commas end) = 1 and (points = 0 or commas = 0 or last_mark = mark) then replace(replace(token, case mark when '.' then ',' else '.' end, ''), mark, '.')
      when points > 0 and commas > 0 and last_mark <> mark and (case mark when '.' then commas else points end) = 1 then replace(replace(token, mark, ''), last_mark, '.')
      when points > 0 and commas > 0 then null
      else replace(replace(token, '.', ''), ',', '') end as plain from v join d using (doc_id))
    select doc_id, token, case mark when ',' then 'comma' else 'point' end as convention, replace(replace(plain, '٬', ''), '٫', '.')::double as value, count(*) as n from n group by all""",
)
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every document, read by the convention that the document's numbers vote for."""
    docs = A.table(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.explode(V.number_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    known = each.join(V.conventions(docs).select("doc_id", "convention"), "doc_id")
    return known.select("doc_id", "token", "convention", V.number_value(F.col("token"), F.col("convention")).alias("value"), "n")


@register(
    "value_intervals",
    """with v as (select p_partkey as product_id, p_partkey % 7 as form, p_size::double as a, (p_size + 5)::double as b, p_retailprice as c from part),
    r as (select product_id,
      case when form in (0, 1) then a when form = 2 then a * 1000 when form = 4 then a * 0.9 when form = 5 then c / 1000 when form = 6 then (a - 32) * 5 / 9 end as lo,
      case when form in (0, 1) then b when form = 3 then a / 1000 when form = 4 then a * 1.1 when form = 5 then c / 1000 when form = 6 then (b - 32) * 5 / 9 end as hi,
      case form when 2 then 'V1' when 3 then 'm1' when 4 then 'V1' when 5 then 'W1·m-2' when 6 then '°C1' else 'A1' end as dims, form = 0 as adjustable from v)
    select product_id, round(lo, 9) as lo, round(hi, 9) as hi, dims, adjustable from r""",
)
def value_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and prices of products, written in seven ways with units and scripts, and read as intervals in base units."""
    part = A.table(spark, sf_dir, "part").withColumn("form", F.col("p_partkey") % 7)
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string")
    price = F.translate(F.format_number("p_retailprice", 2), ".,", ",.")  # 1.234,50
    written = (
        F.when(F.col("form") == 0, F.concat(a, F.lit("–"), b, F.lit(" A adjustable")))
        .when(F.col("form") == 1, F.concat(F.translate(a, "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit(" to "), F.translate(b, "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit(" A")))
        .when(F.col("form") == 2, F.concat(F.lit("≥ "), a, F.lit(" kV")))
        .when(F.col("form") == 3, F.concat(F.lit("max. "), a, F.lit(" mm")))
        .when(F.col("form") == 4, F.concat(a, F.lit(" V ± 10 %")))
        .when(F.col("form") == 5, F.concat(price, F.lit(" mW/m2")))
        .otherwise(F.concat(a, F.lit("..."), b, F.lit(" °F")))
    )
    read = part.select("p_partkey", V.interval(written, F.when(F.col("form") == 5, V.COMMA).otherwise(V.POINT)).alias("v")).select("p_partkey", V.canonical_interval(F.col("v")).alias("v"))
    return read.select(F.col("p_partkey").alias("product_id"), F.round("v.lo", 9).alias("lo"), F.round("v.hi", 9).alias("hi"), "v.dims", "v.adjustable")
