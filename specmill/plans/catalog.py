"""Queries on catalogues: ingest, prices, staleness, class inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import chunk_key
from ..operators import ingest as I
from . import adapter as A
from .registry import register

# an upload of all parts with changes: some have item numbers, some only part numbers, some only names, some come twice
UPLOAD = f"""{A.PRODUCTS}, upload_v as (
  select product_id * 2 + k as pos, supplier_id, class_id,
    case when product_id % 7 = 0 then 'new ' || name else name end || case when product_id % 5 = 4 then ' ' || product_id else '' end as name,
    case when product_id % 5 in (0, 1) then lower(mpn) || case when product_id % 11 = 0 then 'x' else '' end end as mpn, price + k as price
  from products_v, range(2) r(k) where k = 0 or product_id % 3 = 0),
last_v as (
  select * from (select *, case when mpn is not null then 'm:' || upper(mpn) else 'n:' || upper(name) end as identity, row_number() over (partition by supplier_id, case when mpn is not null then 'm:' || upper(mpn) else 'n:' || upper(name) end order by pos desc) as n from upload_v) where n = 1),
found_v as (
  select l.*, case when mpn is not null then (select min(product_id) from products_v p where p.supplier_id = l.supplier_id and upper(p.mpn) = upper(l.mpn))
    else (select min(product_id) from products_v p where p.supplier_id = l.supplier_id and upper(p.name) = upper(l.name)) end as product_id from last_v l)"""


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = A.products(spark, sf_dir).join(A.prices(spark, sf_dir), "product_id")
    rows = products.withColumn("k", F.explode(F.when(F.col("product_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    id_ = F.col("product_id")
    name = F.concat(F.when(id_ % 7 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")), F.when(id_ % 5 == 4, F.concat(F.lit(" "), id_.cast("string"))).otherwise(""))
    mpn = F.when((id_ % 5).isin(0, 1), F.concat(F.lower("mpn"), F.when(id_ % 11 == 0, "x").otherwise("")))
    return rows.select((id_ * 2 + F.col("k")).alias("pos"), "supplier_id", "class_id", name.alias("name"), mpn.alias("mpn"), F.lit(None).cast("string").alias("item_no"), "attributes", (F.col("price") + F.col("k")).alias("price"))


@register("ingest_identity_resolve", f"with {UPLOAD} select supplier_id, identity, pos, product_id from found_v")
def ingest_identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolve_identity(I.last_of_each(upload(spark, sf_dir)), A.products(spark, sf_dir)).select("supplier_id", "identity", "pos", "product_id")


@register(
    "ingest_upsert",
    f"""with {UPLOAD}, known_v as (select * from (select *, row_number() over (partition by product_id order by pos desc) as m from found_v where product_id is not null) where m = 1)
    select outcome, supplier_id, name, mpn, is_stale, count(*) as n from (
      select 'updated' as outcome, k.supplier_id, k.name, coalesce(k.mpn, p.mpn) as mpn, false as is_stale from known_v k join products_v p using (product_id)
      union all select 'inserted', supplier_id, name, mpn, false from found_v where product_id is null
      union all select 'untouched', supplier_id, name, mpn, is_stale from products_v p where not exists (select 1 from known_v k where k.product_id = p.product_id)) group by all""",
)
def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.upsert(upload(spark, sf_dir), A.products(spark, sf_dir)).groupBy("outcome", "supplier_id", "name", "mpn", "is_stale").agg(F.count("*").alias("n"))


@register(
    "price_change_history",
    """select user_id as product_id, event_id as id, old as price, value as new_price from (select *, lag(value) over (partition by user_id order by ts, event_id) as old from events where value is not null) where old <> value""",
)
def price_change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("product_id"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("ts").alias("observed_at"))
    return I.price_changes(rows)


def _price_update(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prices = A.prices(spark, sf_dir).where("product_id % 4 <> 3").withColumn("observed_at", F.lit(1))
    seen = A.prices(spark, sf_dir).where("product_id % 3 <> 2").select("product_id", (F.col("price") + F.col("product_id") % 2).alias("price"), F.when(F.col("product_id") % 5 == 0, "EUR").alias("currency"), F.lit(2).alias("observed_at"))
    return I.price_upsert(prices, seen)


@register(
    "price_upsert_current",
    """select p_partkey as product_id, case when p_partkey % 3 <> 2 then p_retailprice + p_partkey % 2 else p_retailprice end as price,
    case when p_partkey % 3 <> 2 and p_partkey % 5 = 0 then 'EUR' else 'JOD' end as currency, case when p_partkey % 3 <> 2 then 2 else 1 end as observed_at from part where p_partkey % 4 <> 3 or p_partkey % 3 <> 2""",
)
def price_upsert_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_update(spark, sf_dir)[0]


@register("price_upsert_history", "select p_partkey as product_id, p_retailprice as price, 'JOD' as currency, 1 as observed_at from part where p_partkey % 4 <> 3 and p_partkey % 3 <> 2 and p_partkey % 2 = 1")
def price_upsert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_update(spark, sf_dir)[1]


@register(
    "mark_unseen_stale",
    """select p_partkey as product_id, p_partkey % 10 = 0 or (p_partkey % 9 <> 0 and p_partkey % 4 <> 0 and p_partkey not in (select l_partkey from lineitem where l_quantity > 25)) as is_stale from part""",
)
def mark_unseen_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = A.products(spark, sf_dir).withColumn("canonical_source_url", F.when(F.col("product_id") % 4 == 0, "http://x"))
    seen = A.table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("product_id"))
    return I.mark_unseen(products, seen, F.col("product_id") % 9 != 0).select("product_id", "is_stale")


@register(
    "failure_streak",
    """with o as (select user_id as ingest_id, row_number() over (partition by user_id order by ts, event_id) as chunk_no, event_type <> 'error' as ok from events),
    i as (select *, sum(ok::int) over (partition by ingest_id order by chunk_no) as island from o),
    s as (select *, sum((not ok)::int) over (partition by ingest_id, island order by chunk_no) as streak from i)
    select ingest_id, chunk_no::int as chunk_no, streak::bigint as streak, bool_or(streak >= 3) over (partition by ingest_id order by chunk_no) as stopped from s""",
)
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("ingest_id"), number.alias("chunk_no"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return I.failure_streaks(rows).select("ingest_id", "chunk_no", "streak", "stopped")


@register(
    "chunk_cache_lookup",
    """select count(*) filter (doc_id % 3 = 0 or text in (select text from documents where doc_id % 3 = 0)) as hits, count(distinct case when text not in (select text from documents where doc_id % 3 = 0 and text is not null) then text end) as asked from documents where text is not null""",
)
def chunk_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("chunk"))
    cache = docs.where("doc_id % 3 = 0").select(chunk_key(F.lit("v1"), F.lit("m"), F.col("chunk")).alias("cache_key"), F.lit("{}").alias("response")).dropDuplicates(["cache_key"])
    hits, asked = I.cache_lookup(docs, cache, "v1", "m")
    return hits.agg(F.count("*").alias("hits")).join(asked.agg(F.count("*").alias("asked")))


BAGS = "bags_v as (select p_type as class_id, p_partkey, unnest([{'k': 'size', 'v': p_size::varchar}, {'k': 'brand', 'v': p_brand}, {'k': 'letter', 'v': ['a', 'b', 'f', 'h', 'n'][p_partkey % 5 + 1]}, {'k': 'item_no', 'v': 'I' || p_partkey}, {'k': 'has_fan', 'v': case when p_partkey % 50 = 0 then 'true' end}]) as e from part)"


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "abfhn")), (F.col("p_partkey") % 5 + 1).cast("int"))
    bag = F.create_map(
        F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("letter"), letter, F.lit("item_no"), F.concat(F.lit("I"), F.col("p_partkey").cast("string")), F.lit("has_fan"), F.when(F.col("p_partkey") % 50 == 0, "true")
    )
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("class_id"), bag.alias("attributes"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.definitions(spark, sf_dir).where("name = 'brand'").withColumn("canonical_unit", F.lit(None).cast("string"))


@register(
    "attribute_usage",
    f"""with {BAGS}, v as (select class_id, e.k as key, e.v as value, count(*) as n, min(p_partkey) as f from bags_v where e.v is not null group by all),
    r as (select *, row_number() over (partition by class_id, key order by f, value) as place from v)
    select class_id, key, sum(n)::bigint as used_by, array_to_string(list(value order by place) filter (place <= 8), '|') as values from r group by class_id, key""",
)
def attribute_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.attribute_usage(bags(spark, sf_dir)).withColumn("values", F.array_join("values", "|"))


@register("value_usage_counts", f"with {BAGS}, v as (select class_id, e.k as key, e.v as value, count(*) as n from bags_v where e.v is not null group by all) select * from (select *, count(*) over (partition by class_id, key) as distinct_values from v) where distinct_values between 2 and 40")
def value_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.value_usage(bags(spark, sf_dir))


@register(
    "spec_coverage_share",
    f"""with {BAGS}, s as (select p_type as class_id, count(*) as n_products from part group by 1), v as (select class_id, e.k as key, count(*) as n from bags_v where e.v is not null group by all)
    select class_id, key, n, n_products from v join s using (class_id) where n >= greatest(1, ceil(n_products * 0.05)) and key not in ('item_no', 'brand')""",
)
def spec_coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.missing_specs(bags(spark, sf_dir), known(spark, sf_dir)).select("class_id", "key", "n", "n_products")


@register("infer_datatype", f"with {BAGS} select distinct class_id, e.k as key, case e.k when 'size' then 'numeric' when 'has_fan' then 'bool' else 'text' end as datatype, null::varchar as unit, 'eq' as match_op from bags_v where e.v is not null")
def infer_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inferred_types(bags(spark, sf_dir), known(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("class_id")).distinct()
    one = F.struct(F.lit("size").alias("canonical"), F.array(F.lit("sizes"), F.lit("width")).alias("aliases"))
    return classes.select("class_id", one.alias("g")).select("class_id", "g.*")


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    bag = F.create_map(F.lit("size"), size, F.lit("sizes"), F.concat(size, F.lit(".0")), F.lit("width"), F.when(F.col("p_partkey") % 40 == 0, "999").otherwise(size))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("class_id"), bag.alias("attributes"))


@register(
    "merge_conflicts",
    "select p_type as class_id, 'size' as canonical, alias, bool_or(alias = 'width' and p_partkey % 40 = 0) as conflict from part, (values ('sizes'), ('width')) v(alias) group by p_type, alias",
)
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_conflicts(_twins(spark, sf_dir), _groups(spark, sf_dir))


@register(
    "merge_duplicates",
    "with c as (select p_type, bool_or(p_partkey % 40 = 0) as conflict from part group by 1) select p_partkey as product_id, p_type as class_id, p_size::varchar as size, (case when conflict then 3 else 1 end)::bigint as n_keys from part join c using (p_type)",
)
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.definitions(spark, sf_dir)
    moved, _, _ = I.merge_duplicates(_twins(spark, sf_dir), names, _groups(spark, sf_dir))
    return moved.select("product_id", "class_id", F.element_at("attributes", "size").alias("size"), F.size("attributes").cast("long").alias("n_keys"))


@register("merge_translated", "select p_partkey as product_id, case when p_size % 2 = 0 then '1' else '3' end as phase, 1::bigint as n_keys from part")
def merge_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins that agree only by the value map of their group; every fifth product has the alias alone."""
    one = F.col("p_size") % 2 == 0
    both = F.create_map(F.lit("phase"), F.when(one, "1").otherwise("three"), F.lit("phases"), F.when(one, "Single").otherwise("3"))
    alone = F.create_map(F.lit("phases"), F.when(one, " SINGLE").otherwise("Three"))
    twins = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("class_id"), F.when(F.col("p_partkey") % 5 == 0, alone).otherwise(both).alias("attributes"))
    said = F.create_map(F.lit("single"), F.lit("1"), F.lit("three"), F.lit("3"))
    groups = twins.select("class_id").distinct().select("class_id", F.lit("phase").alias("canonical"), F.array(F.lit("phases")).alias("aliases"), said.alias("value_map"))
    moved, _, _ = I.merge_duplicates(twins, A.definitions(spark, sf_dir), groups)
    return moved.select("product_id", F.element_at("attributes", "phase").alias("phase"), F.size("attributes").cast("long").alias("n_keys"))


@register("repaired_definitions", "select distinct p_type as class_id, v.name, v.datatype, null::varchar as canonical_unit, v.match_op, v.name = 'insulation_class' as ordered from part, (values ('size', 'numeric', 'gte'), ('brand', 'text', 'eq'), ('insulation_class', 'text', 'gte'), ('price', 'numeric', 'lte')) v(name, datatype, match_op)")
def repaired_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = A.definitions(spark, sf_dir).withColumn("canonical_unit", F.lit(None).cast("string"))
    return I.repaired_definitions(stored, I.inferred_types(A.products(spark, sf_dir), stored))
