"""The domain's tables as views of the driver's tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matching import Scope, scope_of
from ..sources.scratch import Steps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    suppliers = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n_suppliers"))
    letter = F.element_at(F.array(*map(F.lit, "abfhn")), (F.col("p_partkey") % 5 + 1).cast("int"))
    bag = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("insulation_class"), letter)
    return part.join(F.broadcast(suppliers)).select(
        F.col("p_partkey").alias("product_id"),
        (F.col("p_partkey") % F.col("n_suppliers")).alias("supplier_id"),
        F.col("p_type").alias("class_id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("mpn"),
        (F.col("p_partkey") % 10 == 0).alias("is_stale"),
        bag.alias("attributes"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.lit("JOD").alias("currency"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    n = rows.agg(F.count("*").alias("n_suppliers"))
    return rows.join(F.broadcast(n)).select((F.col("s_suppkey") % F.col("n_suppliers")).alias("supplier_id"), F.col("s_name").alias("name"), "s_nationkey", "s_acctbal")


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders with the nation of their customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer.hint("merge"), orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("tender_id"), F.col("c_nationkey").alias("g"))


def scope(spark: SparkSession, sf_dir: str) -> Scope:
    """Suppliers of the customer's nation: tenders and suppliers have their nation, and no tender is written out with each of its suppliers."""
    return scope_of(buyers(spark, sf_dir), suppliers(spark, sf_dir).select(F.col("s_nationkey").alias("g"), "supplier_id"), Steps(spark, "scope"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("size", "numeric", "gte"), ("brand", "text", "eq"), ("insulation_class", "text", "gte"), ("price", "numeric", "lte")]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("datatype"), F.lit(o).alias("match_op")) for n, t, o in rules)))
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("class_id")).distinct().select("class_id", each.alias("d")).select("class_id", "d.*")


def lines(spark: SparkSession, sf_dir: str, scope: Scope | None = None) -> DataFrame:
    """All lines of all orders: the first asks for a name, the second for a part number, the others by specification. With ``scope`` they bring their scope_id along, which they
    meet where they lie by tender to be numbered."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = rows.withColumn("ln", F.row_number().over(order)).select(F.col("l_orderkey").alias("tender_id"), "ln", "l_partkey", "l_quantity")
    own = []
    if scope is not None:
        rows, own = rows.join(scope.tenders.hint("merge"), "tender_id", "left"), ["scope_id"]
    # a compressed table is much larger on the driver than its file; numbered first, lines meet their part with few and short columns
    rows = rows.join(part.select("p_partkey", "p_name", "p_brand", "p_type").hint("merge"), rows.l_partkey == part.p_partkey)
    mpn = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))
    letter = F.element_at(F.array(*map(F.lit, "abfhn")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return rows.select(
        (F.col("tender_id") * 1000 + F.col("ln")).alias("line_id"),
        "tender_id",
        F.col("ln").cast("string").alias("line_no"),
        F.when(F.col("ln") == 1, F.col("p_name")).when(F.col("ln") == 2, mpn).otherwise(F.concat(F.lit("spec "), F.col("l_partkey").cast("string"))).alias("description"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("p_type")).alias("class_id"),
        F.create_map(F.lit("size"), F.col("l_quantity").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("insulation_class"), letter).alias("attributes"),
        *own,
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of products: the kind of event stands for the method of extraction."""
    method = F.create_map(*map(F.lit, ("view", "LISTING_PAGE", "click", "PRODUCT_PAGE", "purchase", "JSON_LD", "signup", "API", "error", "MANUFACTURER_MANUAL")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 20).alias("supplier_id"),
        F.to_date("ts").alias("run"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("dmm-"), F.col("user_id").cast("string"))).alias("mpn"),
        F.concat(F.lit("Meter "), (F.col("user_id") % 50).cast("string")).alias("product_name"),
        F.lit("https://shop.example.com/p").alias("source_url"),
        F.element_at(method, F.col("event_type")).alias("extraction_method"),
        F.least(F.col("value").cast("int"), F.lit(100)).alias("confidence"),
        F.col("value").alias("price"),
        F.col("ts").alias("observed_at"),
    )


SUPPLIERS = "suppliers_v as (select s_suppkey % (select count(*) from supplier) as supplier_id, s_name as name, s_nationkey, s_acctbal from supplier)"
PRODUCTS = """products_v as (
  select p_partkey as product_id, p_partkey % (select count(*) from supplier) as supplier_id, p_type as class_id, p_name as name,
    p_brand || '-' || p_partkey as mpn, p_partkey % 10 = 0 as is_stale, p_size, p_brand, ['a', 'b', 'f', 'h', 'n'][p_partkey % 5 + 1] as letter,
    [105, 130, 155, 180, 200][p_partkey % 5 + 1] as rank, p_retailprice as price
  from part)"""
SCOPE = f"""{SUPPLIERS}, scope_v as (
  select o_orderkey as tender_id, supplier_id from orders join customer on o_custkey = c_custkey join suppliers_v on s_nationkey = c_nationkey)"""
LINES = """lines_v as (
  select l_orderkey * 1000 + ln as line_id, l_orderkey as tender_id, ln, l_quantity as qty, case when l_partkey % 17 <> 0 then p_type end as class_id,
    case when ln = 1 then p_name when ln = 2 then p_brand || '-' || p_partkey else 'spec ' || l_partkey end as description, p_brand as brand,
    ['a', 'b', 'f', 'h', 'n'][p_partkey % 5 + 1] as letter, [105, 130, 155, 180, 200][p_partkey % 5 + 1] as rank
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as ln from lineitem)
  join part on l_partkey = p_partkey)"""
EXACT = """exact_v as (
  select line_id, arg_min(product_id, kind * 1000000000000 + product_id) as product_id from (
    select l.line_id, l.tender_id, p.product_id, p.supplier_id, 0 as kind from lines_v l join products_v p on upper(l.description) = upper(p.name)
    union all
    select l.line_id, l.tender_id, p.product_id, p.supplier_id, 1 as kind from lines_v l join products_v p on upper(l.description) = upper(p.mpn)) h
  where exists (select 1 from scope_v s where s.tender_id = h.tender_id and s.supplier_id = h.supplier_id)
  group by line_id)"""
PAIRS = """pairs_v as (
  select l.line_id, p.product_id, p.price,
    case when p.p_size >= l.qty then 1 else 0 end as ok_size, case when p.p_brand = l.brand then 1 else 0 end as ok_brand, case when p.rank >= l.rank then 1 else 0 end as ok_class,
    (100 * ((p.p_size >= l.qty)::int + (p.p_brand = l.brand)::int + (p.rank >= l.rank)::int)) // 3 as score
  from lines_v l join scope_v s using (tender_id) join products_v p on p.supplier_id = s.supplier_id and p.class_id = l.class_id and not p.is_stale
  where l.class_id is not null and not exists (select 1 from exact_v e where e.line_id = l.line_id))"""
TOP = """top_v as (
  select * from (select *, row_number() over (partition by line_id order by score desc, product_id) as place from pairs_v where score > 0)
  where place = 1 or (place <= 6 and score >= 40))"""
MATCH = """match_v as (
  select l.line_id, l.tender_id, coalesce(e.product_id, t.product_id) as product_id,
    case when e.line_id is not null then 'exact' when l.class_id is not null then 'spec' end as match_type,
    case when e.line_id is not null then 100 else coalesce(t.score, 0) end as score
  from lines_v l left join exact_v e using (line_id) left join top_v t on t.line_id = l.line_id and t.place = 1)"""
ALL = f"with {PRODUCTS}, {SCOPE}, {LINES}, {EXACT}, {PAIRS}, {TOP}, {MATCH}"
OBSERVATIONS = """observations_v as (
  select event_id as id, user_id % 20 as supplier_id, ts::date as run, case when user_id % 3 <> 0 then 'dmm-' || user_id end as mpn, 'Meter ' || (user_id % 50) as product_name,
    'https://shop.example.com/p' as source_url,
    case event_type when 'view' then 'LISTING_PAGE' when 'click' then 'PRODUCT_PAGE' when 'purchase' then 'JSON_LD' when 'signup' then 'API' when 'error' then 'MANUFACTURER_MANUAL' end as extraction_method,
    least(trunc(value)::int, 100) as confidence, value as price, ts as observed_at
  from events)"""
