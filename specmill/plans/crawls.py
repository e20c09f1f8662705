"""Queries on crawls and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl as C
from ..sources import pages as S
from . import adapter as A
from .registry import register

KEY = "case when mpn is not null then 'mpn:DMM' || substr(mpn, 5) else 'fallback:' || sha256('meter ' || substr(product_name, 7) || '||' || source_url) end"
RANK = "case extraction_method when 'JSON_LD' then 5 when 'API' then 4 when 'PRODUCT_PAGE' then 3 when 'LISTING_PAGE' then 2 when 'MANUFACTURER_MANUAL' then 1 else 0 end"
MERGED = f"""{A.OBSERVATIONS}, keyed_v as (select *, {KEY} as identity_key from observations_v),
merged_v as (
  select * from (select *, count(*) over (partition by supplier_id, identity_key) as n_merged, row_number() over (partition by supplier_id, identity_key order by {RANK} desc, coalesce(confidence, 0) desc, observed_at desc, id desc) as n from keyed_v) where n = 1)"""


@register("observation_merge", f"with {MERGED} select supplier_id, identity_key, id, extraction_method, confidence, price, n_merged from merged_v")
def observation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.merge_observations(C.with_identity(A.observations(spark, sf_dir)))
    return merged.select("supplier_id", "identity_key", "id", "extraction_method", "confidence", "price", "n_merged")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue from customers: some have keys that are seen, some only numbers, some keys that are not seen."""
    k = F.col("c_custkey")
    mpn = F.concat(F.lit("DMM-"), k.cast("string"))
    return A.table(spark, sf_dir, "customer").select(
        k.alias("product_id"), (k % 20).alias("supplier_id"), F.col("c_name").alias("name"), F.when(k % 5 != 0, mpn).alias("mpn"),
        F.when(k % 2 == 0, F.concat(F.lit("mpn:DMM"), k.cast("string"))).alias("identity_key"), F.lit(None).cast("string").alias("canonical_source_url"), F.lit(None).cast("timestamp_ntz").alias("last_observed_at"),
        (k % 2).cast("int").alias("crawl_miss_count"), F.lit(False).alias("crawler_stale"),
    )


@register(
    "reconcile_upsert",
    f"""with {MERGED}, stored_v as (select c_custkey as product_id, c_custkey % 20 as supplier_id, c_name as name, case when c_custkey % 5 <> 0 then 'DMM-' || c_custkey end as mpn, case when c_custkey % 2 = 0 then 'mpn:DMM' || c_custkey end as identity_key, c_custkey % 2 as misses from customer),
    found_v as (select m.*, coalesce((select min(product_id) from stored_v s where s.supplier_id = m.supplier_id and s.identity_key = m.identity_key),
      case when m.mpn is not null then (select min(product_id) from stored_v s where s.supplier_id = m.supplier_id and upper(s.mpn) = upper(m.mpn)) end) as found from merged_v m)
    select outcome, supplier_id, name, mpn, identity_key, misses::int as crawl_miss_count, misses >= 2 as crawler_stale from (
      select 'updated' as outcome, supplier_id, product_name as name, mpn, identity_key, 0 as misses from found_v where found is not null
      union all select 'inserted', supplier_id, product_name, mpn, identity_key, 0 from found_v where found is null
      union all select case when identity_key is not null then 'missed' else 'untouched' end, supplier_id, name, mpn, identity_key, case when identity_key is not null then misses + 1 else misses end
        from stored_v where product_id not in (select found from found_v where found is not null) and supplier_id in (select supplier_id from merged_v)
      union all select 'untouched', supplier_id, name, mpn, identity_key, misses from stored_v where product_id not in (select found from found_v where found is not null) and supplier_id not in (select supplier_id from merged_v))""",
)
def reconcile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.merge_observations(C.with_identity(A.observations(spark, sf_dir)))
    return C.reconcile(merged, stored(spark, sf_dir)).select("outcome", "supplier_id", "name", "mpn", "identity_key", "crawl_miss_count", "crawler_stale")


@register(
    "miss_streak_stale",
    f"""with {A.OBSERVATIONS}, k as (select *, {KEY} as identity_key from observations_v), r as (select distinct supplier_id, run from k), seen as (select distinct supplier_id, identity_key, run from k),
    g as (select f.supplier_id, f.identity_key, r.run from (select supplier_id, identity_key, min(run) as first from k group by all) f join r on r.supplier_id = f.supplier_id and r.run >= f.first),
    h as (select g.*, s.run is not null as hit from g left join seen s using (supplier_id, identity_key, run)),
    l as (select *, max(case when hit then run end) over (partition by supplier_id, identity_key order by run) as last from h),
    m as (select supplier_id, identity_key, run, count(*) filter (not hit) over (partition by supplier_id, identity_key, last order by run) as misses from l)
    select supplier_id, identity_key, run::varchar as run, misses::int as misses, misses >= 2 as stale from m""",
)
def miss_streak_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_identity(A.observations(spark, sf_dir))
    return C.miss_streaks(rows, rows).withColumn("run", F.col("run").cast("string"))


def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of runs, from events: the run is the user."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "CLAIMED", "RETRY", "EXTRACTED", "SKIPPED", "FAILED", "REJECTED", "EXTRACTED"))), (k % 8 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select(
        k.alias("id"), F.col("user_id").alias("run_id"), F.when((F.col("user_id") % 3 == 0) & (k % 8 < 3), "EXTRACTED").otherwise(status).alias("status"), (k % 100).cast("int").alias("priority"), F.col("ts").alias("created_at"),
        F.when(k % 3 == 0, F.col("ts")).alias("next_attempt_at"), F.col("ts").alias("claimed_at"), (k % 7 == 0).alias("required_partition"), (k % 4).cast("int").alias("attempt_count"), F.concat(F.lit("https://s"), (k % 9).cast("string"), F.lit(".example.com/p/"), k.cast("string")).alias("url"),
    )


URLS = """urls_v as (
  select event_id as id, user_id as run_id, case when user_id % 3 = 0 and event_id % 8 < 3 then 'EXTRACTED' else ['PENDING', 'CLAIMED', 'RETRY', 'EXTRACTED', 'SKIPPED', 'FAILED', 'REJECTED', 'EXTRACTED'][event_id % 8 + 1] end as status,
    event_id % 100 as priority, ts, case when event_id % 3 = 0 then ts end as next_at, event_id % 7 = 0 as required, event_id % 4 as attempts from events)"""
NOW = "2024-01-16 00:00:00"


@register("frontier_claim", f"with {URLS} select run_id, id, place::int as place from (select *, row_number() over (partition by run_id order by priority desc, ts, id) as place from urls_v where status = 'PENDING' or (status = 'RETRY' and (next_at is null or next_at <= timestamp '{NOW}'))) where place <= 10")
def frontier_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim(crawl_urls(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), 10).select("run_id", "id", "place")


@register("abandoned_claims", f"with {URLS} select id, case when status = 'CLAIMED' and ts < timestamp '{NOW}' - interval 10 minutes then 'PENDING' else status end as status, status = 'CLAIMED' and ts < timestamp '{NOW}' - interval 10 minutes as released from urls_v")
def abandoned_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.release_abandoned(crawl_urls(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "released")


@register(
    "crawl_completeness",
    f"""with {URLS}, s as (select run_id, count(*) filter (status in ('PENDING', 'CLAIMED', 'RETRY')) as blocking, count(*) filter (required and status not in ('EXTRACTED', 'SKIPPED')) as required_open from urls_v group by 1),
    r as (select *, case when run_id % 10 = 9 then 'run is FAILED' when blocking > 0 then 'addresses are open' when run_id % 15 = 6 then 'score is below 100' when required_open > 0 then 'required partitions are open' end as reason from s)
    select run_id, blocking, required_open, reason is null as can_reconcile, reason from r""",
)
def crawl_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = crawl_urls(spark, sf_dir)
    runs = urls.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 10 == 9, "FAILED").otherwise("COMPLETE").alias("status"), F.when(F.col("run_id") % 15 == 6, 80).alias("completeness_score"))
    return C.completeness(runs, urls)


@register(
    "frontier_admit",
    """with l as (select user_id as run_id, 'https://s' || (event_id % 9) || '.example.com/p/' || (event_id % 50) as url, event_id % 9 as h, event_id % 12 as depth, event_id % 100 as priority from events),
    ok as (select * from l where (h = run_id % 9 or h = 3) and depth + 1 <= 10), k as (select distinct run_id, url from l where priority % 10 = 0)
    select run_id, url, (min(depth) + 1)::int as depth, max(priority)::int as priority from ok where (run_id, url) not in (select run_id, url from k) group by all""",
)
def frontier_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    links = A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("https://s"), (k % 9).cast("string"), F.lit(".example.com/p/"), (k % 50).cast("string")).alias("url"),
        F.concat(F.lit("S"), (F.col("user_id") % 9).cast("string"), F.lit(".example.com")).alias("own_host"), F.array(F.lit("s3.example.com")).alias("allowed_hosts"), (k % 12).cast("int").alias("depth"), (k % 100).cast("int").alias("priority"),
    )
    return C.admit(links, links.where("priority % 10 = 0"), 10)


@register(
    "url_transitions",
    f"""with {URLS} select id, case when id % 5 = 0 then case when id % 2 = 0 then 'EXTRACTED' else 'SKIPPED' end when id % 5 in (1, 2) then 'REJECTED' when id % 5 = 3 and attempts < 3 then 'RETRY' else 'FAILED' end as status from urls_v""",
)
def url_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("OK", "POLICY", "ROBOTS", "RETRYABLE", "ERROR"))), (F.col("id") % 5 + 1).cast("int"))
    return crawl_urls(spark, sf_dir).select("id", C.transition(outcome, F.col("attempt_count"), F.lit(3), F.col("id") % 2 == 0).alias("status"))


@register(
    "crawl_counters",
    f"""with {URLS}, {A.OBSERVATIONS} select run_id, count(*) filter (status = 'EXTRACTED') as extracted, count(*) filter (status = 'FAILED') as failed, sum(greatest(attempts - 1, 0))::bigint as retries,
    (select count(*) from events e where e.user_id = run_id) as observations, (select count(*) from events e where e.user_id = run_id and event_type = 'purchase') as json_ld from urls_v group by run_id""",
)
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id")).join(A.observations(spark, sf_dir), "id")
    return C.counters(crawl_urls(spark, sf_dir), seen).select("run_id", "extracted", "failed", "retries", "observations", "json_ld")


@register(
    "run_states",
    f"""with {URLS} select run_id, case when run_id % 11 = 0 then 'CANCELLED' when run_id % 7 = 0 then 'PARTIAL' when count(*) filter (status in ('PENDING', 'CLAIMED')) > 0 then 'CRAWLING' when count(*) filter (status = 'RETRY') > 0 then 'WAITING' else 'COMPLETE' end as state from urls_v group by 1""",
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    elapsed = F.when(F.col("run_id") % 7 == 0, 99).otherwise(1)
    return C.run_state(crawl_urls(spark, sf_dir), elapsed, F.lit(15), F.lit(50_000), F.col("run_id") % 11 == 0).select("run_id", "state")


@register(
    "suppliers_due_refresh",
    "select s_suppkey as supplier_id from supplier where (s_suppkey % 4 = 0 or s_suppkey % 20 > 7) and s_suppkey % 6 <> 1",
)
def suppliers_due_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    k = F.col("s_suppkey")
    rows = A.table(spark, sf_dir, "supplier").select(k.alias("supplier_id"), F.when(k % 4 != 0, now - F.make_dt_interval(days=(k % 20).cast("int"))).alias("last_scraped_at"))
    return C.due_suppliers(rows, rows.where("supplier_id % 6 = 1"), now).select("supplier_id")


@register("runs_top_n", "select supplier_id, run_id, place::int as place from (select o_custkey as supplier_id, o_orderkey as run_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders) where place <= 5")
def runs_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("supplier_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return C.newest_runs(runs, 5).select("supplier_id", "run_id", "place")


@register(
    "observation_validate",
    "select p_partkey from part where p_partkey % 11 <> 0 and p_size between 0 and 40 and p_partkey % 7 <> 0 and p_partkey % 5 <> 0",
)
def observation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = A.table(spark, sf_dir, "part").select(
        "p_partkey", k.alias("page_id"), F.when(k % 11 != 0, F.col("p_name")).otherwise(" ").alias("name"), F.lit("d").alias("description"), (F.col("p_size") + 60).alias("confidence"),
        F.when(k % 7 == 0, "-1").otherwise(F.col("p_retailprice").cast("string")).alias("price"), F.when(k % 2 == 0, "usd").otherwise("JOD").alias("currency"), F.lit("AB-1").alias("mpn"),
        F.when(k % 3 == 0, "http://x/m.pdf").alias("manual_link"), F.when(k % 5 == 0, "other").otherwise("ab 1").alias("manual_identity"), F.array(F.lit("http://x/m.pdf")).alias("documents"),
    ).withColumn("manual_link", F.when((k % 5 == 0) | F.col("manual_link").isNotNull(), "http://x/m.pdf"))
    return C.valid_observations(rows).select("p_partkey")


@register("run_seeds", "select s_suppkey as run_id, 'https://s' || s_suppkey || '.example.com' || p as url, n as priority from supplier, (values ('/', 100), ('/sitemap.xml', 75), ('/robots.txt', 50)) v(p, n)")
def run_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com/shop")).alias("website"))
    return C.seeds(runs).select("run_id", "url", "priority")


@register(
    "supplier_get_or_create",
    "select upper(n) as name, min(s_suppkey) is null as created from (select distinct case when s_suppkey % 2 = 0 then upper(s_name) else s_name || ' ltd' end as n from supplier) w left join supplier on upper(s_name) = upper(n) group by upper(n)",
)
def supplier_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier")
    wanted = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.concat("s_name", F.lit(" ltd"))).alias("name"))
    return C.get_or_create(wanted, s.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"))).select(F.upper("name").alias("name"), "created")


@register("cascade_delete", "select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.cascade_delete(A.table(spark, sf_dir, "lineitem").select("l_orderkey"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("page_parse")
def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full parse of every page; held against fixtures in tests, since SQL reads no markup."""
    parsed = S.parse_pages(A.table(spark, sf_dir, "pages"))
    return parsed.select("page_id", "title", "canonical_url", F.size("links").alias("n_links"), F.size("text_blocks").alias("n_blocks"), F.length("visible_text").alias("n_chars"), "has_arabic")
