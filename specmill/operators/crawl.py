"""Crawls: frontier, outcomes of addresses, completeness, merging of observations, reconciliation with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import CURRENCIES, DEFAULT_CURRENCY, blank_to_null, crawl_identity, identity_token, page_price
from ..functions.text import claimable
from ..functions.url import host_allowed, url_host

# Authority of the ways of extraction.
METHOD_RANK = {"JSON_LD": 5, "API": 4, "PRODUCT_PAGE": 3, "LISTING_PAGE": 2, "MANUFACTURER_MANUAL": 1}
STALE_AFTER, MOST_PER_PAGE = 2, 500
CLAIM_MINUTES, REFRESH_DAYS = 10, 7
# Priorities of the seeds of a run.
SEED_PRIORITY = {"/": 100, "/sitemap.xml": 75, "/robots.txt": 50}


def method_rank(method: Column) -> Column:
    out = F.lit(0)
    for name, rank in METHOD_RANK.items():
        out = F.when(method == name, rank).otherwise(out)
    return out


def with_identity(observations: DataFrame) -> DataFrame:
    """SCA-17 on observations."""
    class_name = F.col("class_name") if "class_name" in observations.columns else F.lit(None).cast("string")
    return observations.withColumn("identity_key", crawl_identity(F.col("product_name"), F.col("mpn"), class_name, F.col("source_url")))


def merge_observations(observations: DataFrame, by: tuple[str, ...] = ("supplier_id", "identity_key")) -> DataFrame:
    """AGG-13, AGG-14: the winning row of each group as a whole: by method, confidence, time, and the larger id at last."""
    order = F.struct(method_rank(F.col("extraction_method")), F.coalesce("confidence", F.lit(0)), "observed_at", "id")
    row = F.struct(*(c for c in observations.columns if c not in by))
    return observations.groupBy(*by).agg(F.max_by(row, order).alias("r"), F.count("*").alias("n_merged")).select(*by, "r.*", "n_merged")


def reconcile(merged: DataFrame, products: DataFrame) -> DataFrame:
    """JN-11, JN-12, DML-16: the suppliers' products after a complete run, with ``outcome``: inserted, updated, missed, untouched.

    A group meets the product of its key, or else, if it has a part number, one of the same number whatever its key (the
    smallest id). Being seen clears misses and crawl staleness, never ``is_stale``; a product with a key that was not seen counts a
    miss and is stale from the second on; one without a key is left alone. New rows get an id from a hash of supplier and key.
    """
    by_key = products.where("identity_key is not null").groupBy("supplier_id", "identity_key").agg(F.min("product_id").alias("by_key"))
    by_mpn = products.where("mpn is not null").groupBy("supplier_id", F.upper("mpn").alias("upper_mpn")).agg(F.min("product_id").alias("by_mpn"))
    rows = merged.withColumn("upper_mpn", F.when(F.col("identity_key").startswith("mpn:"), F.upper("mpn")))
    rows = rows.join(by_key, ["supplier_id", "identity_key"], "left").join(by_mpn, ["supplier_id", "upper_mpn"], "left").withColumn("found", F.coalesce("by_key", "by_mpn"))
    # two groups may meet one product through its number; the smaller key takes it
    last = F.row_number().over(Window.partitionBy("found").orderBy("identity_key"))
    known = rows.where("found is not null").withColumn("n", last).where("n = 1")
    common = ["supplier_id", F.col("product_name").alias("name"), "mpn", "identity_key", F.col("source_url").alias("canonical_source_url"), F.col("observed_at").alias("last_observed_at"), F.lit(0).alias("crawl_miss_count"), F.lit(False).alias("crawler_stale")]
    updated = known.select(F.col("found").alias("product_id"), *common, F.lit("updated").alias("outcome"))
    new_id = F.xxhash64(F.col("supplier_id").cast("string"), "identity_key")
    inserted = rows.where("found is null").select(new_id.alias("product_id"), *common, F.lit("inserted").alias("outcome"))
    runs = merged.select("supplier_id").distinct().withColumn("ran", F.lit(True))
    rest = products.join(updated.select("product_id"), "product_id", "left_anti").join(runs, "supplier_id", "left")
    missed = F.coalesce("ran", F.lit(False)) & F.col("identity_key").isNotNull()
    count = F.coalesce("crawl_miss_count", F.lit(0)) + 1
    rest = rest.select(
        "product_id", "supplier_id", "name", "mpn", "identity_key", "canonical_source_url", "last_observed_at",
        F.when(missed, count).otherwise(F.col("crawl_miss_count")).alias("crawl_miss_count"), F.when(missed, count >= STALE_AFTER).otherwise(F.col("crawler_stale")).alias("crawler_stale"),
        F.when(missed, "missed").otherwise("untouched").alias("outcome"),
    )
    return updated.unionByName(inserted).unionByName(rest)


def miss_streaks(seen: DataFrame, runs: DataFrame) -> DataFrame:
    """WIN-5: replay over runs: for each identity and run from its first sighting on, the misses since the last one, and staleness.

    ``seen``: (supplier_id, identity_key, run); ``runs``: (supplier_id, run) of complete runs.
    """
    known = seen.groupBy("supplier_id", "identity_key").agg(F.min("run").alias("first"))
    grid = known.join(runs.select("supplier_id", "run").distinct(), "supplier_id").where("run >= first")
    grid = grid.join(seen.select("supplier_id", "identity_key", "run").distinct().withColumn("hit", F.lit(1)), ["supplier_id", "identity_key", "run"], "left")
    order = Window.partitionBy("supplier_id", "identity_key").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = grid.withColumn("island", F.sum(F.coalesce("hit", F.lit(0))).over(order))
    inside = Window.partitionBy("supplier_id", "identity_key", "island").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = island.withColumn("misses", (F.count("*").over(inside) - 1).cast("int"))
    return out.select("supplier_id", "identity_key", "run", "misses", (F.col("misses") >= STALE_AFTER).alias("stale"))


def completeness(runs: DataFrame, urls: DataFrame) -> DataFrame:
    """DML-17, AGG-15, AGG-16: whether a run may be reconciled, and the first reason why not."""
    state = urls.groupBy("run_id").agg(
        F.count_if(F.col("status").isin("PENDING", "CLAIMED", "RETRY")).alias("blocking"),
        F.count_if(F.col("required_partition") & ~F.col("status").isin("EXTRACTED", "SKIPPED")).alias("required_open"),
    )
    out = runs.join(state, "run_id", "left").na.fill(0, ["blocking", "required_open"])
    reason = (
        F.when(F.col("status") != "COMPLETE", F.concat(F.lit("run is "), F.col("status")))
        .when(F.col("blocking") > 0, "addresses are open")
        .when(F.coalesce("completeness_score", F.lit(100)) < 100, "score is below 100")
        .when(F.col("required_open") > 0, "required partitions are open")
    )
    return out.select("run_id", "blocking", "required_open", reason.isNull().alias("can_reconcile"), reason.alias("reason"))


def claim(urls: DataFrame, now: Column, batch: int) -> DataFrame:
    """FLT-6, WIN-2, SRT-5: the next addresses of each run, by priority, age and id."""
    order = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("priority"), "created_at", "id"))
    return urls.where(claimable(F.col("status"), F.col("next_attempt_at"), now)).withColumn("place", order).where(F.col("place") <= batch)


def release_abandoned(urls: DataFrame, now: Column, minutes: int = CLAIM_MINUTES) -> DataFrame:
    """FLT-7: claims older than ten minutes are open again."""
    old = (F.col("status") == "CLAIMED") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return urls.withColumn("released", F.coalesce(old, F.lit(False))).withColumn("status", F.when(F.col("released"), "PENDING").otherwise(F.col("status")))


def admit(links: DataFrame, known: DataFrame, most_depth: int) -> DataFrame:
    """FLT-8, SET-1: new addresses of the frontier: of the supplier's or an allowed host, not too deep, not known; the least deep of equal ones.

    ``links``: (run_id, url, own_host, allowed_hosts, depth, priority).
    """
    host = url_host(F.col("url"))
    ok = links.where(F.col("url").rlike("^https?://") & host_allowed(host, F.col("own_host"), F.col("allowed_hosts")) & (F.col("depth") + 1 <= most_depth))
    one = ok.groupBy("run_id", "url").agg(F.min("depth").alias("depth"), F.max("priority").alias("priority"))
    return one.join(known.select("run_id", "url"), ["run_id", "url"], "left_anti").withColumn("depth", F.col("depth") + 1)


def transition(outcome: Column, attempts: Column, most_attempts: Column, extracted: Column) -> Column:
    """DML-19: state of an address after a visit."""
    return (
        F.when(outcome == "OK", F.when(extracted, "EXTRACTED").otherwise("SKIPPED"))
        .when(outcome.isin("POLICY", "ROBOTS"), "REJECTED")
        .when((outcome == "RETRYABLE") & (attempts < most_attempts), "RETRY")
        .otherwise("FAILED")
    )


def run_state(urls: DataFrame, elapsed_minutes: Column, most_minutes: Column, most_urls: Column, cancelled: Column) -> DataFrame:
    """DML-18: state of each run: cancelled, cut short by its limits, at work, waiting for retries, or complete. Claimed addresses are work left."""
    state = urls.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("PENDING", "CLAIMED")).alias("work"), F.count_if(F.col("status") == "RETRY").alias("waiting"))
    status = F.when(cancelled, "CANCELLED").when((elapsed_minutes > most_minutes) | (F.col("n") > most_urls), "PARTIAL").when(F.col("work") > 0, "CRAWLING").when(F.col("waiting") > 0, "WAITING").otherwise("COMPLETE")
    return state.withColumn("state", status)


def counters(urls: DataFrame, observations: DataFrame) -> DataFrame:
    """AGG-17, SNK-5: counts of a run, computed anew from its rows."""
    visits = urls.groupBy("run_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("EXTRACTED", "SKIPPED", "FAILED", "REJECTED", "RETRY", "PENDING")), F.sum(F.greatest(F.col("attempt_count") - 1, F.lit(0))).alias("retries"))
    yields = observations.groupBy("run_id").agg(F.count("*").alias("observations"), *(F.count_if(F.col("extraction_method") == m).alias(m.lower()) for m in METHOD_RANK))
    return visits.join(yields, "run_id", "left").na.fill(0)


def due_suppliers(suppliers: DataFrame, active: DataFrame, now: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """FLT-5, JN-18: suppliers never read or not for a week, without a run at work."""
    old = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < now - F.make_dt_interval(days=F.lit(days)))
    return suppliers.where(old).join(active.select("supplier_id").distinct(), "supplier_id", "left_anti")


def newest_runs(runs: DataFrame, most: int = 100) -> DataFrame:
    """WIN-3."""
    order = F.row_number().over(Window.partitionBy("supplier_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.withColumn("place", order).where(F.col("place") <= most)


def seeds(runs: DataFrame) -> DataFrame:
    """DML-20: the first addresses of a run: home, site map, robots."""
    site = F.regexp_extract("website", r"^(https?://[^/?#]+)", 1)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(n).alias("priority")) for p, n in SEED_PRIORITY.items())))
    return runs.select("run_id", site.alias("site"), each.alias("s")).where("site <> ''").select("run_id", F.concat("site", "s.path").alias("url"), "s.priority", F.lit(0).alias("depth"), F.lit("PENDING").alias("status"))


def retry_failed(urls: DataFrame) -> DataFrame:
    """DML-20: failed addresses are open again, their attempts forgotten."""
    failed = F.col("status") == "FAILED"
    return urls.withColumn("attempt_count", F.when(failed, 0).otherwise(F.col("attempt_count"))).withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status")))


def valid_observations(rows: DataFrame) -> DataFrame:
    """FN-4, SET-2: rows of a model or page that may be kept: name and description, confidence of 0 to 100, no negative price,
    a price only with a known currency, a manual only of the page's documents and of the same identity; a page with too many gives none."""
    price = F.col("price")
    has_price = price.isNotNull()
    manual = F.col("manual_link").isNull() | (F.array_contains("documents", F.col("manual_link")) & (F.col("manual_identity").isNull() | (identity_token(F.col("manual_identity")) == identity_token(F.coalesce("mpn", "name")))))
    good = (
        blank_to_null(F.col("name")).isNotNull()
        & blank_to_null(F.col("description")).isNotNull()
        & F.col("confidence").between(0, 100)
        & (~has_price | (page_price(price).isNotNull() & F.coalesce(F.upper("currency").isin(*CURRENCIES), F.lit(False))))
        & F.coalesce(manual, F.lit(False))
    )
    many = F.count("*").over(Window.partitionBy("page_id"))
    return rows.where(good).withColumn("on_page", many).where(F.col("on_page") <= MOST_PER_PAGE).drop("on_page")


def cascade_delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """DML-21: rows whose parent stays."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def get_or_create(wanted: DataFrame, suppliers: DataFrame) -> DataFrame:
    """DML-21, FLT-2: suppliers by name without regard to case; new ones get an id from a hash of the name."""
    have = suppliers.groupBy(F.upper("name").alias("k")).agg(F.min("supplier_id").alias("supplier_id"))
    new = wanted.select("name").withColumn("k", F.upper("name")).groupBy("k").agg(F.min("name").alias("name"))
    return new.join(have, "k", "left").select(F.coalesce("supplier_id", F.xxhash64("k")).alias("supplier_id"), "name", F.col("supplier_id").isNull().alias("created"))


def default_currency(c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULT_CURRENCY))
