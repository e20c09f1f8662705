"""Tenders and their states, new classes of an upload, rows of the administration, and links between pages and manuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import identity_token
from ..sources import models

# States of a tender.
UPLOADING, EXTRACTING, MATCHING, DONE, FAILED = "uploading", "extracting", "matching", "done", "failed"
#: Letters and digits of a token that identifies a product, at least.
LEAST_TOKEN = 3


def next_state(status: Column, event: Column) -> Column:
    """DML-2: the state after ``extract``, ``match``, ``matched`` or ``error``. Matching does nothing where it runs or is done; unknown events change nothing."""
    busy = status.isin(MATCHING, DONE)
    return (
        F.when(event == "extract", EXTRACTING)
        .when((event == "match") & ~busy, MATCHING)
        .when((event == "matched") & (status == MATCHING), DONE)
        .when((event == "error") & status.isin(EXTRACTING, MATCHING), FAILED)
        .otherwise(status)
    )


def state_after(events: Column) -> Column:
    """DML-2: the state after all events of a tender in order."""
    return F.aggregate(events, F.lit(UPLOADING), next_state)


def with_states(tenders: DataFrame, events: DataFrame) -> DataFrame:
    """DML-2: tenders with their ``status`` after ``events`` (tender_id, at, event); equal times are ordered by the event's name."""
    said = events.groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("events"))
    status = state_after(F.transform(F.coalesce("events", F.array().cast("array<struct<at:timestamp,event:string>>")), lambda e: e["event"]))
    return tenders.join(said, "tender_id", "left").withColumn("status", status).drop("events")


def new_classes(parsed: DataFrame, classes: DataFrame, definitions: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-7: classes (class_id, name, auto_created) and definitions, with those of class names of ``parsed`` that no class has.

    ``answers`` are those that define a class, by its name in ``class_name`` (without regard to case). A name without a good answer becomes no class.
    The id of a new class is the hash of its name, moved on until it is free.
    """
    asked = parsed.where("class_name is not null and trim(class_name) <> ''").select(F.upper("class_name").alias("k")).distinct()
    asked = asked.join(classes.select(F.upper("name").alias("k")), "k", "left_anti")
    defined = models.class_definitions(answers).withColumn("k", F.upper("class_name")).join(asked, "k", "left_semi")
    named = defined.groupBy("k").agg(F.min("class_name").alias("name"))
    taken = classes.select(F.col("class_id").cast("string").alias("class_id")).distinct()
    first = named.withColumn("class_id", F.sha2("k", 256)).join(taken.withColumn("is_taken", F.lit(True)), "class_id", "left")
    made = first.select("k", "name", F.when(F.col("is_taken"), F.sha2(F.concat("k", F.lit("|2")), 256)).otherwise(F.col("class_id")).alias("class_id"))
    had = classes.select(F.col("class_id").cast("string").alias("class_id"), "name", (F.col("auto_created") if "auto_created" in classes.columns else F.lit(False)).alias("auto_created"))
    rules = defined.join(made.select("k", "class_id"), "k").groupBy("class_id", "name").agg(F.min(F.struct("datatype", "match_op", "canonical_unit", "label")).alias("d")).select("class_id", "name", "d.*")
    known = definitions.select(F.col("class_id").cast("string").alias("class_id"), *(F.col(c) if c in definitions.columns else F.lit(None).cast("string").alias(c) for c in ("name", "datatype", "match_op", "canonical_unit", "label")))
    return had.unionByName(made.select("class_id", "name", F.lit(True).alias("auto_created"))), known.unionByName(rules)


def admin_rows(products: DataFrame, suppliers: DataFrame, classes: DataFrame) -> DataFrame:
    """PRJ-4: products with the names of supplier and class; an empty bag is null, times are ISO texts."""
    out = products.join(suppliers.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id").join(classes.select("class_id", F.col("name").alias("product_class")), "class_id", "left")
    seen = F.date_format("last_observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bag = F.when(F.size("attributes") > 0, F.to_json("attributes"))
    return out.select("product_id", "name", "mpn", "supplier_id", "supplier_name", "product_class", "is_stale", bag.alias("attributes"), seen.alias("last_observed_at"))


def run_rows(runs: DataFrame) -> DataFrame:
    """PRJ-5: runs with their counts and completeness as structs; only a complete run may be reconciled."""
    counts = F.struct(*(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("discovered", "fetched", "failed", "rejected", "retried", "pending")))
    complete = F.struct((F.col("status") == "COMPLETE").alias("can_reconcile"), F.col("completeness_score").alias("score"))
    return runs.select("run_id", "supplier_id", "status", counts.alias("counts"), complete.alias("completeness"), "started_at", "finished_at")


def newest(tenders: DataFrame, user: Column | None = None) -> DataFrame:
    """SRT-6: tenders of a user, or all, newest first, then by id."""
    rows = tenders if user is None else tenders.where(F.col("user_id") == user)
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "tender_id")


def sync_total(results: DataFrame) -> DataFrame:
    """AGG-21: element-wise sum of the results of synced classes."""
    return results.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "fixed", "removed", "merged", "values")))


def converted(rows: DataFrame, units: DataFrame) -> DataFrame:
    """JN-8: rows (value, from_unit, to_unit) with ``value`` in the unit asked for; ``units``: (from_unit, to_unit, factor, addend). A pair that is not there leaves the value. The dimension is ignored."""
    one = units.groupBy("from_unit", "to_unit").agg(F.min(F.struct("factor", "addend")).alias("u"))
    out = rows.join(one, ["from_unit", "to_unit"], "left")
    return out.withColumn("value", F.when(F.col("u").isNotNull() & (F.col("from_unit") != F.col("to_unit")), F.col("value") * F.col("u.factor") + F.col("u.addend")).otherwise(F.col("value"))).drop("u")


def manuals_of(products: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-19: products (page_url, pos, identity) with the first of their page's documents (page_url, doc_pos, url, linked_identity) that is linked to the same token; shorter tokens match nothing."""
    known = products.withColumn("token", identity_token(F.col("identity"))).where(F.length("token") >= LEAST_TOKEN)
    linked = documents.select("page_url", identity_token(F.col("linked_identity")).alias("token"), F.struct("doc_pos", "url").alias("doc")).groupBy("page_url", "token").agg(F.min("doc").alias("doc"))
    return known.join(linked, ["page_url", "token"]).select("page_url", "pos", "identity", F.col("doc.url").alias("manual"))
