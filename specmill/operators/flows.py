"""Whole flows: a catalogue upload, a tender, the repair of class schemas, and retrieval by several rankings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.attrs import canonicalize, normalize_units, replace_values, split_accessories
from ..sources import models
from . import ingest


def class_maps(definitions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """JN-13, JN-14: per class maps of units, key aliases and value aliases; one small row a class.

    ``definitions``: (class_id, name, canonical_unit, value_aliases); ``aliases``: (class_id, alias, canonical_name).
    """
    pairs = lambda c: F.map_from_entries(F.collect_list(c))
    empty = F.create_map().cast("map<string,map<string,string>>")
    values = F.col("value_aliases") if "value_aliases" in definitions.columns else F.lit(None).cast("map<string,string>")
    # a map may hold a key once only: of several definitions of a name, or aliases of one spelling, one counts
    once = definitions.withColumn("_values", values).groupBy("class_id", "name").agg(F.min("canonical_unit").alias("canonical_unit"), F.max_by("_values", F.to_json("_values")).alias("_values"))
    out = once.groupBy("class_id").agg(
        pairs(F.when(F.col("canonical_unit").isNotNull(), F.struct("name", "canonical_unit"))).alias("units"), F.coalesce(pairs(F.when(F.col("_values").isNotNull(), F.struct("name", "_values"))), empty).alias("value_maps")
    )
    if aliases is None:
        return out.withColumn("key_map", F.create_map().cast("map<string,string>"))
    keys = aliases.groupBy("class_id", "alias").agg(F.min("canonical_name").alias("canonical_name")).groupBy("class_id").agg(pairs(F.struct("alias", "canonical_name")).alias("key_map"))
    return out.join(keys, "class_id", "left").withColumn("key_map", F.coalesce("key_map", F.create_map().cast("map<string,string>")))


def canonical_rows(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """SCA-9 and SCA-6 on rows (class_id, attributes); rows of classes without definitions keep their bag."""
    out = rows.join(maps, "class_id", "left")
    # in two steps: functions of functions nested so deep are beyond the analyzer
    out = out.withColumn("_bag", canonicalize(F.col("attributes"), F.col("key_map"), F.col("value_maps")))
    out = out.withColumn("attributes", F.when(F.col("units").isNotNull(), normalize_units(F.col("_bag"), F.col("units"))).otherwise(F.col("attributes")))
    return out.drop("units", "value_maps", "key_map", "_bag")


def upload(docs: DataFrame, answers: DataFrame, classes: DataFrame, maps: DataFrame, supplier_id: int) -> DataFrame:
    """DML-6: documents to parsed products in the order of their chunks: (supplier_id, pos, class_id, name, mpn, item_no, attributes, price, currency, capped).

    ``answers`` are those to the chunks, by chunk key; a chunk whose answer failed gives no product and is counted by ``run_log``. ``capped`` tells
    that the document goes on behind its last chunk.
    """
    chunks = ingest.chunk_documents(docs).withColumn("prompt_key", F.sha2("chunk", 256))
    parsed = chunks.join(models.parsed_products(answers), "prompt_key").withColumn("supplier_id", F.lit(supplier_id).cast("long"))
    known = models.classified_lines(parsed, classes).withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no", "pos"))
    made = canonical_rows(known.withColumn("pos", order), maps)
    return made.select("supplier_id", "pos", "class_id", "name", "mpn", F.element_at("attributes", "item_no").alias("item_no"), "attributes", "price", "currency", "capped")


#: Fixed value: failures after which every further call fails too.
FATAL = r"LLM API error (400|401|403)\b"
OUTCOME = "doc_id long, chunk_no int, prompt_key string, response string, truncated boolean, error string, status string"


def ask_in_waves(chunks: DataFrame, client: models.Client, parallelism: int = 4, limit: int = ingest.FATAL_STREAK) -> DataFrame:
    """DML-6, WIN-7: (doc_id, chunk_no, chunk) as outcomes: ok, incomplete, failed or stopped, one row a chunk.

    Chunks of a document are asked in waves of ``parallelism`` and settled in their order. A fatal failure, or ``limit`` failures in a row, stops
    the document: what follows is not asked, or dropped if its wave was, and stands as ``stopped``. Documents do not affect each other.
    Documents follow each other in a task, which holds the chunks of one wave; its threads serve all of them.
    """

    def one(chunk: str) -> tuple[str | None, bool, str | None]:
        try:
            response, truncated = client("products", chunk)
            return response, truncated, None
        except Exception as e:  # a failed call is the outcome of its chunk
            return None, False, f"{type(e).__name__}: {e}"[:300]

    def settle(pool: ThreadPoolExecutor, wave: list[tuple], state: list) -> list[tuple]:
        """Outcomes of a wave; ``state``: failures in a row, and whether the document is stopped."""
        said = [(None, False, None)] * len(wave) if state[1] else map(one, [wave[0][3]]) if len(wave) == 1 else pool.map(one, [w[3] for w in wave])
        rows = []
        for (doc_id, chunk_no, key, _), (response, truncated, error) in zip(wave, said, strict=True):
            if state[1]:
                rows.append((doc_id, chunk_no, key, None, False, None, "stopped"))
                continue
            rows.append((doc_id, chunk_no, key, response, truncated, error, "failed" if error else "incomplete" if truncated else "ok"))
            state[0] = state[0] + 1 if error else 0
            state[1] = state[0] >= limit or bool(error and re.search(FATAL, error))
        return rows

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, state, doc = [], [0, False], None
        with ThreadPoolExecutor(parallelism) as pool:
            for batch in batches:
                rows = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if wave and (row[0] != doc or len(wave) == parallelism):
                        rows += settle(pool, wave, state)
                        wave = []
                    if row[0] != doc:
                        doc, state = row[0], [0, False]
                    wave.append(row)
                yield outcomes(rows)
            yield outcomes(settle(pool, wave, state) if wave else [])

    keyed = chunks.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("prompt_key"), "chunk")
    schema = StructType.fromDDL(OUTCOME)
    arrow = to_arrow_schema(schema)
    outcomes = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
    return keyed.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_no").mapInArrow(documents, schema)


def upload_status(docs: DataFrame, chunks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """DML-6, DML-5: (doc_id, status, n_ok, n_incomplete, n_failed, n_stopped, marks_stale) of each document.

    FAILED if it has no text, was stopped, or every chunk failed. Products that were not seen become stale only after a whole reading:
    not capped, nothing failed, stopped or cut off.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    counted = outcomes.groupBy("doc_id").agg(n("ok"), n("incomplete"), n("failed"), n("stopped"))
    capped = chunks.groupBy("doc_id").agg(F.bool_or("capped").alias("capped"))
    out = docs.select("doc_id").distinct().join(capped, "doc_id", "left").join(counted, "doc_id", "left").na.fill(0, ["n_ok", "n_incomplete", "n_failed", "n_stopped"])
    failed = (F.col("n_stopped") > 0) | (F.col("n_ok") + F.col("n_incomplete") == 0)
    return out.select(
        "doc_id", F.when(failed, "FAILED").otherwise("DONE").alias("status"), "n_ok", "n_incomplete", "n_failed", "n_stopped",
        (~failed & ~F.coalesce("capped", F.lit(True)) & (F.col("n_incomplete") + F.col("n_failed") == 0)).alias("marks_stale"),
    )


def run_log(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """SNK-6, AGG-19: one row a chunk: answered, cut off or failed, with the error's text."""
    chunks = ingest.chunk_documents(docs).withColumn("prompt_key", F.sha2("chunk", 256))
    said = chunks.join(answers.select("prompt_key", "truncated", "error"), "prompt_key", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("truncated").isNull(), "missing").when(F.col("truncated"), "incomplete").otherwise("ok")
    return said.select("doc_id", "chunk_no", status.alias("status"), F.left("error", F.lit(300)).alias("error"))


def tender_lines(answers: DataFrame, classes: DataFrame, maps: DataFrame) -> DataFrame:
    """DML-22: requirement lines of answers with class, canonical bag and number."""
    return canonical_rows(models.classified_lines(models.parsed_lines(answers), classes), maps)


def normalize_stored(products: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-11: stored bags with accessories split, and the definitions that some product still uses."""
    done = products.withColumn("attributes", split_accessories(F.col("attributes")))
    used = done.select("class_id", F.explode(F.map_keys("attributes")).alias("name")).distinct()
    return done, definitions.join(used, ["class_id", "name"], "left_semi")


def merge_spellings(products: DataFrame, spellings: DataFrame) -> DataFrame:
    """DML-10: values replaced by the spellings that may merge; ``spellings``: (class_id, spec, variant, canonical)."""
    by_spec = ingest.allowed_spellings(spellings).groupBy("class_id", "spec").agg(F.map_from_entries(F.collect_list(F.struct("variant", "canonical"))).alias("m"))
    by_class = by_spec.groupBy("class_id").agg(F.map_from_entries(F.collect_list(F.struct("spec", "m"))).alias("spellings"))
    out = products.join(by_class, "class_id", "left")
    return out.withColumn("attributes", F.when(F.col("spellings").isNotNull(), replace_values(F.col("attributes"), F.col("spellings"))).otherwise(F.col("attributes"))).drop("spellings")


def sync_classes(
    products: DataFrame, definitions: DataFrame, groups: DataFrame | Callable[[DataFrame, DataFrame], DataFrame], spellings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DML-8, DML-12 for all classes at once: accessories, missing and repaired definitions, duplicate keys, spellings, and repair again.
    ``groups`` and ``spellings`` are checked proposals of a model; ``groups`` may be a function that asks for them anew in each pass.
    Returns products, definitions and the aliases of merged keys."""
    if "value_aliases" not in definitions.columns:
        definitions = definitions.withColumn("value_aliases", F.lit(None).cast("map<string,string>"))

    def synced(products: DataFrame, definitions: DataFrame) -> DataFrame:
        new = ingest.missing_specs(products, definitions).select(
            "class_id", F.col("key").alias("name"), F.lit("text").alias("datatype"), F.lit("eq").alias("match_op"), F.lit(None).cast("string").alias("canonical_unit"), F.lit(None).cast("map<string,string>").alias("value_aliases")
        )
        return ingest.repaired_definitions(definitions.select(*new.columns).unionByName(new), ingest.inferred_types(products, definitions)).drop("ordered")

    products, definitions = normalize_stored(products, definitions)
    definitions = synced(products, definitions)
    products, definitions, aliases = ingest.merge_until_stable(products, definitions, groups)
    products = merge_spellings(products, spellings)
    return products, synced(products, definitions), aliases


def typeahead(suppliers: DataFrame, chosen: DataFrame, text: str) -> DataFrame:
    """FLT-14: suppliers whose name holds the text, without those chosen already."""
    return suppliers.where(F.lower("name").contains(text.lower())).join(chosen.select("supplier_id").distinct(), "supplier_id", "left_anti")


def owned(rows: DataFrame, user: Column) -> DataFrame:
    """FLT-16: rows of a user."""
    return rows.where(F.col("user_id") == user)


def removable_users(users: DataFrame, tenders: DataFrame) -> DataFrame:
    """JN-22: users without a tender."""
    return users.join(tenders.select("user_id").distinct(), "user_id", "left_anti")


def fused(rankings: DataFrame, k: int = 60, most: int = 50) -> DataFrame:
    """Reciprocal rank fusion of (query_id, ranking, item_id, rank): the sum of 1 / (k + rank), best first.

    Each part is a whole number of billionths of a thousandth, so that the sum, and with it a tie, does not depend on the order of the rankings.
    """
    total = rankings.groupBy("query_id", "item_id").agg(F.sum(F.call_function("div", F.lit(1_000_000_000_000), F.lit(k) + F.col("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return total.withColumn("place", place).where(F.col("place") <= most)


def catalogue_diff(old: DataFrame, new: DataFrame, key: str = "product_id") -> DataFrame:
    """Keys that are added, removed or changed between two versions of a table, by a hash of the other columns."""
    row = lambda df: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns) if c != key))
    a, b = old.select(key, row(old).alias("a")), new.select(key, row(new).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")
