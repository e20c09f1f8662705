"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Columns beyond
doc_id, text and source are carried as they are. No stage fails on null ids, null, empty or very long texts, repeated rows or empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specmill.llm.decontaminate import without_contaminated
from specmill.llm.mixing import mixed_rows
from specmill.llm.ngram_join import one_of_each
from specmill.llm.shared import Scratch
from specmill.llm.suffix_dedup import suffix_dedup_rows
from specmill.llm.toxicity import without_toxic
from specmill.plans.ship import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.7. Null and empty texts are scored as texts without terms; repeated rows go or stay together."""
    ship(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id, null last. Repeated rows are near-duplicates; texts without words all stay."""
    ship(spark)
    return one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that stand earlier. A text of which only white space is left goes; null texts become empty ones."""
    ship(spark)
    return suffix_dedup_rows(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold none; repeated rows go or stay together."""
    ship(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each time with its epoch. Null texts have size 0; a null source is one of its own."""
    ship(spark)
    return mixed_rows(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The stages learn, hash and compare in ways that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(k - 1)
    return docs
