"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import source_divergence
from .fill_middle import ORACLE as FILL_MIDDLE_SQL
from .fill_middle import fill_middle, restored
from .html_text import html_text
from .lm_score import lm_scores
from .minhash_dedup import ORACLE as MINHASH_SQL
from .minhash_dedup import minhash_dedup
from .mixing import ORACLE as MIXING_SQL
from .mixing import mix_sources
from .neighbours import ORACLE as NEAREST_SQL
from .neighbours import nearest
from .ngram_join import ngram_join
from .quality import quality
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity


#: Bytes of a table that may lie in one row group of one file, which one task would read.
SMALL = 64 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; a small one is dealt to all cores, since Spark does not split a row group."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = name in ("documents", "pages") and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL
    return rows.repartition(2 * cores) if small else rows


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, _table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark, _table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(spark, _table(spark, sf_dir, "documents"), with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, _table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark, _table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_html_text, op2_lm_scores, op3_ngram_join, op4_decontaminate, op5_mix_sources, op6_suffix_dedup, op7_quality, op8_token_counts, op9_nearest, op10_toxicity, op11_divergence, op12_fill_middle, op13_minhash_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": MIXING_SQL, "op9_nearest": NEAREST_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_fill_middle": FILL_MIDDLE_SQL, "op13_minhash_dedup": MINHASH_SQL}
