"""A bounded sample of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids outside the held-out fold, those of smallest id hash.

    Rows with a null label or id are left out, and repeated labels of an id count once (the largest). The sample of ids is
    chosen before any text is read, and its bound is what makes the broadcast safe.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids.where(remainder("doc_id", modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
