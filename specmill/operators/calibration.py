"""Confidence as a probability: isotonic regression of reviewed outcomes, the threshold of largest coverage, and routing by it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring ranges of confidences whose blocks are merged in one task.
FAN = 32
#: Bins of confidence by which rows meet blocks.
BINS = 1024


def pooled(low: list[float], high: list[float], n: list[int], k: list[int]) -> list[tuple[float, float, int, int]]:
    """Pool adjacent violators: neighbouring blocks of rising confidence join as long as the share k / n does not rise. Whole numbers, so exact."""
    out: list[tuple[float, float, int, int]] = []
    for a, b, m, c in zip(low, high, n, k, strict=True):
        while out and out[-1][3] * m >= c * out[-1][2]:
            a, _, more, right = out.pop()
            m, c = m + more, c + right
        out.append((a, b, m, c))
    return out


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("low")
    rows = pooled(*(frame[c].tolist() for c in ("low", "high", "n", "n_correct")))
    return pd.DataFrame(rows, columns=["low", "high", "n", "n_correct"])


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of (group, confidence), in order: blocks of each batch, whatever its size."""
    for batch in batches:
        for (group, chunk), frame in batch.groupby(["group", "chunk"], sort=False):
            yield _pool(frame).assign(group=group, chunk=chunk)[["group", "chunk", "low", "high", "n", "n_correct"]]


def _merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return _pool(frame).assign(group=key[0], chunk=key[1])[["group", "chunk", "low", "high", "n", "n_correct"]]


def isotonic_blocks(reviews: DataFrame) -> DataFrame:
    """group, low, high, n, n_correct, p of (group, confidence, correct): the non-decreasing step function of least squared error, as blocks.

    Reviews without a group, a confidence that is a number, or an outcome are passed over. Pooling neighbours in any order gives the same blocks, so
    ranges of confidences are pooled where they lie, and FAN ranges of a group at a time are merged until one is left.
    What a merge holds is bounded: its shares rise and are fractions of whole numbers, so that N reviews leave at most some N^(2/3) blocks a range.
    """
    good = reviews.where("group is not null and correct is not null and confidence is not null and not isnan(confidence)")
    level = good.groupBy(F.col("group").cast("string").alias("group"), (F.col("confidence").cast("double") + F.lit(0.0)).alias("low"))
    counts = level.agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"))
    parts = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "group", "low").sortWithinPartitions("group", "low").withColumn("chunk", F.spark_partition_id())
    schema = "group string, chunk int, low double, high double, n long, n_correct long"
    blocks = dealt.select("group", "chunk", "low", F.col("low").alias("high"), "n", "n_correct").mapInPandas(_ranges, schema)
    while True:  # once at least: a range that came in several batches has been pooled batch by batch
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("chunk", (F.col("chunk") / FAN).cast("int")).groupBy("group", "chunk").applyInPandas(_merged, schema)
        if parts == 1:
            break
    return blocks.drop("chunk").withColumn("p", F.col("n_correct") / F.col("n"))


def thresholds(blocks: DataFrame, most_wrong: int = 20) -> DataFrame:
    """group, threshold, n_accepted, n_wrong, n_reviews: the least confidence above which at most ``most_wrong`` in a thousand reviews are wrong; threshold is null where no block is as good."""
    down = Window.partitionBy("group").orderBy(F.desc("low"))
    rows = blocks.select("group", "low", F.sum("n").over(down).alias("above"), F.sum(F.col("n") - F.col("n_correct")).over(down).alias("wrong"))
    ok = F.col("wrong") * 1000 <= F.col("above") * most_wrong
    rows = rows.groupBy("group").agg(F.min(F.when(ok, F.struct("low", "above", "wrong"))).alias("t"), F.max("above").alias("n_reviews"))
    zero = F.lit(0).cast("long")
    return rows.select("group", F.col("t.low").alias("threshold"), F.coalesce("t.above", zero).alias("n_accepted"), F.coalesce("t.wrong", zero).alias("n_wrong"), "n_reviews")


def _bin(value: Column, span: tuple[float, float]) -> Column:
    """Monotone in ``value``, so that blocks and rows that belong together share a bin, also outside ``span``."""
    low, high = span
    inside = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.least(F.floor((inside - low) / (high - low) * BINS), F.lit(BINS - 1)).cast("int")


def routed(rows: DataFrame, blocks: DataFrame, limits: DataFrame, span: tuple[float, float] = (0.0, 100.0)) -> DataFrame:
    """``rows`` (with group, confidence) with p and route.

    p is the share of the block at or below the confidence, or of the least block; null without a group with reviews or a confidence. Route is
    ``auto`` from the group's threshold on, ``review`` below it and where there is none, ``unscored`` without p. ``span`` is where most confidences lie;
    others are served too.
    """
    up = Window.partitionBy("group").orderBy("low")
    step = blocks.select("group", "p", "low", F.lead("low").over(up).alias("to"), F.row_number().over(up).alias("i")).join(limits.select("group", "threshold"), "group")
    start, end = F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("low")), F.coalesce("to", F.lit(float("inf")))
    first, last = F.when(F.col("i") == 1, F.lit(0)).otherwise(_bin(F.col("low"), span)), F.when(F.col("to").isNull(), F.lit(BINS - 1)).otherwise(_bin(F.col("to"), span))
    pieces = step.select(F.col("group").alias("_g"), F.explode(F.sequence(first, last)).alias("_bin"), start.alias("_from"), end.alias("_to"), F.col("p").alias("_p"), F.col("threshold").alias("_threshold"))
    c = F.col("confidence").cast("double")
    c = F.when(~F.isnan(c), c)
    keyed = rows.withColumns({"_c": c, "_b": _bin(c, span)})
    inside = (F.col("_c") >= F.col("_from")) & ((F.col("_c") < F.col("_to")) | (F.col("_to") == float("inf")))
    met = keyed.join(pieces, (F.col("group").cast("string") == F.col("_g")) & (F.col("_b") == F.col("_bin")) & inside, "left")
    route = F.when(F.col("_p").isNull(), "unscored").when(F.col("_c") >= F.col("_threshold"), "auto").otherwise("review")
    return met.select(*(F.col(f"`{x}`") for x in rows.columns), F.col("_p").alias("p"), route.alias("route"))
