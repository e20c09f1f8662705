"""Checks of extracted lines: gaps in hierarchical numbers, stated counts, and attributes that a line inherits from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Steps


def number_parts(number: Column) -> Column:
    """The whole numbers of a hierarchical number such as ``3.2.10``; null if it is not one."""
    clean = F.trim(number)
    return F.when(clean.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9})*\.?$"), F.transform(F.split(F.rtrim(clean, F.lit(".")), r"\."), lambda p: p.cast("long")))


def numbering_gaps(lines: DataFrame) -> DataFrame:
    """V4: tender_id, parent, after, before, n_missing: places where numbers of (tender_id, line_no) are missing between neighbours under one parent, or before the first (after is then 0).

    A number stands for itself and for all that it is under: ``3.2.10`` shows that 3 and 3.2 exist. Repeated numbers are no gap; what is no number is passed over.
    """
    parts = lines.select("tender_id", number_parts(F.col("line_no")).alias("p")).where("p is not null")
    ladder = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.transform(F.slice("p", F.lit(1), k - 1), lambda x: x.cast("string")), ".").alias("parent"), F.get("p", k - 1).alias("own")))
    nodes = parts.select("tender_id", F.explode(ladder).alias("n")).select("tender_id", "n.parent", "n.own").distinct()
    before = F.coalesce(F.lag("own").over(Window.partitionBy("tender_id", "parent").orderBy("own")), F.lit(0).cast("long"))
    found = nodes.select("tender_id", "parent", before.alias("after"), F.col("own").alias("before"))
    return found.withColumn("n_missing", F.col("before") - F.col("after") - 1).where("n_missing > 0")


def stated_counts(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """V4: tender_id, section, stated, found of the sections (tender_id, section, stated) whose number of (tender_id, line_no) lines is another. A section's lines are those whose number starts with its own."""
    parts = lines.select("tender_id", number_parts(F.col("line_no")).alias("p")).where("size(p) > 1")
    counted = parts.groupBy("tender_id", F.get("p", F.lit(0)).alias("section")).agg(F.count("*").alias("found"))
    both = sections.select("tender_id", "section", "stated").join(counted, ["tender_id", "section"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where(~F.col("stated").eqNullSafe(F.col("found")))


def inherited(steps: Steps, lines: DataFrame) -> DataFrame:
    """V5: line_id, attributes, status of (line_id, inherit_from, attributes): a line has what its parent has, and what it says itself goes before.

    status: own (no parent), inherited, missing_parent (some line above it does not exist; what is known is inherited) or cycle (it is on a ring of
    parents or below one; its attributes are its own). A null value says nothing, like a missing key.

    Pointer jumping: in each round a line takes over what its pointer has gathered and points where that points, so that a chain of n lines
    takes log n rounds. A round in which no line comes to its end shows that only rings are left, since a chain has lines of every depth.
    """
    said = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    start = lines.select("line_id", F.col("inherit_from").alias("up"), said.alias("bag"), F.lit(False).alias("broken"))
    state = steps.write(start)
    left = state.where("up is not null").count()
    while left:
        above = state.select(F.col("line_id").alias("up"), F.col("up").alias("next"), F.col("bag").alias("above"), F.col("broken").alias("broken_above"), F.lit(True).alias("there"))
        step = state.where("up is not null").join(above, "up", "left")
        kept = F.map_filter("above", lambda k, _: ~F.map_contains_key("bag", k))
        bag = F.when(F.col("there"), F.map_concat(kept, "bag")).otherwise(F.col("bag"))
        moved = step.select("line_id", F.col("next").alias("up"), bag.alias("bag"), (F.col("broken") | F.coalesce("broken_above", F.lit(True))).alias("broken"))
        state = steps.write(state.where("up is null").unionByName(moved))
        now = state.where("up is not null").count()
        if now == left:
            break
        left = now
    done = lines.select("line_id", F.col("inherit_from"), said.alias("own")).join(state, "line_id")
    status = F.when(F.col("up").isNotNull(), "cycle").when(F.col("broken"), "missing_parent").when(F.col("inherit_from").isNull(), "own").otherwise("inherited")
    return done.select("line_id", F.when(F.col("up").isNotNull(), F.col("own")).otherwise(F.col("bag")).alias("attributes"), status.alias("status"))
