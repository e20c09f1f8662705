"""Publishing of field values by precedence: what a run changes, cell by cell, and the history of every cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sources of a value, the strongest first.
PRECEDENCE = ("human", "feed", "decoder", "cert_registry", "llm_parse", "scrape")
VERIFIED = "human"


def strength(provenance: Column) -> Column:
    """The place of a source in the order of precedence, from 1; unknown sources are the weakest."""
    place = F.array_position(F.array(*map(F.lit, PRECEDENCE)), provenance)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(PRECEDENCE) + 1).cast("int")


def settled(observations: DataFrame, *keys: str) -> DataFrame:
    """One value for each of ``keys``: that of the strongest source, of equal ones the smallest. Null values say nothing."""
    best = F.min(F.struct(strength(F.col("provenance")).alias("strength"), "value", "provenance")).alias("b")
    return observations.where("value is not null").groupBy(*keys).agg(best).select(*keys, "b.value", "b.provenance", "b.strength")


def field_diff(live: DataFrame, staged: DataFrame) -> DataFrame:
    """product_id, change, field, old_value, new_value, applied: what publishing ``staged`` over ``live`` means; both have (product_id, field, value, provenance).

    new: a product that is not live, a row a field. field_changed: another value, or the first, of a field; it is applied unless the live value is of a
    stronger source. conflict_with_verified: a weaker source contradicts a human's value; never applied. disappeared: a live product
    of which the run says nothing (field null); nothing is deleted.
    """
    a = settled(live, "product_id", "field").select("product_id", "field", F.col("value").alias("old_value"), F.col("provenance").alias("old_source"), F.col("strength").alias("old_strength"))
    b = settled(staged, "product_id", "field").select("product_id", "field", F.col("value").alias("new_value"), F.col("strength").alias("new_strength"))
    known, seen = a.select("product_id").distinct().withColumn("known", F.lit(True)), b.select("product_id").distinct()
    cells = b.join(a, ["product_id", "field"], "left").join(known, "product_id", "left")
    weaker = F.coalesce(F.col("new_strength") > F.col("old_strength"), F.lit(False))
    change = F.when(F.col("known").isNull(), "new").when(weaker & (F.col("old_source") == VERIFIED), "conflict_with_verified").otherwise("field_changed")
    differs = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    changed = cells.where(differs).select("product_id", change.alias("change"), "field", "old_value", "new_value", (~weaker).alias("applied"))
    null = F.lit(None).cast("string")
    gone = known.join(seen, "product_id", "left_anti").select("product_id", F.lit("disappeared").alias("change"), null.alias("field"), null.alias("old_value"), null.alias("new_value"), F.lit(False).alias("applied"))
    return changed.unionByName(gone)


def publish(live: DataFrame, staged: DataFrame) -> DataFrame:
    """The live cells (product_id, field, value, provenance) after the run: a staged value wins over a live one of equal or weaker source. Nothing disappears."""
    a = settled(live, "product_id", "field").withColumn("turn", F.lit(1))
    b = settled(staged, "product_id", "field").withColumn("turn", F.lit(0))
    best = F.min(F.struct("strength", "turn", "value", "provenance")).alias("b")
    return a.unionByName(b).groupBy("product_id", "field").agg(best).select("product_id", "field", "b.value", "b.provenance")


def history(observations: DataFrame) -> DataFrame:
    """product_id, field, value, provenance, valid_from, valid_to (null: still valid) over (product_id, field, value, provenance, run).

    As if every run were published in turn: after a run a cell holds the latest value of the strongest source up to then. So a value is applied
    exactly if no stronger one was seen before, which one running minimum tells; runs are never replayed. Intervals
    that only repeat value and source are joined. A cell's runs are one window.
    """
    # a cell's observations come together once, and its runs are settled and put in turn where they are
    placed = observations.select("product_id", "field", "value", "provenance", "run").repartition("product_id", "field")
    each = settled(placed, "product_id", "field", "run")
    in_turn = Window.partitionBy("product_id", "field").orderBy("run")
    applied = each.withColumn("least", F.min("strength").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("strength = least")
    before = F.lag(F.struct("value", "provenance")).over(in_turn)
    changes = applied.withColumn("same", before.eqNullSafe(F.struct("value", "provenance"))).where("not same")
    return changes.select("product_id", "field", "value", "provenance", F.col("run").alias("valid_from"), F.lead("run").over(in_turn).alias("valid_to"))


def state_at(cells: DataFrame, run: Column) -> DataFrame:
    """The cells of a history that are valid at a run."""
    return cells.where((F.col("valid_from") <= run) & (F.col("valid_to").isNull() | (run < F.col("valid_to")))).select("product_id", "field", "value", "provenance")


def as_of(rows: DataFrame, cells: DataFrame, field: str, at: str = "at") -> DataFrame:
    """``rows`` (product_id, ``at``, ...) with ``value`` and ``provenance`` of a field at their own time, null where it had none yet.

    Rows and changes are put in one order of time for each product, and each row takes the last change before it: no pair of a row
    and an interval that does not hold is made.
    """
    change = cells.where(F.col("field") == field).select("product_id", F.col("valid_from").alias("_at"), F.struct("value", "provenance").alias("_cell"), F.lit(None).cast(rows.schema.simpleString()).alias("_row"))
    asked = rows.select("product_id", F.col(at).alias("_at"), F.lit(None).cast("struct<value:string,provenance:string>").alias("_cell"), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"))
    order = Window.partitionBy("product_id").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = change.unionByName(asked).withColumn("_last", F.last("_cell", ignorenulls=True).over(order))
    return merged.where("_row is not null").select("_row.*", F.col("_last.value").alias("value"), F.col("_last.provenance").alias("provenance"))
