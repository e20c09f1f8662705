"""Groups of known names on many classes are not put into few tasks."""

import json

from pyspark.sql import functions as F

from specmill.sources import models


def test_groups_of_many_classes_stay_in_many_tasks(spark):
    said = json.dumps({"groups": [{"canonical": "phase", "aliases": ["phases", "unknown", "phase"]}, {"canonical": None, "aliases": ["phase"]}, {"canonical": "power", "aliases": []}]})
    answers = spark.range(400).select(F.col("id").cast("string").alias("class_id"), F.lit(said).alias("response"), F.lit(None).cast("string").alias("error"))
    known = answers.select("class_id", F.explode(F.array(*map(F.lit, ("phase", "phases", "power")))).alias("name"))
    got = models.duplicate_groups(answers, known).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert len(rows) == 400 and {(r.canonical, tuple(r.aliases)) for r in rows} == {("phase", ("phases",))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len({r.task for r in rows}) == 4 and "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan


def test_what_is_known_of_all_classes_is_not_broadcast(spark):
    said = json.dumps({"attributes": [{"name": "power", "label": "Power"}, {"name": "other"}], "synonyms": [{"spec": "phase", "variant": "one", "canonical": "1"}, {"spec": "phase", "variant": "two", "canonical": "1"}, {"spec": "phase", "variant": "1", "canonical": "1"}]})
    answers = spark.range(40).select(F.col("id").cast("string").alias("class_id"), F.lit(said).alias("response"), F.lit(None).cast("string").alias("error"))
    names = answers.select("class_id", F.lit("power").alias("name"))
    values = answers.select("class_id", F.lit("phase").alias("key"), F.explode(F.array(F.lit("one"), F.lit("1"))).alias("value"))
    labels, synonyms = models.attribute_labels(answers, names), models.value_synonyms(answers, values)
    for got, wanted in ((labels.select("name", "label"), ("power", "Power")), (synonyms.select("variant", "canonical"), ("one", "1"))):
        assert [tuple(r) for r in got.collect()] == [wanted] * 40
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
