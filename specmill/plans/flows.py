"""Queries on whole flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, numbers
from ..operators import flows as W
from . import adapter as A
from .registry import register


@register("bag_unit_normalize", "select p_partkey, case p_partkey % 3 when 0 then p_size * 1000.0 + 0.0 when 1 then p_size end::double as volts, case when p_partkey % 3 = 2 then 'kV' end as unit, (case when p_partkey % 3 = 2 then 2 else 1 end)::bigint as n_keys from part")
def bag_unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    bag = F.create_map(F.lit("volts"), F.when(k == 2, "many").otherwise(F.col("p_size").cast("string")), F.lit("volts_unit"), F.when(k == 1, "V").otherwise("kV"))
    out = attrs.normalize_units(bag, numbers.literal_map({"volts": "V"}))
    return A.table(spark, sf_dir, "part").select("p_partkey", out.alias("b")).select("p_partkey", F.element_at("b", "volts").try_cast("double").alias("volts"), F.element_at("b", "volts_unit").alias("unit"), F.size("b").cast("long").alias("n_keys"))


@register("merge_spellings", "select p_partkey as product_id, case p_brand when 'Brand#1' then 'Brand 1' when 'Brand#2' then 'Brand#2' else p_brand end as brand from part")
def merge_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("class_id")).distinct()
    pairs = F.explode(F.array(*(F.struct(F.lit("brand").alias("spec"), F.lit(a).alias("variant"), F.lit(b).alias("canonical")) for a, b in (("Brand#1", "Brand-1"), ("Brand-1", "Brand 1"), ("Brand#2", "Brand#2 Inc")))))
    done = W.merge_spellings(A.products(spark, sf_dir), classes.select("class_id", pairs.alias("p")).select("class_id", "p.*"))
    return done.select("product_id", F.element_at("attributes", "brand").alias("brand"))


@register(
    "sync_classes",
    "select distinct p_type as class_id, v.name, v.datatype, v.match_op, null::varchar as canonical_unit from part, (values ('size', 'numeric', 'gte'), ('brand', 'text', 'eq'), ('insulation_class', 'text', 'gte')) v(name, datatype, match_op)",
)
def sync_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class whose stored definitions are one that products use and one that none does."""
    stored = A.definitions(spark, sf_dir).where("name in ('size', 'price')").withColumn("canonical_unit", F.lit(None).cast("string"))
    none = lambda s: spark.createDataFrame([], s)
    _, names, _ = W.sync_classes(A.products(spark, sf_dir), stored, none("class_id string, canonical string, aliases array<string>"), none("class_id string, spec string, variant string, canonical string"))
    return names.select("class_id", "name", "datatype", "match_op", "canonical_unit")


@register("supplier_typeahead", "select s_suppkey as supplier_id, s_name as name from supplier where lower(s_name) like '%1%' and s_suppkey % 5 <> 0")
def supplier_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"))
    return W.typeahead(s, s.where("supplier_id % 5 = 0"), "1")


@register("catalogue_diff", "select p_partkey as product_id, case when p_partkey % 7 = 0 then 'removed' when p_partkey % 7 = 1 then 'added' else 'changed' end as change from part where p_partkey % 7 in (0, 1, 2)")
def catalogue_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    new = p.where("product_id % 7 <> 0").withColumn("name", F.when(F.col("product_id") % 7 == 2, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return W.catalogue_diff(p.where("product_id % 7 <> 1"), new)
