"""Candidates that are halved and asked again."""

import duckdb
from pyspark.sql import functions as F

from specmill.plans import answers, catalogue
from specmill.sources import models


def test_a_text_without_white_space_behind_its_middle_is_cut_there():
    assert models.halved("a b c d e1200002") == ["a b c d", "e1200002"]
    assert models.halved("aaa bbb ccc") == ["aaa bbb", "ccc"] and models.halved("x") == ["x"] and models.halved("  ") == ["  "] and models.halved("") == [""]


def test_crawl_halving_with_long_keys(spark, tmp_path):
    spark.range(1_199_990, 1_200_010).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, answers.crawl_halving(spark, str(tmp_path)).collect())) == sorted(map(key, con.execute(catalogue.ORACLE["crawl_halving"]).fetchall()))
