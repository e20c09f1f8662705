"""Tables as versions of a folder: each write is a new version, readers take the newest whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to the end."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(done)


def write_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """SNK-1: the table as a new version; older ones stay until they are dropped."""
    spark = df.sparkSession
    number = max(versions(spark, path), default=0) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/v{number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """SRC-13."""
    return spark.read.parquet(f"{path}/v{number or versions(spark, path)[-1]}")


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    for number in versions(spark, path)[:-keep]:
        p, fs = _fs(spark, f"{path}/v{number}")
        fs.delete(p, True)


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-2, SNK-3: report rows as CSV with a header, or lines of text as a text file."""
    if fmt == "text":
        rows.select("value").write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").option("header", True).csv(path)
