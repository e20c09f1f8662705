"""Tables in the shared folder, connected components and small helpers used by several operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session has ended, and its shared folder is the cluster's
            pass


class Scratch:
    """Intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    A written table cuts the lineage: if an executor is lost, later stages read the table again and nothing
    upstream is recomputed. Where the setting is missing, a folder in the warehouse is used, which is shared as well; on one machine,
    as in tests, a local one. Tables that a result still reads are deleted when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.startswith("local"):
                folder = tempfile.mkdtemp(prefix="specmill_")
                atexit.register(shutil.rmtree, folder, ignore_errors=True)
                base = f"file://{folder}"
            else:
                base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/specmill_scratch"
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"
        self.n = 0
        _MADE.append((spark, self.base))

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        """Deletes tables that no later plan reads."""
        for k in numbers:
            _delete(self.spark, f"{self.base}/{k}")


def connected_components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) with the smallest node of each component, from ``edges`` (a, b) of longs.

    Alternating large-star and small-star rounds. A node's neighbours are never gathered: the minimum is a partial
    aggregate, which is written and joined back. Both sides of the join are then dealt anew, so that Spark can split a hub
    with very many edges like any skewed key. Every round is written to the shared folder. Self edges and repeated edges
    are allowed; nodes without an edge are not returned.
    """
    state = None
    cur = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = None
    for _ in range(most_rounds):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = scratch.write(large)
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = scratch.write(small)
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(*range(scratch.n - 4, scratch.n - 1), *([state] if state is not None else []))
        state, cur = scratch.n - 1, nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
