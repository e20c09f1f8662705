"""Intermediate tables that cut a lineage: written once, read by several later steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Steps:
    """Tables of one run, in the shared folder that ``spark.checkpoint.dir`` names; where it is unset, in the warehouse, or on one machine in a local folder that goes with the process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="specmill_steps_")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
        base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/specmill_steps"
        self.base = f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again. An executor that is lost later costs no step before this one.

        Its joins sort and are not broadcast: a compressed file says little of the rows that come out of it, and the driver would hold them all.
        """
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")
