"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may go without a named one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or found.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written in the shared folder, which outlives an executor. A checkpoint would keep the constraints
    that Spark has inferred for the rows, which grow from round to round of a loop until planning takes minutes."""
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """A table in the shared folder that a loop adds to, each step's rows once; `dist` is the step. schema: with `dist int` last."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_folder(spark)}/cut/{uuid.uuid4().hex}"

    def add(self, rows: DataFrame, step: int) -> DataFrame:
        """Write the rows of a step; the table with them."""
        rows.write.parquet(f"{self.path}/dist={step}")
        return self.spark.read.schema(self.schema).parquet(self.path)
