"""Driver loops over DataFrames: each round is cut from its lineage by a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only where that is unset and all tasks share the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quarry_folder", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark._quarry_folder = tempfile.mkdtemp(prefix="quarry-")
    return f"{root.rstrip('/')}/quarry"


def keep(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read again; its size is then known to the planner."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
