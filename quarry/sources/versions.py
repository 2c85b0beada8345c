"""Versioned table sets: a version's tables are written whole, then an empty marker file makes it one; readers take the newest version with a marker.

Creating a marker is one step in every store, so there is always a current version once there has been one. A marker's name can also carry the
number of the batch that made the version, so that a batch that is run again is seen to be committed.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from quarry.operators.fixpoint import scratch_folder
from quarry.operators.intake import TABLES, State

MARKER = re.compile(r"done-(\d+)(?:-batch-(\d+))?$")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def markers(spark: SparkSession, root: str) -> list[tuple[int, int | None]]:
    """(version, batch) of the complete versions, in order."""
    fs, p = _fs(spark, root)
    found = [MARKER.match(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(m[1]), int(m[2]) if m[2] else None) for m in found if m)


def current(spark: SparkSession, root: str) -> int:
    """The newest complete version; 0 if there is none."""
    return max([v for v, _ in markers(spark, root)], default=0)


def commit(state: State, root: str | None = None, batch: int | None = None) -> tuple[str, int]:
    """Write every table of a state as the next version, then its marker; a failure before that leaves the old version current."""
    spark = state.entity.sparkSession
    root = root or f"{scratch_folder(spark)}/versions-{uuid.uuid4().hex}"
    version = current(spark, root) + 1
    for name in TABLES:
        getattr(state, name).write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    fs, marker = _fs(spark, f"{root}/done-{version}" + (f"-batch-{batch}" if batch is not None else ""))
    fs.create(marker, False).close()
    return root, version


def load(spark: SparkSession, root: str, version: int | None = None) -> State:
    version = version or current(spark, root)
    return State(**{name: spark.read.schema(ddl).parquet(f"{root}/v{version}/{name}") for name, ddl in TABLES.items()})
