"""Snapshot export: a folder of JSON lines per table in a fixed total order, with a manifest of rows and digests; refuses to overwrite."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.versions import _fs

#: The sort keys of the tables.
ORDER = {
    "entity": ["slug"], "source": ["source_id"], "links": ["src", "dst", "run_id", "created_at"], "supports": ["source_id", "slug", "run_id", "role", "hash_at_time", "created_at"],
    "alias_of": ["alias_slug", "canonical_slug", "run_id", "algorithm"], "belongs_to": ["slug", "domain", "run_id", "created_at"], "pending": ["link_id"],
}


def ordered_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as JSON with sorted keys, in the order of keys (those the table has), then of all columns."""
    columns = sorted(df.columns)
    order = [k for k in keys if k in columns] + columns
    return df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def export(tables: dict[str, DataFrame], folder: str) -> dict:
    """Write each table as text parts in order; the manifest comes last and makes the snapshot complete."""
    spark = next(iter(tables.values())).sparkSession
    fs, p = _fs(spark, folder)
    if fs.exists(p):
        raise FileExistsError(folder)
    manifest = {}
    for name, df in sorted(tables.items()):
        ordered_json(df, ORDER.get(name, [])).write.text(f"{folder}/{name}.jsonl")
        lines = spark.read.text(f"{folder}/{name}.jsonl")
        n, digest = lines.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0))).first()
        manifest[name] = {"rows": n, "digest": f"{digest % (1 << 64):016x}"}
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/manifest.json")
    return manifest
