"""Helpers shared by the corpus operators: scratch tables, document access, document-level byte streams."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``. Only a local session, whose tasks share its machine, may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark, "_quarry_scratch", None)
        if not root:
            root = tempfile.mkdtemp(prefix="quarry-")
            spark._quarry_scratch = root
    return f"{root.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes within is deleted at the end, unless it is to be kept: only kept tables may be read after that."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()  # not remove(), which takes the first of equal lists
        for x in paths:
            delete(spark, x)


def delete(spark: SparkSession, x: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(x)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """scratch() for a step of many: at its end its shuffle files go too."""
    with scratch(spark):
        yield
    release(spark)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared scratch folder and read it again: cuts lineage, survives executor loss. A table that a scope keeps goes with the scope around it, if any."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """materialize() a table that comes dealt out by key, in buckets: later joins on key don't shuffle it again."""
    spark = df.sparkSession
    table = f"quarry_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(shuffle_partitions(spark), key).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished steps now, so that their shuffle files go before the next step writes its own."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan (file sizes); decides on partition counts only, never on results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null as empty) and the named further columns; every other column is dropped, whatever its name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *keep)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def key_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables that never part the rows of one key, from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        last, first = batch.column(key)[-1], held[0].column(key)[0]
        if n < rows or first == last:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held = rest.to_batches()
            n = rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def by_part(key: np.ndarray, of: np.ndarray, parts: int, *values: np.ndarray) -> pa.RecordBatch:
    """Keys (a part above 32 bits) and the places they have in values (at most 65,536 long): for each part its keys, sorted, and whose they are, packed."""
    order = np.argsort(key)
    key, of = key[order], of[order]
    edges = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    cols: list[list] = [[], [], [], *([] for _ in values)]
    for p in range(parts):
        i, j = edges[p], edges[p + 1]
        if i < j:
            used, local = np.unique(of[i:j], return_inverse=True)
            for c, x in zip(cols, (p, key[i:j].astype("<u4").tobytes(), local.astype("<u2").tobytes(), *(v[used].tobytes() for v in values)), strict=True):
                c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "keys", "of", "ids", "labels"][: len(cols)])


PACKED = "part int, keys binary, of binary, ids binary"


def shared_keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each part of by_part()'s rows, sorted by part: the keys that several labels (ids, if there are no labels) have, with the part above 32 bits, and their ids."""
    for t in key_groups(batches, "part", rows=1):
        last = t.column_names[-1]
        for at, size in zip(*(x.tolist() for x in runs(t.column("part").to_numpy())), strict=True):
            one = t.slice(at, size)
            part = np.uint64(one.column("part")[0].as_py())
            keys = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in one.column("keys")])
            local = [np.frombuffer(x.as_py(), "<u2") for x in one.column("of")]
            ids, labels = (np.concatenate([np.frombuffer(v.as_py(), "<i8")[o] for v, o in zip(one.column(c), local, strict=True)]) for c in ("ids", last))
            order = np.argsort(keys, kind="stable")
            keys, ids, labels = keys[order], ids[order], labels[order]
            starts, sizes = runs(keys)
            shared = np.repeat(np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts), sizes)
            yield keys[shared].astype(np.uint64) | part << np.uint64(32), ids[shared]


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A cache that a worker process keeps from task to task, for as long as its tasks hold it (tidy)."""
    return _caches.setdefault(name, {})


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(batches: Iterator[pa.RecordBatch], *held: str) -> Iterator[pa.RecordBatch]:
    """What a task makes. A worker lives on after a task: caches not held by the next one go before it begins, freed memory goes after it."""
    left = [c for name, c in _caches.items() if c and name not in held]
    for c in left:
        c.clear()
    if left:
        trim()
    yield from batches
    trim()


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
