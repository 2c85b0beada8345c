"""Versions, folds of streams, alias maps and scratch tables."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import compile as C
from quarry.operators.intake import empty
from quarry.sources import versions
from quarry.streaming.intake import feedback_stream, fold


def test_a_version_without_its_marker_is_not_current(spark, tmp_path):
    root = str(tmp_path / "g")
    assert versions.current(spark, root) == 0
    versions.commit(empty(spark), root)
    empty(spark).entity.write.parquet(f"{root}/v2/entity")  # a commit that failed half way
    assert versions.current(spark, root) == 1 and versions.load(spark, root).entity.count() == 0
    assert versions.commit(empty(spark), root)[1] == 2 and versions.current(spark, root) == 2


def test_a_committed_batch_is_not_folded_twice(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "g")
    log.mkdir()
    seen = []

    def step(state, batch, number):
        seen.append((number, batch.count()))
        return state

    for k in range(2):
        (log / f"{k}.json").write_text(json.dumps({"ts": str(k), "batch_id": "b", "target_type": "t", "target_id": "x", "action": "a"}))
        fold(feedback_stream(spark, str(log)), root, step, str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [(0, 1), (1, 1)] and versions.markers(spark, root) == [(1, 0), (2, 1)]
    # The same log with its checkpoint lost before any batch was noted: both numbers are known.
    fold(feedback_stream(spark, str(log)), root, step, str(tmp_path / "other")).awaitTermination()
    assert seen == [(0, 1), (1, 1)]


def ledger(spark, pairs):
    return spark.createDataFrame(pairs, "surface string, canonical string")


def test_alias_chains_end_at_their_roots(spark):
    pairs = [(f"N {k}", f"n-{k + 1}") for k in range(20)] + [("Same", "same"), ("!!", "x"), ("y", "??"), ("N 3", "n 4")]
    found = {r.surface: r.canonical for r in C.alias_map(ledger(spark, pairs)).collect()}
    assert found == {f"n-{k}": "n-20" for k in range(20)}
    assert C.alias_map(ledger(spark, [])).count() == 0


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a"), ("x", "a")], [("a", "b"), ("A", "c")]])
def test_circles_and_doubled_surfaces_are_errors(spark, pairs):
    with pytest.raises(ValueError):
        C.alias_map(ledger(spark, pairs))


def test_statuses(spark):
    rows = [("x", True, 1, "quarantined"), (None, True, 2, "retried-and-repaired"), (None, True, 1, "repaired"), (None, False, 2, "retried"), (None, None, 1, "clean")]
    df = spark.createDataFrame(rows, "error string, repaired boolean, attempts int, expect string")
    assert df.where(C.final_status(F.col("error"), F.col("repaired"), F.col("attempts")) != F.col("expect")).count() == 0
    stops = spark.createDataFrame([("length", "gemini"), (None, "gemini"), ("MAX_TOKENS", "gemini"), ("stop", "openai_compat"), ("stop", None)], "raw string, api string")
    assert [r.s for r in stops.select(C.normalized_stop(F.col("raw"), F.col("api")).alias("s")).collect()] == ["unknown", "unknown", "output_cap", "complete", "unknown"]
