"""Change-data classification of scanned files against a ledger, and the ledger's own updates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 20


def classify(current: DataFrame, prior: DataFrame, pipeline: str | None = None) -> DataFrame:
    """path, action, previous_path, current_hash, previous_hash of every file and every file that went.

    Same path: UNCHANGED or CHANGED by hash. Of the rest, the k-th new path of a hash takes the k-th old one (MOVED, in the order of paths);
    then NEW and DELETED are left. With a pipeline only its own prior rows count.
    """
    if pipeline is not None:
        prior = prior.where(F.col("pipeline_id") == pipeline)
    now = current.select("path", F.col("hash").alias("current_hash"))
    old = prior.select(F.col("path").alias("previous_path"), F.col("hash").alias("previous_hash"))
    both = now.join(old, now["path"] == old["previous_path"], "full_outer")
    same = both.where("path IS NOT NULL AND previous_path IS NOT NULL")
    kept = same.select("path", F.when(F.col("current_hash").eqNullSafe(F.col("previous_hash")), "UNCHANGED").otherwise("CHANGED").alias("action"), F.lit(None).cast("string").alias("previous_path"), "current_hash", "previous_hash")
    new = both.where("previous_path IS NULL").select("path", "current_hash", F.row_number().over(Window.partitionBy("current_hash").orderBy("path")).alias("k"))
    gone = both.where("path IS NULL").select("previous_path", "previous_hash", F.row_number().over(Window.partitionBy("previous_hash").orderBy("previous_path")).alias("j"))
    paired = new.join(gone, (F.col("current_hash") == F.col("previous_hash")) & (F.col("k") == F.col("j")), "full_outer")
    action = F.when(F.col("path").isNull(), "DELETED").when(F.col("previous_path").isNull(), "NEW").otherwise("MOVED")
    rest = paired.select(F.coalesce("path", "previous_path").alias("path"), action.alias("action"), F.when(action == "MOVED", F.col("previous_path")).alias("previous_path"), "current_hash", "previous_hash")
    return kept.union(rest)


def eligible(scanned: DataFrame, compiled: DataFrame) -> DataFrame:
    """path, to_compile: a file whose hash is not the compiled one, or was never compiled."""
    live = scanned.where("action <> 'DELETED'")
    c = compiled.select(F.col("path").alias("_p"), "compiled_hash")
    return live.join(c, F.coalesce("previous_path", "path") == F.col("_p"), "left").select("path", (~F.col("current_hash").eqNullSafe(F.col("compiled_hash"))).alias("to_compile"))


def action_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("action").agg(F.count("*").alias("n"))


def ledger_problems(files: DataFrame, reconcile: DataFrame, to_compile: DataFrame, to_skip: DataFrame) -> DataFrame:
    """problem, path: duplicates, lists that overlap, name unknown files or leave some out, and moves without a pair."""
    dup = files.groupBy("path").count().where("count > 1").select(F.lit("duplicate_path").alias("problem"), "path")
    overlap = to_compile.join(to_skip, "path", "left_semi").select(F.lit("compile_and_skip"), "path")
    listed = to_compile.select("path").union(to_skip.select("path"))
    unknown = listed.join(files, "path", "left_anti").select(F.lit("unknown_path"), "path")
    left_out = files.join(listed, "path", "left_anti").select(F.lit("not_listed"), "path")
    moved = files.where("action = 'MOVED'").join(reconcile.where("type = 'MOVED'").select(F.col("to").alias("path")), "path", "left_anti").select(F.lit("move_without_op"), "path")
    return dup.union(overlap).union(unknown).union(left_out).union(moved)


def reconcile_manifest(manifest: DataFrame, scanned: DataFrame, run_id: str) -> DataFrame:
    """The ledger after a scan: source_id, hash, state, tombstone, moved_from, previous_versions (the newest HISTORY), last_run_id."""
    by_old = scanned.select(F.coalesce("previous_path", "path").alias("source_id"), F.col("path").alias("to"), "action", "current_hash")
    m = manifest.select("source_id", F.col("hash").alias("old_hash"), "previous_versions")
    x = m.join(by_old, "source_id", "full_outer")
    pushed = F.concat(F.coalesce("previous_versions", F.array().cast("array<string>")), F.array("old_hash"))
    history = F.when(F.col("action") == "CHANGED", F.slice(pushed, F.greatest(F.lit(1), F.size(pushed) - HISTORY + 1), HISTORY)).otherwise(F.coalesce("previous_versions", F.array().cast("array<string>")))
    live = x.select(F.coalesce("to", "source_id").alias("source_id"), F.when(F.col("action") == "DELETED", F.col("old_hash")).otherwise(F.coalesce("current_hash", "old_hash")).alias("hash"), F.coalesce("action", F.lit("ABSENT")).alias("state"), (F.col("action") == "DELETED").alias("tombstone"), F.when(F.col("action") == "MOVED", F.col("source_id")).alias("moved_from"), history.alias("previous_versions"), F.lit(run_id).alias("last_run_id"))
    old = x.where("action = 'MOVED'").select("source_id", F.col("old_hash").alias("hash"), F.lit("MOVED_AWAY").alias("state"), F.lit(True).alias("tombstone"), F.lit(None).cast("string").alias("moved_from"), F.array().cast("array<string>").alias("previous_versions"), F.lit(run_id).alias("last_run_id"))
    return live.withColumn("tombstone", F.coalesce("tombstone", F.lit(False))).union(old)


def apply_compile(manifest: DataFrame, expected: DataFrame, compiled: DataFrame) -> DataFrame:
    """source_id, run_state, compile_count, compiled_hash: compiled sources advance; expected ones that are missing are in error and keep their hash."""
    c = compiled.select("source_id", F.col("hash").alias("new_hash")).withColumn("done", F.lit(True))
    e = expected.select("source_id").distinct().withColumn("due", F.lit(True))
    x = manifest.join(c, "source_id", "left").join(e, "source_id", "left")
    return x.select("source_id", F.when(F.col("done"), "compiled").when(F.col("due"), "error_compile").otherwise(F.col("run_state")).alias("run_state"), (F.col("compile_count") + F.when(F.col("done"), 1).otherwise(0)).alias("compile_count"), F.coalesce("new_hash", "compiled_hash").alias("compiled_hash"))


def manifest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_id, change (added, removed, changed)."""
    a, b = before.select("source_id", F.col("hash").alias("a")).withColumn("x", F.lit(1)), after.select("source_id", F.col("hash").alias("b")).withColumn("y", F.lit(1))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "source_id", "full_outer").select("source_id", change.alias("change")).where("change IS NOT NULL")


def manifest_problems(manifest: DataFrame, states: list[str]) -> DataFrame:
    """source_id, problem: an unknown state, a live source with a deletion tombstone, a history over the cap."""
    checks = F.array_compact(F.array(F.when(~F.col("run_state").isin(states), "bad_run_state"), F.when(F.col("live") & F.col("tombstone"), "live_and_deleted"), F.when(F.size("previous_versions") > HISTORY, "history_over_cap")))
    return manifest.select("source_id", F.explode(checks).alias("problem"))


def fingerprint(sources: dict[str, str]) -> str:
    """sha256 of a manifest's {id: hash} in JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(sources, sort_keys=True).encode()).hexdigest()


def corpus_fingerprint(sources: DataFrame, parts: int = 256) -> DataFrame:
    """A digest of (source_id, hash) that does not depend on their order: parts are digested in order, then the parts; no task holds all rows."""
    part = F.pmod(F.xxhash64("source_id"), F.lit(parts))
    each = sources.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "source_id", "hash"))), "\n"), 256).alias("digest"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ""), 256).alias("fingerprint"))


def slug_collisions(sources: DataFrame) -> DataFrame:
    """summary_slug, source_ids (sorted): slugs that more than one source would have."""
    return sources.where("summary_slug IS NOT NULL").groupBy("summary_slug").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source_id")).alias("source_ids")).where("n > 1").select("summary_slug", "source_ids")


def legacy_states(states: pd.DataFrame | dict[str, str]):
    """An expression that maps old run states to new ones and keeps the others."""
    pairs = states if isinstance(states, dict) else dict(zip(states.iloc[:, 0], states.iloc[:, 1], strict=True))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("run_state")), F.col("run_state"))
