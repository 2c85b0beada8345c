"""Integrity: alias invariants, keyed table differences, edge differences and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.graph_view import Graph


def invariants(g: Graph) -> DataFrame:
    """code, subject of each violation: C1 an alias without its edge, C2 an edge that canonical_id contradicts, C3 an alias of an alias, C4 a link to an alias."""
    e = g.entity.select("slug", "canonical_id")
    alias = e.where("canonical_id IS NOT NULL")
    edge = g.alias_of
    c1 = alias.join(edge, (F.col("slug") == F.col("alias_slug")) & (F.col("canonical_id") == F.col("canonical_slug")), "left_anti").select(F.lit("C1").alias("code"), F.col("slug").alias("subject"))
    c2 = edge.join(e, F.col("alias_slug") == F.col("slug"), "left").where(~F.col("canonical_id").eqNullSafe(F.col("canonical_slug"))).select(F.lit("C2"), "alias_slug")
    c3 = alias.join(alias.select(F.col("slug").alias("t")), F.col("canonical_id") == F.col("t"), "left_semi").select(F.lit("C3"), "slug")
    c4 = g.links.join(alias.select(F.col("slug").alias("t")), F.col("dst") == F.col("t"), "left_semi").select(F.lit("C4"), F.concat("src", F.lit("->"), "dst"))
    return c1.union(c2).union(c3).union(c4)


def table_diff(live: DataFrame, replay: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, kind, field: rows on one side only, and a row for each field that differs (null equals null)."""
    a = live.select(F.col(key).alias("key"), F.struct(*fields).alias("a"))
    b = replay.select(F.col(key).alias("key"), F.struct(*fields).alias("b"))
    both = a.join(b, "key", "full_outer")
    one = F.when(F.col("a").isNull(), F.array(F.struct(F.lit("missing_in_live").alias("kind"), F.lit(None).cast("string").alias("field")))).when(F.col("b").isNull(), F.array(F.struct(F.lit("missing_in_replay").alias("kind"), F.lit(None).cast("string").alias("field"))))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit("attribute_mismatch").alias("kind"), F.lit(f).alias("field"))) for f in fields]))
    return both.select("key", F.explode(F.coalesce(one, differing)).alias("x")).select("key", "x.kind", "x.field")


def edge_diff(live: DataFrame, replay: DataFrame, columns: list[str]) -> DataFrame:
    """side and columns of edges that only one side has, as sets."""
    a, b = live.select(*columns).distinct(), replay.select(*columns).distinct()
    return a.join(b, columns, "left_anti").withColumn("side", F.lit("live")).union(b.join(a, columns, "left_anti").withColumn("side", F.lit("replay")))


def preflight(manifest: DataFrame, source: DataFrame, fields: list[str]) -> DataFrame:
    """Manifest against graph: a source that only the manifest has counts only if its run_state is null or in_graph_db."""
    wanted = manifest.where("run_state IS NULL OR run_state = 'in_graph_db'")
    missing = wanted.join(source.select("source_id"), "source_id", "left_anti").select(F.col("source_id").alias("key"), F.lit("missing_in_live").alias("kind"), F.lit(None).cast("string").alias("field"))
    rest = table_diff(source, manifest, "source_id", fields).where("kind <> 'missing_in_live'")
    return missing.union(rest)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind", "field").count()


def reconcile_contexts(records: DataFrame, expected: DataFrame, run_id: str) -> DataFrame:
    """One row: matched, missing, malformed, duplicate, unexpected, wrong_run, complete, coverage (null without expectations)."""
    seen = records.select("source_id", F.col("malformed").alias("bad"), (F.col("run_id") != run_id).alias("other"))
    good = seen.where("NOT bad AND NOT other").groupBy("source_id").count()
    want = expected.select("source_id").distinct()
    joined = want.withColumn("want", F.lit(True)).join(good, "source_id", "full_outer")
    row = joined.agg(
        F.count_if(F.col("want") & F.col("count").isNotNull()).alias("matched"), F.count_if(F.col("want") & F.col("count").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected"), F.count_if(F.col("count") > 1).alias("duplicate"), F.count_if(F.col("want")).alias("expected")
    )
    flags = seen.agg(F.count_if("bad").alias("malformed"), F.count_if(~F.col("bad") & F.col("other")).alias("wrong_run"))
    both = row.crossJoin(flags)
    clean = (F.col("missing") + F.col("unexpected") + F.col("duplicate") + F.col("malformed") + F.col("wrong_run")) == 0
    return both.withColumn("complete", (F.col("expected") > 0) & clean).withColumn("coverage", F.try_divide("matched", "expected"))
