"""Measurement and ranking: processing KPIs, Borda scores, composites, boards, promotion of KPIs, cost models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the top composite, of the graph score and of the first pass; which KPIs are better low.
TOP_WEIGHTS = {"quarantine": 0.40, "recovery": 0.10, "latency": 0.10, "graph": 0.40}
GRAPH_WEIGHTS = {"entity_reuse": 0.35, "graph_connectivity": 0.30, "link_density": 0.20, "supports_density": 0.15}
PASS1_WEIGHTS = {"quarantine": 2 / 3, "recovery": 1 / 6, "latency": 1 / 6}
PENALTY, PENALTY_BELOW = 0.10, 0.5


def processing_kpis(calls: DataFrame, *by: str) -> DataFrame:
    """Rates per million tokens of all calls, quarantined ones included; a rate without tokens is null."""
    tokens = F.sum(F.col("input_tokens") + F.col("output_tokens"))
    quarantined = F.col("final_status") == "quarantined"
    recovered = ~quarantined & (F.col("syntax_repaired") | F.col("slug_coerced") | F.col("boundary_recovered") | (F.col("attempts") > 1))
    rate = lambda c: F.round(F.try_divide(F.sum(F.when(c, 1).otherwise(0)) * F.lit(1e6), tokens), 6)
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        tokens.cast("long").alias("tokens"),
        rate(quarantined).alias("quarantine"),
        rate(recovered).alias("recovery"),
        F.round(F.try_divide(F.sum("latency_ms") * F.lit(1e6), tokens), 6).alias("latency"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retry_load"),
        F.round(F.try_divide(F.count_if(~quarantined), F.count("*")), 6).alias("signal_share"),
    )


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """model, cost_usd over all attempts (null if no call has a price), and calls without a price."""
    x = calls.join(prices, "model", "left")
    each = F.col("input_tokens") * F.col("price_in") / 1e6 + F.col("output_tokens") * F.col("price_out") / 1e6
    return x.groupBy("model").agg(F.round(F.sum(each), 6).alias("cost_usd"), F.count_if(each.isNull()).alias("unpriced"))


def borda(values: DataFrame, *by: str, lower: bool | Column = False) -> DataFrame:
    """values (candidate, value and by) with borda: by average rank, the best 1 and the last 0; alone 1, all equal one half; nulls drop out."""
    known = values.where("value IS NOT NULL")
    group = Window.partitionBy(*by)
    low = lower if isinstance(lower, Column) else F.lit(lower)
    key = F.when(low, F.col("value")).otherwise(-F.col("value"))
    ranked = known.withColumn("_key", key)
    rank = F.rank().over(group.orderBy("_key")) + (F.count("*").over(Window.partitionBy(*by, "_key")) - 1) / 2
    n = F.count("*").over(group)
    flat = F.min("_key").over(group) == F.max("_key").over(group)
    score = F.when(n == 1, 1.0).when(flat, 0.5).otherwise((n - rank) / (n - 1))
    return ranked.withColumn("borda", score).drop("_key")


def weighted(scores: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """candidate, name: the mean of the present scores of the KPIs in weights, by weight; null if none is present."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.try_element_at(table, F.col("kpi"))
    return scores.where(F.col("kpi").isin(list(weights))).groupBy("candidate").agg((F.sum(F.when(F.col("borda").isNotNull(), w) * F.col("borda")) / F.sum(F.when(F.col("borda").isNotNull(), w))).alias(name))


def penalty(row: DataFrame, axes: list[str]) -> DataFrame:
    """row with penalty and weak_axis: up to PENALTY for the weakest present axis under PENALTY_BELOW; the first axis wins ties."""
    present = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("v"), F.lit(k).alias("k"), F.lit(a).alias("a"))) for k, a in enumerate(axes)]))
    weak = F.array_min(present)
    value = F.lit(PENALTY) * F.greatest(F.lit(0.0), (F.lit(PENALTY_BELOW) - weak["v"]) / PENALTY_BELOW)
    return row.withColumn("penalty", F.coalesce(value, F.lit(0.0))).withColumn("weak_axis", F.when(value > 0, weak["a"]))


def score_models(kpis: DataFrame, lower: list[str], candidates: DataFrame | None = None) -> DataFrame:
    """candidate, graph, pre, penalty, composite from (candidate, kpi, value): Borda per KPI, the graph score and its own Borda-like part, the top composite less the penalty, never under 0."""
    scored = borda(kpis, "kpi", lower=F.col("kpi").isin(lower))
    everyone = (candidates or kpis).select("candidate").distinct()
    graph = weighted(scored, GRAPH_WEIGHTS, "graph")
    wide = scored.groupBy("candidate").pivot("kpi", ["quarantine", "recovery", "latency"]).agg(F.first("borda"))
    row = everyone.join(wide, "candidate", "left").join(graph, "candidate", "left")
    given = [F.when(F.col(a).isNotNull(), F.lit(w)).otherwise(0.0) for a, w in TOP_WEIGHTS.items()]
    parts = [F.coalesce(F.col(a), F.lit(0.0)) * w for a, w in TOP_WEIGHTS.items()]
    pre = F.coalesce(F.try_divide(reduce(lambda x, y: x + y, parts), reduce(lambda x, y: x + y, given)), F.lit(0.0))
    out = penalty(row.withColumn("pre", pre), list(TOP_WEIGHTS))
    return out.withColumn("composite", 100 * F.greatest(F.lit(0.0), F.col("pre") - F.col("penalty")))


def competition_ranks(scores: DataFrame) -> DataFrame:
    """candidate, composite, place: 1, 1, 3. Scores are first counted by value, so that the window holds values, not rows."""
    by = scores.groupBy("composite").agg(F.count("*").alias("n"))
    start = by.select(F.col("composite").alias("_c"), (F.coalesce(F.sum("n").over(Window.orderBy(F.desc("composite")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("long").alias("place"))
    return scores.join(start, F.col("composite") == F.col("_c")).select("candidate", "composite", "place")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run (largest run_id) of each model and release."""
    return runs.groupBy("model", "release").agg(F.max("run_id").alias("run_id"))


def missing_kpis(wide: DataFrame, needed: list[str]) -> DataFrame:
    """candidate, problems: needed KPIs that are null."""
    return wide.select("candidate", F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in needed])).alias("problems"))


def promotion(values: DataFrame, watched: list[str], cov: float = 0.2, floor: float = 1e-3, most: float = 0.7) -> DataFrame:
    """kpi, cov, q1, max_rho, promote for watched KPIs from (candidate, kpi, value).

    Promoted: sample deviation over mean above cov, lower quartile (inclusive) above floor, and no rank correlation with another KPI of most or more.
    Pairs drop candidates that miss either; a constant has correlation 0.
    """
    known = values.where("value IS NOT NULL").select("candidate", "kpi", F.col("value").cast("double").alias("value"))
    spread = known.groupBy("kpi").agg(F.try_divide(F.stddev_samp("value"), F.avg("value")).alias("cov"), F.percentile("value", F.lit(0.25)).alias("q1"))
    a = known.where(F.col("kpi").isin(watched)).select("candidate", F.col("kpi").alias("x"), F.col("value").alias("vx"))
    b = known.select("candidate", F.col("kpi").alias("y"), F.col("value").alias("vy"))
    pairs = a.join(b, "candidate").where("x <> y")
    average = lambda v: F.rank().over(Window.partitionBy("x", "y").orderBy(v)) + (F.count("*").over(Window.partitionBy("x", "y", v)) - 1) / 2
    ranked = pairs.select("x", "y", average("vx").alias("rx"), average("vy").alias("ry"))
    rho = ranked.groupBy("x", "y").agg(F.coalesce(F.nanvl(F.corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)).alias("rho"))
    worst = rho.groupBy(F.col("x").alias("kpi")).agg(F.max(F.abs("rho")).alias("max_rho"))
    out = spread.where(F.col("kpi").isin(watched)).join(worst, "kpi", "left").withColumn("max_rho", F.coalesce("max_rho", F.lit(0.0)))
    return out.withColumn("promote", F.coalesce((F.col("cov") > cov) & (F.col("q1") > floor) & (F.col("max_rho") < most), F.lit(False)))


def search_diagnostics(searches: DataFrame) -> DataFrame:
    """One row of search counts and means; means over nothing are null."""
    return searches.agg(F.count("*").alias("searches"), F.count_if(F.col("unresolved") > 0).alias("with_unresolved"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"), F.when(F.count("tokens") == F.count("*"), F.sum("tokens")).alias("tokens"))


def bytes_per_token(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.round(F.try_divide(F.sum("rendered_bytes"), F.sum("input_tokens")), 4).alias("bytes_per_token"))


def growth_cost(rates: DataFrame, n: int) -> DataFrame:
    """Projected cost of n sources when each run reads what the runs before it added: rate * n (n - 1) / 2."""
    return rates.withColumn("projected", F.col("rate") * n * (n - 1) / 2)
