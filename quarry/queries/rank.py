"""KPIs and ranking with events as pass calls: user_id modulo 8 is the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import rank as M
from quarry.plans.graph_view import table
from quarry.queries.registry import query

CALLS = """
calls AS (SELECT 'model-' || (user_id % 8) AS model, CASE WHEN event_type = 'error' THEN 'quarantined' ELSE 'clean' END AS final_status,
  CAST(round(coalesce(value, 0) * 1000) AS BIGINT) AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 AS input_tokens, event_id % 50 AS output_tokens,
  event_type = 'view' AND user_id % 9 = 0 AS syntax_repaired, event_type = 'click' AND user_id % 7 = 0 AS slug_coerced, false AS boundary_recovered, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS attempts FROM events),
kpi AS (SELECT model, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
  round(sum(CASE WHEN final_status = 'quarantined' THEN 1 ELSE 0 END) * 1e6::DOUBLE / sum(input_tokens + output_tokens), 6) AS quarantine,
  round(sum(CASE WHEN final_status <> 'quarantined' AND (syntax_repaired OR slug_coerced OR boundary_recovered OR attempts > 1) THEN 1 ELSE 0 END) * 1e6::DOUBLE / sum(input_tokens + output_tokens), 6) AS recovery,
  round(sum(latency_ms) * 1e6::DOUBLE / sum(input_tokens + output_tokens), 6) AS latency, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retry_load,
  round(count(*) FILTER (final_status <> 'quarantined') / count(*), 6) AS signal_share FROM calls GROUP BY model),
long AS (SELECT model AS candidate, 'quarantine' AS kpi, round(quarantine / 100) AS value FROM kpi UNION ALL SELECT model, 'recovery', round(recovery) FROM kpi UNION ALL SELECT model, 'latency', CASE WHEN model <> 'model-3' THEN latency END FROM kpi
  UNION ALL SELECT model, 'entity_reuse', signal_share FROM kpi UNION ALL SELECT model, 'link_density', calls % 5 FROM kpi),
known AS (SELECT *, CASE WHEN kpi IN ('quarantine', 'recovery', 'latency') THEN value ELSE -value END AS key FROM long WHERE value IS NOT NULL),
borda AS (SELECT candidate, kpi, value, CASE WHEN n = 1 THEN 1.0 WHEN low = high THEN 0.5 ELSE (n - (r + (ties - 1) / 2)) / (n - 1) END AS borda FROM (
  SELECT *, rank() OVER (PARTITION BY kpi ORDER BY key) AS r, count(*) OVER (PARTITION BY kpi, key) AS ties, count(*) OVER (PARTITION BY kpi) AS n, min(key) OVER (PARTITION BY kpi) AS low, max(key) OVER (PARTITION BY kpi) AS high FROM known)),
axes AS (SELECT candidate, max(borda) FILTER (kpi = 'quarantine') AS quarantine, max(borda) FILTER (kpi = 'recovery') AS recovery, max(borda) FILTER (kpi = 'latency') AS latency,
  sum(borda * w) / sum(w) AS graph FROM (SELECT *, CASE kpi WHEN 'entity_reuse' THEN 0.35 WHEN 'link_density' THEN 0.20 END AS w FROM borda) GROUP BY candidate),
pre AS (SELECT *, (coalesce(quarantine * 0.4, 0) + coalesce(recovery * 0.1, 0) + coalesce(latency * 0.1, 0) + coalesce(graph * 0.4, 0)) /
  (CASE WHEN quarantine IS NULL THEN 0 ELSE 0.4 END + CASE WHEN recovery IS NULL THEN 0 ELSE 0.1 END + CASE WHEN latency IS NULL THEN 0 ELSE 0.1 END + CASE WHEN graph IS NULL THEN 0 ELSE 0.4 END) AS pre,
  least(quarantine, recovery, latency, graph) AS weakest FROM axes),
scored AS (SELECT *, 0.1 * greatest(0, (0.5 - weakest) / 0.5) AS penalty FROM pre)
"""


def sql(body: str) -> str:
    return f"WITH {CALLS} {body}"


def calls(spark, d):
    user = F.col("user_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("model-"), (user % 8).cast("string")).alias("model"), F.when(F.col("event_type") == "error", "quarantined").otherwise("clean").alias("final_status"), F.round(F.coalesce("value", F.lit(0)) * 1000).cast("long").alias("latency_ms"),
        (F.get_json_object("props", "$.k").cast("long") + 100).alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), ((F.col("event_type") == "view") & (user % 9 == 0)).alias("syntax_repaired"), ((F.col("event_type") == "click") & (user % 7 == 0)).alias("slug_coerced"),
        F.lit(False).alias("boundary_recovered"), F.when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("attempts"),
    )


def long(spark, d):
    k = M.processing_kpis(calls(spark, d), "model")
    value = {"quarantine": F.round(F.col("quarantine") / 100), "recovery": F.round("recovery"), "latency": F.when(F.col("model") != "model-3", F.col("latency")), "entity_reuse": F.col("signal_share"), "link_density": (F.col("calls") % 5).cast("double")}
    pairs = F.array(*[F.struct(F.lit(n).alias("kpi"), v.alias("value")) for n, v in value.items()])
    return k.select(F.col("model").alias("candidate"), F.explode(pairs).alias("x")).select("candidate", "x.kpi", "x.value")


LOWER = ["quarantine", "recovery", "latency"]


@query("m01_processing_kpis", sql("SELECT * FROM kpi"))
def _(spark, d):
    return M.processing_kpis(calls(spark, d), "model")


@query("m05_borda", sql("SELECT candidate, kpi, value, round(borda, 6) AS borda FROM borda"))
def _(spark, d):
    return M.borda(long(spark, d), "kpi", lower=F.col("kpi").isin(LOWER)).withColumn("borda", F.round("borda", 6))


@query("m06_composite", sql("SELECT candidate, round(graph, 6) AS graph, round(pre, 6) AS pre FROM scored"))
def _(spark, d):
    return M.score_models(long(spark, d), LOWER).select("candidate", F.round("graph", 6).alias("graph"), F.round("pre", 6).alias("pre"))


@query("m07_penalty", sql("SELECT candidate, round(penalty, 6) AS penalty FROM scored"))
def _(spark, d):
    return M.score_models(long(spark, d), LOWER).select("candidate", F.round("penalty", 6).alias("penalty"))


@query("m08_scores", sql("SELECT candidate, round(100 * greatest(0, pre - penalty), 5) AS composite FROM scored"))
def _(spark, d):
    return M.score_models(long(spark, d), LOWER).select("candidate", F.round("composite", 5).alias("composite"))


@query("m09_missing_kpis", sql("SELECT model AS candidate, CASE WHEN model = 'model-3' THEN ['missing latency'] ELSE [] END AS problems FROM kpi"))
def _(spark, d):
    wide = long(spark, d).groupBy("candidate").pivot("kpi", ["quarantine", "latency"]).agg(F.first("value"))
    return M.missing_kpis(wide, ["quarantine", "latency"])


@query("m10_competition_rank", sql("SELECT candidate, composite, CAST(rank() OVER (ORDER BY composite DESC) AS BIGINT) AS place FROM (SELECT model AS candidate, round(signal_share, 2) AS composite FROM kpi)"))
def _(spark, d):
    k = M.processing_kpis(calls(spark, d), "model")
    return M.competition_ranks(k.select(F.col("model").alias("candidate"), F.round("signal_share", 2).alias("composite")))


@query("m11_latest_runs", "SELECT 'model-' || (user_id % 8) AS model, event_type AS release, max('run-' || event_id) AS run_id FROM events GROUP BY 1, 2")
def _(spark, d):
    return M.latest_runs(table(spark, d, "events").select(F.concat(F.lit("model-"), (F.col("user_id") % 8).cast("string")).alias("model"), F.col("event_type").alias("release"), F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id")))


@query(
    "m13_promotion",
    sql("""SELECT s.kpi, round(cov, 6) AS cov, round(q1, 6) AS q1, round(coalesce(max_rho, 0), 6) AS max_rho, coalesce(cov > 0.2 AND q1 > 0.001 AND coalesce(max_rho, 0) < 0.7, false) AS promote FROM
      (SELECT kpi, stddev_samp(value) / avg(value) AS cov, quantile_cont(value::DOUBLE, 0.25) AS q1 FROM long WHERE value IS NOT NULL GROUP BY kpi) s LEFT JOIN
      (SELECT x, max(abs(rho)) AS max_rho FROM (SELECT x, y, coalesce(CASE WHEN isnan(corr(rx, ry)) THEN 0 ELSE corr(rx, ry) END, 0) AS rho FROM (
        SELECT a.kpi AS x, b.kpi AS y, rank() OVER (PARTITION BY a.kpi, b.kpi ORDER BY a.value) + (count(*) OVER (PARTITION BY a.kpi, b.kpi, a.value) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY a.kpi, b.kpi ORDER BY b.value) + (count(*) OVER (PARTITION BY a.kpi, b.kpi, b.value) - 1) / 2 AS ry
        FROM long a JOIN long b USING (candidate) WHERE a.kpi <> b.kpi AND a.value IS NOT NULL AND b.value IS NOT NULL) GROUP BY x, y) GROUP BY x) r ON s.kpi = r.x WHERE s.kpi IN ('latency', 'entity_reuse', 'link_density')"""),
)
def _(spark, d):
    out = M.promotion(long(spark, d), ["latency", "entity_reuse", "link_density"])
    return out.select("kpi", F.round("cov", 6).alias("cov"), F.round("q1", 6).alias("q1"), F.round("max_rho", 6).alias("max_rho"), "promote")


@query("m15_bytes_per_token", sql("SELECT model, round(sum(latency_ms) / sum(input_tokens), 4) AS bytes_per_token FROM calls GROUP BY model"))
def _(spark, d):
    return M.bytes_per_token(calls(spark, d).withColumnRenamed("latency_ms", "rendered_bytes"))


@query("k11_cost", sql("SELECT model, round(sum(CASE WHEN model < 'model-6' THEN input_tokens * 0.25 / 1e6 + output_tokens * 1.5 / 1e6 END), 6) AS cost_usd, count(*) FILTER (model >= 'model-6') AS unpriced FROM calls GROUP BY model"))
def _(spark, d):
    c = calls(spark, d)
    prices = spark.createDataFrame([(f"model-{k}", 0.25, 1.5) for k in range(6)], "model string, price_in double, price_out double")
    return M.cost(c, prices)
