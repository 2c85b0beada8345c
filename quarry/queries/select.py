"""Entity selection over the projected graph; documents stand for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import select as H
from quarry.operators.reads import belongs_to
from quarry.plans.graph_view import graph_view, table
from quarry.queries.graph import sql
from quarry.queries.registry import query


@query("h02_search_space", sql("SELECT e.slug, title, e.page_type FROM entity e JOIN active USING (slug) WHERE slug IN (SELECT slug FROM belongs WHERE domain = 'MACHINERY') AND slug NOT IN (SELECT slug FROM supports WHERE source_id < 'order-2')"))
def _(spark, d):
    g = graph_view(spark, d)
    return H.search_space(g.entity, belongs_to(g).where("domain = 'MACHINERY'"), g.supports.where("source_id < 'order-2'"))


@query("h03_thin_lines", sql("SELECT slug, slug || ' | ' || page_type || ' | ' || replace(title, chr(10), ' ') AS line FROM entity"))
def _(spark, d):
    return graph_view(spark, d).entity.select("slug", H.thin_line(F.col("slug"), F.col("page_type"), F.col("title")).alias("line"))


@query("h04_fat_blocks", "SELECT doc_id, md5('d' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '    ' || replace(text, chr(10), chr(10) || '    ') END) AS digest FROM documents")
def _(spark, d):
    block = H.fat_block(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.md5(block.cast("binary")).alias("digest"))


@query("h06_budget", "SELECT doc_id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS estimate, CAST(floor(n_chars * 40 * 0.8) AS BIGINT) - 36000 AS budget FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", H.tokens(F.octet_length("text")).alias("estimate"), H.budget(F.col("n_chars") * 40, "thin").alias("budget"))


@query("h07_fill", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS spent FROM documents) WHERE spent <= 40000")
def _(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("rank"), F.col("n_chars").alias("cost"))
    return H.filled(rows, 40_000, "source").select("source", "doc_id")


ANSWERS = sql(
    """SELECT request, place, slug, reason IS NULL AS kept, reason FROM (SELECT *, CASE WHEN bad IS NULL AND sum(CASE WHEN bad IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY request ORDER BY place) > 5 THEN 'over_cap' ELSE bad END AS reason FROM (
    SELECT a.*, CASE WHEN a.slug = '' THEN 'malformed' WHEN a.slug NOT IN (SELECT slug FROM active) THEN 'foreign' WHEN row_number() OVER (PARTITION BY request, a.slug ORDER BY place) > 1 THEN 'duplicate' END AS bad FROM a))""",
    "a AS (SELECT user_id AS request, event_id AS place, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'part-' || (event_id % 40) END AS slug FROM events)",
)


def answers(spark, d):
    e = table(spark, d, "events")
    slug = F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" part-"), (F.col("event_id") % 40).cast("string")))
    space = graph_view(spark, d).entity.where("status = 'active' AND canonical_id IS NULL")
    return H.salvaged(e.select(F.col("user_id").alias("request"), F.col("event_id").alias("place"), slug.alias("slug")), space, 5)


@query("h08_salvage", ANSWERS)
def _(spark, d):
    return answers(spark, d)


@query("h08_salvage_counts", f"SELECT request, count(*) AS returned, count(*) FILTER (kept) AS kept, count(*) FILTER (reason = 'malformed') AS malformed, count(*) FILTER (reason = 'foreign') AS \"foreign\", count(*) FILTER (reason = 'duplicate') AS duplicate, count(*) FILTER (reason = 'over_cap') AS over_cap FROM ({ANSWERS}) GROUP BY request")
def _(spark, d):
    return H.salvage_counts(answers(spark, d))


@query("h10_accounting", "SELECT user_id AS request, list_filter(['click', 'view', 'never'], lambda x: list_contains(list(DISTINCT event_type), x)) AS matched, list_filter(['click', 'view', 'never'], lambda x: NOT list_contains(list(DISTINCT event_type), x)) AS unresolved, CAST(len(list_filter(list(DISTINCT event_type), lambda x: x NOT IN ('click', 'view', 'never'))) AS BIGINT) AS unattributed, count(*) >= 50 AS cap_exhausted FROM events GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("request")).agg(F.collect_set("event_type").alias("answered"), F.count("*").alias("n_kept"))
    return H.accounting(rows.withColumn("asked", F.array(F.lit("click"), F.lit("view"), F.lit("never"))))


@query("h12_stage_outcomes", "SELECT user_id AS request, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'usable' WHEN max_by(event_type, event_id) = 'error' THEN 'output_truncation' WHEN max_by(event_type, event_id) = 'view' THEN 'input_estimation_miss' ELSE 'exhausted' END AS outcome, count(*) AS attempts, CAST(CASE WHEN count(k) = count(*) THEN sum(k) END AS DOUBLE) AS input_tokens, CAST(sum(event_id % 9) AS BIGINT) AS output_tokens FROM (SELECT *, CASE WHEN event_id % 900 <> 0 THEN event_id % 13 END AS k FROM events WHERE event_type <> 'purchase' OR user_id % 2 = 0) GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").where("event_type <> 'purchase' OR user_id % 2 = 0")
    kind = F.col("event_type")
    return H.stage_outcomes(e.select(F.col("user_id").alias("request"), F.col("event_id").alias("attempt"), F.when(kind == "purchase", "usable").otherwise("unparseable").alias("class"), F.when(kind == "error", "length").when(kind == "view", "input").otherwise("stop").alias("stop"), F.when(F.col("event_id") % 900 != 0, F.col("event_id") % 13).alias("input_tokens"), (F.col("event_id") % 9).alias("output_tokens"))).withColumn("input_tokens", F.col("input_tokens").cast("double"))


@query("h14_concordance", "SELECT source, round(len(list_intersect(list(doc_id ORDER BY n_chars, doc_id)[1:10], list(doc_id ORDER BY doc_id)[1:20])) / len(list(doc_id)[1:10]), 6) AS concordance FROM documents GROUP BY source")
def _(spark, d):
    lists = table(spark, d, "documents").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id"))), lambda x: x["doc_id"]).alias("fat"), F.array_sort(F.collect_list("doc_id")).alias("thin"))
    return lists.select("source", F.round(H.concordance(F.col("fat"), F.col("thin")), 6).alias("concordance"))


@query("h15_snapshot_hash")
def _(spark, d):
    return H.snapshot_hash(graph_view(spark, d).entity)


@query("t43_context", "SELECT source AS source_id, doc_id AS slug FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id % 3 = 0 ORDER BY doc_id % 3, n_chars, doc_id) AS n FROM documents) WHERE (doc_id % 3 = 0 OR n <= 20) AND lang <> 'fr'")
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("slug"), (F.col("doc_id") % 3 + 1).alias("tier"), F.col("n_chars").alias("rank"), F.lit(0.0).alias("pagerank"), F.when(F.col("lang") == "fr", "alias").otherwise("concept").alias("page_type"))
    return H.context(rows, 20).select("source_id", "slug")
