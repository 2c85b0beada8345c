"""Change-data classification with documents as files; the ledger is the same documents, changed by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import scan as S
from quarry.plans.graph_view import table
from quarry.queries.registry import query

VIEWS = """
cur AS (SELECT 'doc-' || doc_id || '.md' AS path, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 3),
pri AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'old-' ELSE 'doc-' END || doc_id || '.md' AS path, CASE WHEN doc_id % 10 = 2 THEN md5(text || '!') ELSE md5(text) END AS hash,
  CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS pipeline_id FROM documents WHERE doc_id % 10 <> 0),
same AS (SELECT c.path, CASE WHEN c.hash = p.hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS action, CAST(NULL AS VARCHAR) AS previous_path, c.hash AS current_hash, p.hash AS previous_hash FROM cur c JOIN pri p ON c.path = p.path),
n AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM cur WHERE path NOT IN (SELECT path FROM pri)),
o AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM pri WHERE path NOT IN (SELECT path FROM cur)),
moved AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'DELETED' WHEN o.path IS NULL THEN 'NEW' ELSE 'MOVED' END AS action, CASE WHEN n.path IS NOT NULL THEN o.path END AS previous_path, n.hash AS current_hash, o.hash AS previous_hash FROM n FULL JOIN o ON n.hash = o.hash AND n.k = o.k),
scanned AS (SELECT * FROM same UNION ALL SELECT * FROM moved)
"""


def views(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("hash"))
    k, name = F.col("doc_id") % 10, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    current = doc.where(k != 3).select(F.concat(F.lit("doc-"), name).alias("path"), "hash")
    changed = F.when(k == 2, F.md5(F.concat("text", F.lit("!")).cast("binary"))).otherwise(F.col("hash"))
    prior = doc.where(k != 0).select(F.concat(F.when(k == 1, "old-").otherwise("doc-"), name).alias("path"), changed.alias("hash"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("pipeline_id"))
    return current, prior


def sql(body: str) -> str:
    return f"WITH {VIEWS} {body}"


@query("a01_scan_classes", sql("SELECT * FROM scanned"))
def _(spark, d):
    return S.classify(*views(spark, d))


@query("a02_moved_pairs", sql("SELECT path, previous_path FROM scanned WHERE action = 'MOVED'"))
def _(spark, d):
    return S.classify(*views(spark, d)).where("action = 'MOVED'").select("path", "previous_path")


@query("a03_new_deleted", sql("SELECT path, action FROM scanned WHERE action IN ('NEW', 'DELETED')"))
def _(spark, d):
    return S.classify(*views(spark, d)).where("action IN ('NEW', 'DELETED')").select("path", "action")


@query("a04_to_compile", sql("SELECT s.path, s.current_hash IS DISTINCT FROM p.hash AS to_compile FROM scanned s LEFT JOIN pri p ON coalesce(s.previous_path, s.path) = p.path WHERE action <> 'DELETED'"))
def _(spark, d):
    current, prior = views(spark, d)
    return S.eligible(S.classify(current, prior), prior.select("path", F.col("hash").alias("compiled_hash")))


@query("a05_action_counts", sql("SELECT action, count(*) AS n FROM scanned GROUP BY action"))
def _(spark, d):
    return S.action_counts(S.classify(*views(spark, d)))


@query("a06_pipeline_scope", sql("SELECT count(*) AS n, count(*) FILTER (p.path IS NULL) AS fresh FROM cur c LEFT JOIN pri p ON c.path = p.path AND p.pipeline_id = 'even'"))
def _(spark, d):
    current, prior = views(spark, d)
    out = S.classify(current, prior, "even").where("action <> 'DELETED'")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("action").isin("NEW", "MOVED")).alias("fresh"))


@query("a07_ledger_problems", sql("SELECT 'not_listed' AS problem, path FROM cur WHERE path LIKE '%7.md' UNION ALL SELECT 'compile_and_skip', path FROM cur WHERE path LIKE '%48.md'"))
def _(spark, d):
    current, _ = views(spark, d)
    files = current.withColumn("action", F.lit("NEW"))
    moves = spark.createDataFrame([], "type string, `to` string")
    return S.ledger_problems(files, moves, current.where("path LIKE '%8.md'"), current.where("path LIKE '%48.md' OR NOT (path LIKE '%7.md' OR path LIKE '%8.md')"))


@query(
    "a08_manifest",
    sql("""SELECT coalesce(s.path, p.path) AS source_id, CASE WHEN s.action = 'DELETED' THEN p.hash ELSE coalesce(s.current_hash, p.hash) END AS hash, s.action AS state, s.action = 'DELETED' AS tombstone,
      CASE WHEN s.action = 'MOVED' THEN s.previous_path END AS moved_from, CASE WHEN s.action = 'CHANGED' THEN 1 ELSE 0 END AS n_versions FROM scanned s LEFT JOIN pri p ON coalesce(s.previous_path, s.path) = p.path
      UNION ALL SELECT previous_path, previous_hash, 'MOVED_AWAY', true, NULL, 0 FROM scanned WHERE action = 'MOVED'"""),
)
def _(spark, d):
    current, prior = views(spark, d)
    manifest = prior.select(F.col("path").alias("source_id"), "hash", F.lit(None).cast("array<string>").alias("previous_versions"))
    out = S.reconcile_manifest(manifest, S.classify(current, prior), "run-1")
    return out.select("source_id", "hash", "state", "tombstone", "moved_from", F.size("previous_versions").alias("n_versions"))


@query("a09_apply_compile", sql("SELECT path AS source_id, CASE WHEN path LIKE '%4.md' THEN 'compiled' WHEN path LIKE '%5.md' THEN 'error_compile' ELSE 'new' END AS run_state, CASE WHEN path LIKE '%4.md' THEN 1 ELSE 0 END AS compile_count, CASE WHEN path LIKE '%4.md' THEN hash END AS compiled_hash FROM cur"))
def _(spark, d):
    current, _ = views(spark, d)
    manifest = current.select(F.col("path").alias("source_id"), F.lit("new").alias("run_state"), F.lit(0).alias("compile_count"), F.lit(None).cast("string").alias("compiled_hash"))
    due = current.where("path LIKE '%4.md' OR path LIKE '%5.md'").select(F.col("path").alias("source_id"), "hash")
    return S.apply_compile(manifest, due, due.where("source_id LIKE '%4.md'"))


@query("a11_manifest_delta", sql("SELECT coalesce(c.path, p.path) AS source_id, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM cur c FULL JOIN pri p ON c.path = p.path WHERE c.hash IS DISTINCT FROM p.hash"))
def _(spark, d):
    current, prior = views(spark, d)
    return S.manifest_delta(prior.withColumnRenamed("path", "source_id"), current.withColumnRenamed("path", "source_id"))


@query("a14_fingerprint")
def _(spark, d):
    return S.corpus_fingerprint(views(spark, d)[0].withColumnRenamed("path", "source_id"))


@query("a15_collisions", sql("SELECT 'summary-' || substr(hash, 1, 2) AS summary_slug, list(path ORDER BY path) AS source_ids FROM cur GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    current, _ = views(spark, d)
    return S.slug_collisions(current.select(F.col("path").alias("source_id"), F.concat(F.lit("summary-"), F.substring("hash", 1, 2)).alias("summary_slug")))
