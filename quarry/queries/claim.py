"""The claim layer and intake over the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import claims as C
from quarry.operators import intake as N
from quarry.plans.graph_view import table
from quarry.queries.graph import graph_view
from quarry.queries.registry import query

CLAIMS = """claims AS (SELECT 'c' || o_orderkey AS claim_id, 's' || (o_custkey % 40) AS subject, o_orderpriority AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN 'pos' ELSE 'neg' END AS polarity,
  ['part-' || (o_orderkey % 9)] AS objects, 'q' || (o_orderkey % 3) AS qualifier, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' ELSE 'retracted' END AS state, o_orderkey AS version FROM orders WHERE o_custkey % 3 = 0),
cand AS (SELECT o_orderkey AS candidate_id, 's' || (o_custkey % 40) AS subject, o_orderpriority AS predicate, 'pos' AS polarity, 'part-' || (o_orderkey % 9) AS object, 'q' || (o_orderkey % 3) AS qualifier, o_orderkey % 5 = 0 AS refines FROM orders WHERE o_custkey % 3 = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY version DESC, claim_id) AS n FROM claims WHERE state IN ('active', 'superseded')) WHERE n = 1),
cl AS (SELECT candidate_id, k.subject, k.predicate, refines, b.claim_id AS counterpart, CASE WHEN b.claim_id IS NOT NULL THEN CASE WHEN k.polarity IS DISTINCT FROM b.polarity THEN 'contradicts' WHEN refines THEN 'qualifies_or_extends' WHEN NOT list_contains(b.objects, object) THEN 'qualifies_or_extends' WHEN k.qualifier = b.qualifier THEN 'reinforces' ELSE 'supersedes' END
  WHEN k.subject IN (SELECT subject FROM claims WHERE state = 'active') THEN 'orthogonal' ELSE 'no_counterpart' END AS relation FROM cand k LEFT JOIN best b USING (subject, predicate))"""


def tables(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    base = o.select("o_custkey", "o_orderkey", text("s", F.col("o_custkey") % 40).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.array().cast("array<string>").alias("scope"), text("part-", k % 9).alias("object"), text("q", k % 3).alias("qualifier"), "o_orderstatus")
    claims = base.where("o_custkey % 3 = 0").select(text("c", k).alias("claim_id"), "subject", "predicate", "scope", F.when(k % 2 == 0, "pos").otherwise("neg").alias("polarity"), F.array("object").alias("objects"), "qualifier", F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "superseded").otherwise("retracted").alias("state"), k.alias("version"))
    cand = base.where("o_custkey % 3 <> 0").select(k.alias("candidate_id"), "subject", "predicate", "scope", F.lit("pos").alias("polarity"), "object", "qualifier", (k % 5 == 0).alias("refines"))
    links = graph_view(spark, d).links
    return cand, claims, links


@query("f03_classify", f"WITH {CLAIMS} SELECT candidate_id, counterpart, relation FROM cl")
def _(spark, d):
    return C.classify(*tables(spark, d)).select("candidate_id", "counterpart", "relation")


@query("f05_disposition", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'human_review' WHEN o_orderkey % 2 = 0 THEN 'investigate' WHEN o_orderkey % 3 = 0 THEN 'auto_promote_with_note' ELSE 'auto_promote' END AS disposition FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.disposition(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0).alias("disposition"))


@query("f06_promote", f"WITH {CLAIMS} SELECT candidate_id, relation, counterpart, CAST((SELECT max(version) FROM claims c WHERE c.subject = cl.subject AND c.predicate = cl.predicate) + row_number() OVER (PARTITION BY subject, predicate ORDER BY candidate_id) AS BIGINT) AS version FROM cl WHERE counterpart IS NOT NULL AND (relation IN ('contradicts', 'supersedes', 'reinforces') OR (relation = 'qualifies_or_extends' AND refines))")
def _(spark, d):
    cand, claims, links = tables(spark, d)
    return C.promote(C.classify(cand, claims, links), claims).select("candidate_id", "relation", "counterpart", "version")


def batch(spark, d):
    """Documents as compiled pages: a source per document, a page per (source, lang) and one per document, links by number."""
    doc = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    out = F.array(F.concat(F.lit("page-"), ((F.col("doc_id") * 7 + 1) % 1500).cast("string")), F.concat(F.lit("topic-"), F.col("lang")))
    pages = doc.select(F.concat(F.lit("src-"), key).alias("source_id"), F.col("doc_id").alias("page_pos"), F.concat(F.lit("page-"), key).alias("slug"), F.col("lang").alias("title"), F.lit("concept").alias("page_type"), F.lit(None).cast("string").alias("body"), out.alias("outgoing"))
    topics = doc.select(F.concat(F.lit("src-"), key).alias("source_id"), F.col("doc_id").alias("page_pos"), F.concat(F.lit("topic-"), "lang").alias("slug"), F.col("lang").alias("title"), F.lit("article").alias("page_type"), F.lit(None).cast("string").alias("body"), F.array().cast("array<string>").alias("outgoing"))
    sources = doc.select(F.concat(F.lit("src-"), key).alias("source_id"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("source").alias("domain"), F.lit("s").alias("summary"), F.lit("note").alias("source_type"))
    aliases = doc.where("doc_id % 50 = 3").select(F.concat(F.lit("alias-"), key).alias("alias_slug"), F.concat(F.lit("page-"), key).alias("canonical_slug"), F.lit("manual").alias("algorithm"), F.col("doc_id").alias("pos"))
    reconcile = spark.createDataFrame([], "type string, `from` string, `to` string")
    return pages.union(topics), sources, aliases, sources.select("source_id", "hash"), reconcile, "run-1", "2026-01-01T00:00:00+00:00"


@query("b05_entities", "SELECT 'page-' || doc_id AS slug, 'active' AS status, 'concept' AS page_type FROM documents UNION ALL SELECT DISTINCT 'topic-' || lang, 'active', 'article' FROM documents UNION ALL SELECT 'alias-' || doc_id, 'alias', 'alias' FROM documents WHERE doc_id % 50 = 3")
def _(spark, d):
    return N.apply_batch(N.empty(spark), *batch(spark, d)).entity.select("slug", "status", "page_type")


@query("b07_links", "SELECT 'page-' || doc_id AS src, 'page-' || ((doc_id * 7 + 1) % 1500) AS dst FROM documents WHERE (doc_id * 7 + 1) % 1500 IN (SELECT doc_id FROM documents) UNION ALL SELECT 'page-' || doc_id, 'topic-' || lang FROM documents")
def _(spark, d):
    return N.apply_batch(N.empty(spark), *batch(spark, d)).links.select("src", "dst")


@query("b07_pending", "SELECT 'page-' || doc_id || '|page-' || ((doc_id * 7 + 1) % 1500) AS link_id FROM documents WHERE (doc_id * 7 + 1) % 1500 NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    return N.apply_batch(N.empty(spark), *batch(spark, d)).pending.select("link_id")


@query("b08_supports", "SELECT 'src-' || doc_id AS source_id, 'page-' || doc_id AS slug, md5(text) AS hash_at_time FROM documents UNION ALL SELECT 'src-' || doc_id, 'topic-' || lang, md5(text) FROM documents")
def _(spark, d):
    return N.apply_batch(N.empty(spark), *batch(spark, d)).supports.select("source_id", "slug", "hash_at_time")


@query("b13_aliases", "SELECT 'alias-' || doc_id AS alias_slug, 'page-' || doc_id AS canonical_slug FROM documents WHERE doc_id % 50 = 3")
def _(spark, d):
    return N.apply_batch(N.empty(spark), *batch(spark, d)).alias_of.select("alias_slug", "canonical_slug")
