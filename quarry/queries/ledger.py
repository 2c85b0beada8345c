"""The full-text ledger over documents (articles) and labels (feedback)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import ledger as L
from quarry.plans.graph_view import table
from quarry.queries.registry import query

VERDICTS = """verdicts AS (
  SELECT doc_id AS article_id, 'run-' || r AS run_id, CASE (doc_id + r) % 6 WHEN 0 THEN 'investment' WHEN 1 THEN 'finance-econ' WHEN 2 THEN 'geopolitics' WHEN 3 THEN 'china-econ' WHEN 4 THEN 'ai-tech' ELSE 'other' END AS topic,
    (doc_id * 7 + r) % 100 / 100 AS signal, doc_id % 29 = 0 AS exploration FROM documents, (VALUES (1), (2)) v(r) WHERE doc_id % (r + 1) = 0
), latest AS (SELECT * FROM verdicts v WHERE run_id = (SELECT max(run_id) FROM verdicts w WHERE w.article_id = v.article_id))"""


def verdicts(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("r")).where("article_id % (r + 1) = 0")
    topics = F.array(*[F.lit(t) for t in L.TOPICS])
    return doc.select("article_id", F.concat(F.lit("run-"), F.col("r").cast("string")).alias("run_id"), F.get(topics, ((F.col("article_id") + F.col("r")) % 6).cast("int")).alias("topic"), ((F.col("article_id") * 7 + F.col("r")) % 100 / 100).alias("signal"), (F.col("article_id") % 29 == 0).alias("exploration"))


@query("i01_upsert", "SELECT doc_id AS article_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha, CASE WHEN doc_id % 3 = 0 THEN 'run-2' ELSE 'run-1' END AS first_seen, CASE WHEN doc_id % 7 = 0 THEN 'run-1' ELSE 'run-2' END AS last_seen, doc_id % 3 = 0 OR doc_id % 5 = 0 AS replaced FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 = 0) AND NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)")
def _(spark, d):
    doc = table(spark, d, "documents").where("NOT (doc_id % 3 = 0 AND doc_id % 7 = 0) AND NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)").withColumnRenamed("doc_id", "article_id")
    md5 = lambda c: F.md5(c.cast("binary")).alias("sha")
    old = doc.where("article_id % 3 <> 0").select("article_id", md5(F.col("text")), F.lit("run-1").alias("first_seen"), F.lit("run-1").alias("last_seen"))
    new = doc.where("article_id % 7 <> 0").select("article_id", md5(F.when(F.col("article_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), F.lit("run-2").alias("seen"))
    return L.upsert(old, new)


@query("i07_latest_verdicts", f"WITH {VERDICTS} SELECT article_id, run_id, topic, signal, exploration FROM latest")
def _(spark, d):
    return L.latest(verdicts(spark, d)).select("article_id", "run_id", "topic", "signal", "exploration")


@query("i08_triggers", f"WITH {VERDICTS} SELECT article_id, topic, signal FROM latest WHERE topic IN ('investment', 'finance-econ') OR signal >= 0.75 OR exploration")
def _(spark, d):
    return L.triggers(verdicts(spark, d)).select("article_id", "topic", "signal")


@query("i05_ungated", f"WITH {VERDICTS} SELECT doc_id AS article_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT article_id FROM verdicts WHERE run_id = 'run-2')")
def _(spark, d):
    articles = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.when(F.col("n_chars") > 500, "ok").otherwise("short").alias("cleanliness"))
    v = verdicts(spark, d).withColumns({"model": F.col("run_id"), "prompt_version": F.lit("v1")})
    return L.ungated(articles, v, "run-2", "v1").select("article_id")


@query(
    "i11_gate_parse",
    """SELECT doc_id AS article_id, true AS ok, CASE WHEN doc_id % 4 = 3 THEN 'other' ELSE 'ai-tech' END AS topic, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS signal,
      doc_id % 4 <> 3 AND doc_id % 2 = 0 AS extract_ideas, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS confidence, 'r' || doc_id AS rationale FROM documents""",
)
def _(spark, d):
    k = F.col("doc_id")
    text = F.format_string('{"topic": "%s", "signal": %s, "extract_ideas": %s, "extract_lessons": "true", "confidence": %s, "rationale": "r%d"}', F.when(k % 4 == 3, "sports").otherwise("ai-tech"), F.when(k % 3 == 0, "1.7").when(k % 3 == 1, "-0.5").otherwise("0.5"), F.when(k % 2 == 0, "true").otherwise('"yes"'), F.when(k % 3 == 0, "2").when(k % 3 == 1, "-3").otherwise("0.5"), k)
    return L.parse_verdicts(table(spark, d, "documents").select(k.alias("article_id"), text.alias("response"))).select("article_id", "ok", "topic", "signal", "extract_ideas", "confidence", "rationale")


@query(
    "i10_span_proof",
    "SELECT doc_id AS article_id, source AS quote FROM documents WHERE doc_id % 9 <> 4",
)
def _(spark, d):
    doc = table(spark, d, "documents").withColumnRenamed("doc_id", "article_id")
    claims = doc.select("article_id", F.lit("p0001").alias("paragraph_id"), F.col("source").alias("quote"))
    paragraphs = doc.select("article_id", F.lit("p0001").alias("paragraph_id"), F.when(F.col("article_id") % 9 == 4, "nothing here").otherwise(F.concat(F.lit("from "), "source", F.lit("."))).alias("body"))
    return L.proved(claims, paragraphs).select("article_id", "quote")


@query("i12_exploration", """SELECT doc_id AS article_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, count(*) OVER (PARTITION BY source) AS size FROM documents) ORDER BY turn, size DESC, source
  LIMIT (SELECT CAST(least(count(*), greatest(10, ceil(0.05 * count(*)))) AS BIGINT) FROM documents)""")
def _(spark, d):
    return L.exploration_sample(table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("author")))


@query(
    "i17_calibration",
    f"""WITH {VERDICTS}, x AS (SELECT l.quality = 1 AS pos, v.topic IN ('investment', 'finance-econ') OR v.signal >= 0.75 AS yes FROM labels l LEFT JOIN latest v ON l.doc_id = v.article_id),
    c AS (SELECT count(*) FILTER (pos AND yes) AS tp, count(*) FILTER (NOT pos AND yes) AS fp, count(*) FILTER (pos AND NOT yes) AS fn, count(*) FILTER (NOT pos AND NOT yes) AS tn, count(*) AS labeled FROM x)
    SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""",
)
def _(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "strong").otherwise("noise").alias("action"), F.lit(1).alias("place"))
    return L.calibration(labels, verdicts(spark, d), ["strong", "interesting"])


@query(
    "i18_stratified",
    f"""WITH {VERDICTS}, r AS (SELECT article_id, topic, source AS author FROM latest JOIN documents ON doc_id = article_id), g AS (SELECT topic, count(*) AS g, CAST(least(count(*), greatest(2, round_even(60 * count(*) / (SELECT count(*) FROM r), 0))) AS BIGINT) AS k FROM r GROUP BY topic),
    o AS (SELECT article_id, topic, row_number() OVER (PARTITION BY topic ORDER BY author, article_id) - 1 AS i FROM r), t AS (SELECT topic, CAST(floor(j * (g / k)) AS BIGINT) AS i FROM g, LATERAL (SELECT unnest(range(k)) AS j)),
    p AS (SELECT article_id, topic FROM o JOIN t USING (topic, i)), f AS (SELECT article_id, topic FROM r WHERE article_id NOT IN (SELECT article_id FROM p) ORDER BY article_id LIMIT (SELECT greatest(0, 60 - count(*)) FROM p))
    SELECT * FROM (SELECT * FROM p ORDER BY article_id LIMIT 60) UNION ALL SELECT * FROM f""",
)
def _(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("author"), F.lit(None).cast("string").alias("published"))
    return L.stratified_sample(L.latest(verdicts(spark, d)).select("article_id", "topic").join(doc, "article_id"), 60)


@query("i14_chunks")
def _(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.posexplode(F.split("text", "\n")).alias("place", "p"))
    return L.chunks(doc.select("article_id", "place", (F.size(F.split("p", " ")) * 40).cast("long").alias("n_words")))


@query("i20_status", "SELECT CASE WHEN n_chars > 500 THEN 'ok' ELSE 'short' END AS cleanliness, lang AS kind, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    return L.status(table(spark, d, "documents").select(F.when(F.col("n_chars") > 500, "ok").otherwise("short").alias("cleanliness"), F.col("lang").alias("kind")))


def bm25_sql(words: list[str]) -> str:
    terms = ", ".join(f"('{w}')" for w in words)
    return rf"""WITH t AS (SELECT doc_id AS article_id, string_split_regex(lower(strip_accents(source || ' ' || lang || ' ' || text)), '[^\pL\pN]+') AS ts FROM documents WHERE NOT contains(text, 'ß')),
    u AS (SELECT article_id, list_filter(ts, lambda x: x <> '') AS ts FROM t), n AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM u),
    f AS (SELECT article_id, len(ts) AS l, w, len(list_filter(ts, lambda x: x = w)) AS f FROM u, (VALUES {terms}) v(w)), df AS (SELECT w, count(*) FILTER (f > 0) AS df FROM f GROUP BY w)
    SELECT article_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM f JOIN df USING (w), n GROUP BY article_id HAVING min(f) > 0"""


@query("i04_search", bm25_sql(["erou", "thonre"]))
def _(spark, d):
    articles = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("title"), F.col("lang").alias("author"), F.col("text").alias("body"))
    return L.search(articles, "erou thonre").select("article_id", F.round("score", 6).alias("score"))
