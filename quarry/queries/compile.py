"""Compiled pages and call records over documents, customers, orders and raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import compile as C
from quarry.plans.graph_view import table
from quarry.queries.registry import query

#: Documents as pages of their source; page slugs are canonical, aliases of them, or their own.
PAGES = """pages AS (SELECT coalesce(try_cast(substr(source, 4) AS INT), -1) AS cs_idx, doc_id AS p_idx, 'notes/src-' || coalesce(try_cast(substr(source, 4) AS INT), -1) || '.md' AS source_id,
  CASE doc_id % 4 WHEN 0 THEN 'topic-' || (doc_id % 53) WHEN 1 THEN 'alias-' || (doc_id % 53) WHEN 2 THEN 'nick-' || (doc_id % 53) ELSE (CASE WHEN doc_id % 28 = 3 THEN 'summary-src-' || coalesce(try_cast(substr(source, 4) AS INT), -1) ELSE 'solo-' || doc_id END) END AS slug,
  CASE WHEN doc_id % 56 = 3 THEN 'summary' WHEN doc_id % 3 = 0 THEN 'concept' ELSE 'article' END AS page_type, lang AS domain, coalesce(text, '') || ' [[topic-' || (doc_id % 7) || ']]' AS body,
  's' || (doc_id % 7) AS s1, 's' || (doc_id % 3) AS s2 FROM documents),
ledger AS (SELECT DISTINCT 'Alias ' || (doc_id % 53) AS surface, 'nick-' || (doc_id % 53) AS canonical FROM documents UNION SELECT DISTINCT 'nick ' || (doc_id % 53), 'TOPIC ' || (doc_id % 53) FROM documents WHERE doc_id % 53 % 2 = 0),
aliases AS (SELECT DISTINCT 'alias-' || m AS surface, CASE WHEN m % 2 = 0 THEN 'topic-' || m ELSE 'nick-' || m END AS canonical FROM (SELECT DISTINCT doc_id % 53 AS m FROM documents) UNION SELECT DISTINCT 'nick-' || m, 'topic-' || m FROM (SELECT DISTINCT doc_id % 53 AS m FROM documents) WHERE m % 2 = 0),
own AS (SELECT p.*, coalesce(a.canonical, p.slug) AS canonical FROM pages p LEFT JOIN aliases a ON a.surface = p.slug)"""


def pages_of(spark, d):
    k, cs = F.col("doc_id"), F.coalesce(F.expr("try_cast(substr(source, 4) AS INT)"), F.lit(-1))
    text_of = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    slug = F.when(k % 4 == 0, text_of("topic-", k % 53)).when(k % 4 == 1, text_of("alias-", k % 53)).when(k % 4 == 2, text_of("nick-", k % 53)).when(k % 28 == 3, text_of("summary-src-", cs)).otherwise(text_of("solo-", k))
    return table(spark, d, "documents").select(
        cs.alias("cs_idx"), k.alias("p_idx"), F.concat(text_of("notes/src-", cs), F.lit(".md")).alias("source_id"), slug.alias("slug"),
        F.when(k % 56 == 3, "summary").when(k % 3 == 0, "concept").otherwise("article").alias("page_type"), F.col("lang").alias("domain"),
        F.concat(F.coalesce("text", F.lit("")), text_of(" [[topic-", k % 7), F.lit("]]")).alias("body"), F.array(text_of("s", k % 7), text_of("s", k % 3)).alias("supports"),
    )


def aliases_of(spark, d):
    m = table(spark, d, "documents").select((F.col("doc_id") % 53).cast("string").alias("m")).distinct()
    first = m.select(F.concat(F.lit("Alias "), "m").alias("surface"), F.concat(F.lit("nick-"), "m").alias("canonical"))
    second = m.where("cast(m as int) % 2 = 0").select(F.concat(F.lit("nick "), "m").alias("surface"), F.concat(F.lit("TOPIC "), "m").alias("canonical"))
    return C.alias_map(first.union(second))


@query("t08_alias_map", "SELECT 'cust-' || c_custkey AS surface, 'cust-' || (c_custkey - c_custkey % 9) AS canonical FROM customer WHERE c_custkey % 9 <> 0")
def _(spark, d):
    k = F.col("c_custkey")
    chain = table(spark, d, "customer").select(F.concat(F.lit("Cust "), k.cast("string")).alias("surface"), F.concat(F.lit("cust-"), F.when(k % 9 == 0, k).otherwise(k - 1).cast("string")).alias("canonical"))
    return C.alias_map(chain)


@query(
    "t10_merge_pages",
    f"""WITH {PAGES},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY slug <> canonical, CASE WHEN slug = canonical THEN 0 ELSE -length(body) END, cs_idx, p_idx) AS r, count(*) OVER (PARTITION BY canonical) AS n_pages, max(slug = canonical) OVER (PARTITION BY canonical) AS named, max(page_type = 'summary') OVER (PARTITION BY canonical) AS summary FROM own),
    each AS (SELECT canonical, s, min((cs_idx, p_idx, k)) AS first FROM (SELECT canonical, s1 AS s, cs_idx, p_idx, 0 AS k FROM own UNION ALL SELECT canonical, s2, cs_idx, p_idx, 1 FROM own) GROUP BY 1, 2),
    supports AS (SELECT canonical, string_agg(s, ',' ORDER BY first) AS supports FROM each GROUP BY 1)
    SELECT canonical, cs_idx, p_idx, sha256(body) AS body_sha256, supports, n_pages, CASE WHEN n_pages = 1 AND named THEN 'kept' WHEN n_pages = 1 THEN 'alias-singleton-rename' WHEN named THEN 'canonical-wins' ELSE 'longest-wins' END AS strategy, summary AND NOT (n_pages = 1 AND named) AS error FROM ranked JOIN supports USING (canonical) WHERE r = 1""",
)
def _(spark, d):
    out = C.merged_pages(pages_of(spark, d), aliases_of(spark, d))
    return out.select("canonical", "cs_idx", "p_idx", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.array_join("supports", ",").alias("supports"), "n_pages", "strategy", "error")


@query("t12_aliases_emitted", f"WITH {PAGES}, used AS (SELECT slug AS alias, canonical, cs_idx, p_idx, row_number() OVER (PARTITION BY slug, canonical ORDER BY cs_idx, p_idx) AS r FROM own WHERE slug <> canonical) SELECT alias, canonical, cs_idx, p_idx FROM used WHERE r = 1")
def _(spark, d):
    return C.aliases_emitted(pages_of(spark, d), aliases_of(spark, d))


@query(
    "t18_violations",
    f"""WITH {PAGES}, s AS (SELECT source_id, count(*) FILTER (page_type = 'summary') AS n, min(slug) FILTER (page_type = 'summary') AS slug FROM pages GROUP BY 1)
    SELECT 'duplicate_slug' AS kind, source_id, slug, count(*) AS n FROM pages GROUP BY source_id, slug HAVING count(*) > 1
    UNION ALL SELECT 'summary_slug_missing', source_id, NULL, n FROM s WHERE n <> 1
    UNION ALL SELECT 'summary_slug_mismatch', source_id, slug, n FROM s WHERE n = 1 AND slug <> 'summary-' || replace(replace(replace(source_id, 'notes/', ''), '.md', ''), '--', '-')
    UNION ALL SELECT 'reserved_slug', source_id, slug, count(*) FROM pages WHERE slug LIKE 'summary-%' AND page_type <> 'summary' GROUP BY 2, 3""",
)
def _(spark, d):
    return C.violations(pages_of(spark, d))


LINKS = r"len(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(body, '```.*?```', '', 'gs'), '`[^`\n]*`', '', 'g'), '\[\[([a-z0-9]+(?:-[a-z0-9]+)*)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]', 1)))"


@query(
    "t19_response_digest",
    f"""WITH {PAGES}, types AS (SELECT cs_idx, string_agg(page_type || ':' || n, ',' ORDER BY page_type) AS page_types FROM (SELECT cs_idx, page_type, count(*) AS n FROM pages GROUP BY 1, 2) GROUP BY 1)
    SELECT cs_idx, count(*) AS n_pages, any_value(page_types) AS page_types, CAST(sum({LINKS}) AS BIGINT) AS n_links, CASE WHEN count(*) FILTER (page_type = 'summary') = 1 THEN min(slug) FILTER (page_type = 'summary') END AS summary_slug FROM pages JOIN types USING (cs_idx) GROUP BY 1""",
)
def _(spark, d):
    out = C.response_digest(pages_of(spark, d))
    return out.withColumn("page_types", F.array_join(F.transform(F.map_entries("page_types"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","))


@query("t42_last_domains", f"WITH {PAGES}, r AS (SELECT slug, domain, row_number() OVER (PARTITION BY slug ORDER BY cs_idx DESC, p_idx DESC) AS r FROM pages) SELECT slug, domain FROM r WHERE r = 1")
def _(spark, d):
    return C.last_domains(pages_of(spark, d))


@query(
    "t36_combined",
    """WITH r AS (SELECT 'run-' || (doc_id % 5) AS run_id, doc_id, CASE WHEN doc_id % 3 > 0 THEN ['n' || doc_id, 'm' || lang] END AS notes, ['a' || (doc_id % 11)] AS aliases FROM documents)
    SELECT run_id, sha256(array_to_string(coalesce(flatten(list(notes ORDER BY doc_id) FILTER (notes IS NOT NULL)), []), ',')) AS notes, sha256(array_to_string(flatten(list(aliases ORDER BY doc_id)), ',')) AS aliases FROM r GROUP BY 1""",
)
def _(spark, d):
    k = F.col("doc_id")
    named = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    rows = table(spark, d, "documents").select(named("run-", k % 5).alias("run_id"), k.alias("ordinal"), F.when(k % 3 > 0, F.array(named("n", k), F.concat(F.lit("m"), "lang"))).alias("notes"), F.array(named("a", k % 11)).alias("aliases"))
    return C.combined(rows).select("run_id", *[F.sha2(F.array_join(c, ",").cast("binary"), 256).alias(c) for c in ("notes", "aliases")])


@query(
    "t34_final_status",
    """SELECT l_orderkey, CASE WHEN bool_or(l_linenumber = n AND l_linestatus = 'F' AND l_linenumber % 3 = 1) THEN 'quarantined' WHEN bool_or(l_linenumber = n AND l_returnflag = 'R') THEN CASE WHEN n = 2 THEN 'retried-and-repaired' ELSE 'repaired' END WHEN n > 1 THEN 'retried' ELSE 'clean' END AS status
    FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey, n""",
)
def _(spark, d):
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.max(F.struct("l_linenumber", ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 1)).alias("e"))).alias("e"), F.max(F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("r"))).alias("r"))
    return last.select("l_orderkey", C.final_status(F.when(F.col("e.e"), "call failed"), F.col("r.r"), F.col("n")).alias("status"))


STOPS = ["length", "max_tokens", "MAX_TOKENS", "stop", "end_turn", "STOP", None]
APIS = ["openai_compat", "anthropic", "gemini", "other"]


@query(
    "t38_stop_reasons",
    """WITH o AS (SELECT o_orderkey, ['openai_compat', 'anthropic', 'gemini', 'other'][1 + o_custkey % 4] AS api, ['length', 'max_tokens', 'MAX_TOKENS', 'stop', 'end_turn', 'STOP', NULL][1 + o_orderkey % 7] AS raw FROM orders)
    SELECT o_orderkey, CASE WHEN (api, raw) IN (('openai_compat', 'length'), ('anthropic', 'max_tokens'), ('gemini', 'MAX_TOKENS')) THEN 'output_cap' WHEN (api, raw) IN (('openai_compat', 'stop'), ('anthropic', 'end_turn'), ('gemini', 'STOP')) THEN 'complete' ELSE 'unknown' END AS stop FROM o""",
)
def _(spark, d):
    api = F.array(*map(F.lit, APIS))[(F.col("o_custkey") % 4).cast("int")]
    raw = F.array(*map(F.lit, STOPS))[(F.col("o_orderkey") % 7).cast("int")]
    return table(spark, d, "orders").select("o_orderkey", C.normalized_stop(raw, api).alias("stop"))


@query("t45_recency", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'age_unknown' WHEN o_custkey % 5 = o_orderkey % 5 THEN 'cohort' ELSE 'pre_run' END AS recency FROM orders")
def _(spark, d):
    first = F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 5).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", C.recency(first, (F.col("o_orderkey") % 5).cast("string")).alias("recency"))


@query("t32_first_keys", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:10], '|') AS keys, CAST(len(string_split(text, ' ')) AS INT) AS n_given FROM documents")
def _(spark, d):
    keys = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(C.first_keys(keys), "|").alias("keys"), F.when(F.col("text").isNotNull(), F.size(keys)).alias("n_given"))


@query(
    "t31_overrides",
    """WITH r AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'xx') || '/' || doc_id || '.md' AS path, CASE WHEN n_chars % 3 = 0 THEN 'noise' ELSE 'signal' END AS kdb_signal, CASE WHEN n_chars % 3 = 0 THEN 'short' END AS reject_reason FROM documents),
    m AS (SELECT *, CASE WHEN regexp_full_match(path, 'src1/.*') THEN 'src1/*' WHEN regexp_full_match(path, '.*/en/.7.*') THEN '*/en/?7*' END AS n, CASE WHEN regexp_full_match(path, '.*[135]\\.md') THEN '*[135].md' WHEN regexp_full_match(path, 'src.*') THEN 'src*' END AS s FROM r)
    SELECT doc_id, CASE WHEN n IS NOT NULL THEN 'noise' WHEN s IS NOT NULL THEN 'signal' ELSE kdb_signal END AS kdb_signal, CASE WHEN n IS NOT NULL THEN 'force_noise' WHEN s IS NOT NULL THEN 'force_signal' END AS rule, coalesce(n, s) AS match,
    CASE WHEN n IS NOT NULL AND kdb_signal = 'signal' THEN 'deterministic override via force_noise: ' || n WHEN n IS NULL AND s IS NOT NULL AND kdb_signal = 'noise' THEN NULL ELSE reject_reason END AS reject_reason FROM m""".replace("\\\\", "\\"),
)
def _(spark, d):
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    noise = F.col("n_chars") % 3 == 0
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"), F.when(noise, "noise").otherwise("signal").alias("kdb_signal"), F.when(noise, "short").alias("reject_reason"))
    return C.overridden(rows, ["*[135].md", "src*"], ["src1/*", "*/en/?7*"]).select("doc_id", "kdb_signal", "rule", "match", "reject_reason")


@query(
    "t30_feeder_outcomes",
    """WITH m AS (SELECT page_id, CASE WHEN page_id % 17 > 0 THEN 'u' || (page_id % 101) END AS u, page_id % 11 = 0 AS promo, page_id % 13 = 0 AS seen FROM pages),
    r AS (SELECT *, CASE WHEN NOT promo AND NOT seen AND u IS NOT NULL THEN min(page_id) FILTER (NOT promo AND NOT seen) OVER (PARTITION BY u) END AS first FROM m)
    SELECT page_id AS message_id, CASE WHEN seen THEN 'skipped' WHEN promo THEN 'promo' WHEN u IN ('u5', 'u6') OR first <> page_id THEN 'dedup' ELSE 'converted' END AS outcome, CASE WHEN NOT seen AND NOT promo THEN CASE WHEN u IN ('u5', 'u6') THEN 'old-' || u || '.md' WHEN first <> page_id THEN 'f' || first || '.md' END END AS dedup_of FROM r""",
)
def _(spark, d):
    k = F.col("page_id")
    url = F.when(k % 17 > 0, F.concat(F.lit("u"), (k % 101).cast("string")))
    messages = table(spark, d, "pages").select(k.alias("message_id"), k.alias("ordinal"), url.alias("url"), (k % 11 == 0).alias("promo"), F.concat(F.lit("f"), k.cast("string"), F.lit(".md")).alias("filename"))
    seen = messages.where("message_id % 13 = 0")
    urls = spark.createDataFrame([("u5", "old-u5.md"), ("u6", "old-u6.md")], "url string, filename string")
    return C.feeder_outcomes(messages, seen, urls)
