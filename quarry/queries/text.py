"""Text transforms over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.graph_view import table
from quarry.queries.registry import query


def docs(spark, d):
    return table(spark, d, "documents")


def title():
    return F.substring("text", 1, 60)


@query("t01_slugify", r"SELECT doc_id, nullif(trim(regexp_replace(lower(strip_accents(substr(text, 1, 60))), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM documents WHERE NOT contains(substr(text, 1, 60), 'ß')")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.slugify(title()).alias("slug"))


@query("t03_valid_slug", r"SELECT doc_id, regexp_full_match(split_part(text, ' ', 1), '[a-z0-9]+(?:-[a-z0-9]+)*') AS valid, CASE WHEN regexp_full_match(lower(split_part(text, ' ', 1)), '[a-z0-9]+(?:-[a-z0-9]+)*') THEN lower(split_part(text, ' ', 1)) END AS collapsed FROM documents WHERE NOT contains(split_part(text, ' ', 1), '-')")
def _(spark, d):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return docs(spark, d).select("doc_id", T.is_slug(first).alias("valid"), T.collapse_slug(first).alias("collapsed"))


@query("t07_wikilinks", r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(regexp_replace(body, '`[^`\n]*`', '', 'g'), '\[\[([a-z0-9]+(?:-[a-z0-9]+)*)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]', 1))) AS slugs
  FROM (SELECT doc_id, substr(text, 1, 200) || ' [[page-' || (doc_id % 7) || '|shown]] [[Not A Slug]] `[[in-code]]` [[page-x#part]] [[page-' || (doc_id % 7) || ']]' AS body FROM documents)""")
def _(spark, d):
    k = (F.col("doc_id") % 7).cast("string")
    body = F.concat("text", F.lit(" [[page-"), k, F.lit("|shown]] [[Not A Slug]] `[[in-code]]` [[page-x#part]] [[page-"), k, F.lit("]]"))
    return docs(spark, d).select("doc_id", T.wikilinks(body).alias("slugs"))


@query("t20_words_paragraphs", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) AS BIGINT) AS n_words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS n_paragraphs FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.words(F.col("text")).cast("long").alias("n_words"), F.size(T.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("n_paragraphs"))


@query("t20_paragraph_rows", "SELECT doc_id, 'p' || lpad(CAST(k AS VARCHAR), 4, '0') AS paragraph_id, md5(p) AS digest FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents WHERE source = 'src3'))")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("k", "p"))
    return rows.select("doc_id", T.paragraph_id(F.col("k")).alias("paragraph_id"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query("t22_identity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'm-' || doc_id ELSE 'sha256:' || sha256(text) END AS article_id FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.identity(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m-"), F.col("doc_id").cast("string"))), F.col("text")).alias("article_id"))


@query("t23_cleanliness", "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'digest-stub' WHEN doc_id % 5 = 1 THEN 'media' WHEN doc_id % 19 = 0 THEN 'bleed' WHEN len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')) < 50 THEN 'short' ELSE 'ok' END AS cleanliness FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    title = F.when(k % 17 == 0, "Notes and 12 more").otherwise("Notes")
    return docs(spark, d).select("doc_id", T.cleanliness(title, F.when(k % 5 == 1, "video").otherwise("article"), k % 19 == 0, T.words(F.col("text"))).alias("cleanliness"))


@query("t24_promo_markers", "SELECT doc_id, list_concat(CASE WHEN doc_id % 4 = 1 THEN ['free_preview'] ELSE [] END, CASE WHEN doc_id % 6 = 2 THEN ['title_promo_offer'] ELSE [] END) AS markers FROM documents")
def _(spark, d):
    k = F.col("doc_id")
    body = F.concat("text", F.when(k % 4 == 1, " a FREE Preview of").otherwise(""))
    return docs(spark, d).select("doc_id", T.promo_markers(body, F.when(k % 6 == 2, "Save 20% OFF").otherwise("Notes")).alias("markers"))


@query("t25_promo_report", "SELECT source, count(*) AS n, count(*) FILTER (doc_id % 4 = 1) AS n_promo FROM documents GROUP BY source")
def _(spark, d):
    body = F.concat("text", F.when(F.col("doc_id") % 4 == 1, " free preview").otherwise(""))
    return docs(spark, d).select("source", (F.size(T.promo_markers(body, F.lit("Notes"))) > 0).alias("promo")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("promo").alias("n_promo"))


@query("t26_html_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text("html").alias("text"))


@query("t27_canonical_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://pub.substack.com/p/post-' || page_id WHEN 1 THEN 'https://open.substack.com/pub/pub/p/post-' || page_id WHEN 2 THEN 'https://www.example.com/p/post-' || page_id END AS url FROM pages")
def _(spark, d):
    k, post = F.col("page_id") % 4, F.concat(F.lit("/p/post-"), F.col("page_id").cast("string"), F.lit("?x=1"))
    html = F.concat(F.lit("<a href='"), F.when(k == 1, F.concat(F.lit("https://open.substack.com/pub/pub"), post)).when(k == 2, F.concat(F.lit("https://www.example.com"), post)).otherwise("https://www.example.com/q/other"), F.lit("'>"))
    return table(spark, d, "pages").select("page_id", T.canonical_url(html, F.when(k == 0, F.concat(F.lit("see https://pub.substack.com"), post)).otherwise("")).alias("url"))


@query("t28_content_kind", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'video' WHEN page_id % 3 = 1 THEN 'podcast' ELSE 'article' END AS kind FROM pages")
def _(spark, d):
    k = F.col("page_id") % 3
    html = F.concat("html", F.when(k == 0, "<p>Watch on Substack audio-player").when(k == 1, "<b>AUDIO-player").otherwise("<script>var x='video-player'</script>"))
    return table(spark, d, "pages").select("page_id", T.content_kind(html).alias("kind"))


@query("t35_themed_summary", "SELECT doc_id, 'About ' || source || CASE WHEN doc_id % 2 = 0 THEN '. Themes: ' || lang || ', ' || source || '.' ELSE '.' END AS summary FROM documents")
def _(spark, d):
    themes = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return docs(spark, d).select("doc_id", T.themed_summary(F.concat(F.lit("About "), "source", F.lit(".")), themes).alias("summary"))


@query("t37_token_estimate", "SELECT doc_id, CAST(round_even(n_chars * 0.5, 0) AS BIGINT) AS estimate, CAST(round_even(n_chars * 0.5, 0) AS BIGINT) + 100 <= 1000 AS fits FROM documents")
def _(spark, d):
    e = T.token_estimate(F.col("n_chars"), 0.5)
    return docs(spark, d).select("doc_id", e.alias("estimate"), T.fits(e, F.lit(100), F.lit(1000)).alias("fits"))


@query("t39_safe_source_id", "SELECT doc_id, 'raw__' || source || '__' || doc_id || '.md.' || substr(sha256('raw/' || source || '/' || doc_id || '.md'), 1, 8) AS safe FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.safe_source_id(F.concat(F.lit("raw/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("safe"))


@query("f01_scope_key", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<none>' ELSE list_aggregate(list_sort([source, lang]), 'string_agg', '+') END AS scope FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.scope_key(F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source", "lang"))).alias("scope"))


@query("f02_state_hash", "SELECT doc_id, 'sha256:' || substr(sha256(source || chr(10) || lang || chr(10)), 1, 32) AS state_hash FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.state_hash(F.array("source", "lang")).alias("state_hash"))


@query("i15_anchor_span", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'quick brown fox' END AS span FROM documents")
def _(spark, d):
    p = F.when(F.col("doc_id") % 2 == 0, "a quick brown fox ran").otherwise("a fox and a quick one")
    return docs(spark, d).select("doc_id", T.anchor_span(p, F.lit("quick"), F.lit("fox")).alias("span"))
