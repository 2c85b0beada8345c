"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from quarry.llm.line_dedup import MIN_PAGES, RATIO
from quarry.llm.quality import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, hash(ws[i]) AS h1, ws[i] || chr(1) || ws[i+1] || chr(1) || ws[i+2] || chr(1) || ws[i+3] || chr(1) || ws[i+4] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2
), n AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM r GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({STOPS}))) AS BIGINT) AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (rid)
)
SELECT *, base_failed_ AS base_failed,
  NOT base_failed_ AND coalesce(n_words BETWEEN 10 AND 1000000, true)
    AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 1.5 AND 18.0, true)
    AND coalesce(n_symbols / nullif(n_words, 0) <= 0.1, true)
    AND (n_words < 50 OR n_stop_words / n_words >= 0.005)
    AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed_ FROM m)
""".replace("SELECT *, base_failed_ AS base_failed,", "SELECT * EXCLUDE (base_failed_), base_failed_ AS base_failed,").replace("hash(ws[i]) AS h1, ", "")

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents
), l AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE text IS NOT NULL
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l
), f AS (
  SELECT source, key, count(DISTINCT rid) AS n FROM keyed WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, key
), h AS (
  SELECT source, count(*) AS pages FROM d GROUP BY source
), b AS (
  SELECT f.source, f.key FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages
), kept AS (
  SELECT keyed.rid, count(*) AS n_lines, count(b.key) AS n_dropped,
         string_agg(CASE WHEN b.key IS NULL THEN line END, chr(10) ORDER BY k) AS text
  FROM keyed LEFT JOIN b ON keyed.source IS NOT DISTINCT FROM b.source AND keyed.key = b.key
    AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY keyed.rid
)
SELECT d.doc_id, d.source, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN kept USING (rid)
"""

SQL = {"op1_quality_rules": OP1, "op10_line_dedup": OP10}
