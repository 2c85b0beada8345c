"""Line dedup by site-relative frequency, on the JVM only.

A line with a word is boilerplate of its host if it stands on at least min_pages pages of that host and on
more than ratio of them. Boilerplate lines go; every other line, blank ones included, stays where it is.

Lines are shuffled as digests, counted per host with map-side combine. What a host drops is an array of
at most (mean lines per page / ratio) digests, so the table of hosts is small in proportion to the hosts; it meets
the documents in a left join: by broadcast if it has at most BROADCAST_KEYS digests, as counted, or else by host and a salt, so
that a hot host is spread over SALTS tasks. Texts themselves are never grouped.

Defined results: null or empty text has no lines and stays as it is; a null host is a host of its own;
an empty table gives an empty table; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

RATIO, MIN_PAGES = 0.05, 5
BROADCAST_KEYS, SALTS = 200_000, 64
HAS_WORD = r"[^\x20\x09-\x0D]"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def line_key(line: Column) -> Column:
    """A digest that stands for a line without the white space around it."""
    return F.md5(F.trim(line, F.lit(" \t\n\x0b\x0c\r")).cast("binary"))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and its boilerplate line keys, sorted: one row for each host that has any."""
    keyed = pages.select(host.alias("_host"), F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)), line_key)).alias("_keys"))
    # A page adds one to the empty key and one to each of its lines: a single aggregation counts both.
    counted = keyed.select("_host", F.explode(F.concat(F.array(F.lit("")), F.coalesce("_keys", F.array().cast("array<string>")))).alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n"))
    totals = counted.where(F.col("_key") == "").select(F.col("_host").alias("_of"), F.col("_n").alias("_total"))
    lines = counted.where((F.col("_key") != "") & (F.col("_n") >= min_pages))
    frequent = lines.join(totals, lines["_host"].eqNullSafe(totals["_of"])).where(F.col("_n") > F.lit(ratio) * F.col("_total"))
    return frequent.groupBy("_host").agg(F.sort_array(F.collect_list("_key")).alias("_drop"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of text, and _n_lines, _n_dropped."""
    source = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("_h"), F.col("text").cast("string").alias("_t"))
    drops = materialize(boilerplate(source, F.col("_h"), F.col("_t"), ratio, min_pages), "boilerplate")
    same = source["_h"].eqNullSafe(drops["_host"])
    if (drops.agg(F.sum(F.size("_drop"))).first()[0] or 0) <= BROADCAST_KEYS:
        both = source.join(F.broadcast(drops), same, "left")
    else:
        salted = drops.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = source.withColumn("_s", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_s") == F.col("_salt")), "left")
    joined = both.select("_row", "_t", F.split("_t", "\n").alias("_all"), "_drop")
    keep = joined.select("_row", "_t", "_all", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda x: ~(x.rlike(HAS_WORD) & F.array_contains("_drop", line_key(x))))).alias("_kept"))
    text = F.when(F.size("_kept") == F.size("_all"), F.col("_t")).otherwise(F.array_join("_kept", "\n"))
    columns = [text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    lines = F.coalesce(F.size("_all"), F.lit(0))
    return keep.select(*columns, F.when(F.col("_t").isNull(), 0).otherwise(lines).cast("long").alias("_n_lines"), F.when(F.col("_t").isNull(), 0).otherwise(lines - F.size("_kept")).cast("long").alias("_n_dropped"))
