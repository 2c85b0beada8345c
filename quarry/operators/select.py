"""Two-stage budgeted entity selection: what comes before and after the model's answers, which are an input column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits and reserves of the two stages.
THIN_CAP, FAT_CAP, SHARE, BYTES_PER_TOKEN, OVERHEAD = 150, 50, 0.8, 4, 16_000
VISIBLE = {"thin": 20_000, "fat": 10_000}
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "


def one_line(text: Column) -> Column:
    """Line breaks of any kind as spaces."""
    return F.translate(text, LINE_BREAKS, " " * len(LINE_BREAKS))


def thin_line(slug: Column, page_type: Column, title: Column) -> Column:
    return F.concat_ws(" | ", slug, page_type, one_line(title))


def fat_block(line: Column, body: Column) -> Column:
    """The identity line, then the body's lines, each indented, blank ones too; only the line without a body."""
    return F.when(body.isNull(), line).otherwise(F.concat(line, F.lit("\n"), F.array_join(F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")))


def tokens(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / BYTES_PER_TOKEN).cast("long")


def budget(window: Column, stage: str) -> Column:
    """Tokens for the request of a stage: the usable window less the reserve."""
    return F.floor(window * SHARE).cast("long") - (VISIBLE[stage] + OVERHEAD)


def search_space(entity: DataFrame, in_domain: DataFrame, tier1: DataFrame, page_types: tuple[str, ...] = ("summary", "concept", "article")) -> DataFrame:
    """Active entities of the domain that the source does not support itself."""
    active = entity.where("status = 'active' AND canonical_id IS NULL").where(F.col("page_type").isin(*page_types))
    return active.join(in_domain.select("slug"), "slug", "left_semi").join(tier1.select("slug"), "slug", "left_anti").select("slug", "title", "page_type")


def filled(candidates: DataFrame, allowance: int, *by: str) -> DataFrame:
    """Candidates (rank, cost and by) of the longest prefix by rank that costs at most allowance: it stops at the first that does not fit."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = candidates.withColumn("_spent", F.sum("cost").over(w))
    return spent.where(F.col("_spent") <= allowance).drop("_spent")  # costs are not negative, so what fits is a prefix


def salvaged(answers: DataFrame, space: DataFrame, cap: int = THIN_CAP) -> DataFrame:
    """request, place, slug, kept, reason of each returned item (request, place, slug): malformed (null or blank), foreign to the space, a repeat, or over the cap of what is left."""
    s = F.trim("slug")
    rows = answers.withColumn("slug", s).join(space.select(F.col("slug").alias("_known")).distinct(), F.col("slug") == F.col("_known"), "left")
    first = F.row_number().over(Window.partitionBy("request", "slug").orderBy("place")) == 1
    bad = F.when(F.coalesce(F.col("slug"), F.lit("")) == "", "malformed").when(F.col("_known").isNull(), "foreign").when(~first, "duplicate")
    rows = rows.withColumn("reason", bad)
    nth = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(Window.partitionBy("request").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (nth > cap), "over_cap").otherwise(F.col("reason")))
    return rows.select("request", "place", "slug", F.col("reason").isNull().alias("kept"), "reason")


def salvage_counts(items: DataFrame) -> DataFrame:
    n = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return items.groupBy("request").agg(F.count("*").alias("returned"), F.count_if("kept").alias("kept"), n("malformed"), n("foreign"), n("duplicate"), n("over_cap"))


def response_class(parsed: Column, usable_shape: Column, returned: Column, kept: Column) -> Column:
    return F.when(~parsed, "unparseable").when(~usable_shape, "structurally_unusable").when((returned > 0) & (kept == 0), "all_dropped").otherwise("usable")


def stage_outcomes(attempts: DataFrame) -> DataFrame:
    """request, outcome, attempts, input_tokens, output_tokens from (request, attempt, class, stop, input_tokens, output_tokens); sums of unknowns are unknown."""
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    last = F.max_by(F.struct("class", "stop"), "attempt")
    usable = F.max(F.when(F.col("class") == "usable", 1).otherwise(0)) == 1
    outcome = F.when(usable, "usable").when(last["stop"] == "length", "output_truncation").when(last["stop"] == "input", "input_estimation_miss").otherwise("exhausted")
    return attempts.groupBy("request").agg(outcome.alias("outcome"), F.count("*").alias("attempts"), total("input_tokens"), total("output_tokens"))


def accounting(requests: DataFrame) -> DataFrame:
    """request, matched, unresolved (both in request order), unattributed, cap_exhausted from asked, answered (arrays) and n_kept."""
    return requests.select(
        "request", F.filter("asked", lambda x: F.array_contains("answered", x)).alias("matched"), F.filter("asked", lambda x: ~F.array_contains("answered", x)).alias("unresolved"),
        F.size(F.array_except("answered", "asked")).cast("long").alias("unattributed"), (F.col("n_kept") >= FAT_CAP).alias("cap_exhausted"),
    )


def concordance(fat: Column, thin: Column) -> Column:
    """Share of the first ten of fat among the first twenty of thin; null if either is null or fat is empty."""
    head = F.slice(fat, 1, 10)
    return F.when(fat.isNotNull() & thin.isNotNull(), F.try_divide(F.size(F.array_intersect(head, F.slice(thin, 1, 20))), F.size(head)))


def snapshot_hash(space: DataFrame) -> DataFrame:
    """A digest of (slug, title, page_type) in the order of slugs, part by part."""
    part = F.pmod(F.xxhash64("slug"), F.lit(64))
    each = space.groupBy(part.alias("p")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("slug", "title", "page_type")))), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("snapshot"))


def context(pages: DataFrame, cap: int = 50, page_types: tuple[str, ...] = ("summary", "concept", "article")) -> DataFrame:
    """Context pages per source from (source_id, slug, tier, rank, pagerank, page_type): best tier of each slug, tier 1 whole, the others together up to cap; then pages of other types go."""
    best = pages.withColumn("_k", F.row_number().over(Window.partitionBy("source_id", "slug").orderBy("tier", F.col("rank").asc_nulls_last()))).where("_k = 1")
    order = Window.partitionBy("source_id", F.col("tier") == 1).orderBy("tier", F.col("rank").asc_nulls_last(), F.desc("pagerank"), "slug")
    kept = best.withColumn("_n", F.row_number().over(order)).where((F.col("tier") == 1) | (F.col("_n") <= cap))
    return kept.where(F.col("page_type").isin(*page_types)).drop("_k", "_n")
