"""Compiled pages: alias maps, merging of pages, checks and digests of a result, and the status of calls.

Pages are rows (cs_idx, p_idx, source_id, slug, page_type, body, supports); their order is (cs_idx, p_idx).
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.fixpoint import keep

# How each API spells a stop at its output cap, and an ordinary one.
CAP_STOPS = {"openai_compat": "length", "anthropic": "max_tokens", "gemini": "MAX_TOKENS"}
OK_STOPS = {"openai_compat": "stop", "anthropic": "end_turn", "gemini": "STOP"}
MOST_KEYS = 10


def alias_map(ledger: DataFrame) -> DataFrame:
    """surface, canonical: normalised, each surface with the end of its chain, found by pointer doubling.

    Pairs that normalise to nothing or to one slug leave. ValueError for a surface with two canonicals, and for a cycle.
    """
    pairs = ledger.select(T.slugify(F.col("surface")).alias("surface"), T.slugify(F.col("canonical")).alias("canonical"))
    hops = keep(pairs.where("surface IS NOT NULL AND canonical IS NOT NULL AND surface <> canonical").distinct())
    n = hops.count()
    if hops.groupBy("surface").count().where("count > 1").head(1):
        raise ValueError("a surface has several canonicals")
    for _ in range(n.bit_length() + 1):
        onward = hops.select(F.col("surface").alias("_s"), F.col("canonical").alias("_c"))
        joined = keep(hops.join(onward, F.col("canonical") == F.col("_s"), "left"))
        if not joined.where("_s IS NOT NULL").head(1):
            return hops
        hops = joined.select("surface", F.coalesce("_c", "canonical").alias("canonical"))
    raise ValueError("aliases run in a circle")


def resolved(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """pages with norm (the slug normalised) and canonical."""
    known = aliases.select(F.col("surface").alias("norm"), F.col("canonical").alias("_to"))
    return pages.withColumn("norm", T.slugify(F.col("slug"))).join(known, "norm", "left").withColumn("canonical", F.coalesce("_to", "norm")).drop("_to")


def merged_pages(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """canonical, cs_idx, p_idx, body, supports, n_pages, strategy, error: a page for each canonical slug, at its winner's place.

    The first page that has the canonical slug wins, else the first of the longest bodies. Supports are all contenders', each where it
    comes first. error: a summary page was renamed or merged. Winners come from aggregates, so a group's bodies never meet in a task.
    """
    own = resolved(pages, aliases).withColumn("_named", F.col("norm") == F.col("canonical"))
    order = F.struct((~F.col("_named")).alias("later"), F.when(F.col("_named"), 0).otherwise(-F.length("body")).alias("shorter"), "cs_idx", "p_idx")
    groups = own.groupBy("canonical").agg(F.min(order).alias("_w"), F.count("*").alias("n_pages"), F.max("_named").alias("_any"), F.max(F.col("page_type") == "summary").alias("_summary"))
    each = own.select("canonical", F.posexplode("supports").alias("_k", "_s"), "cs_idx", "p_idx").groupBy("canonical", "_s").agg(F.min(F.struct("cs_idx", "p_idx", "_k")).alias("_at"))
    supports = each.groupBy("canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("supports"))
    strategy = F.when((F.col("n_pages") == 1) & F.col("_any"), "kept").when(F.col("n_pages") == 1, "alias-singleton-rename").when(F.col("_any"), "canonical-wins").otherwise("longest-wins")
    won = groups.select("canonical", "n_pages", strategy.alias("strategy"), F.col("_w.cs_idx").alias("cs_idx"), F.col("_w.p_idx").alias("p_idx"), (F.col("_summary") & (strategy != "kept")).alias("error"))
    bodies = own.select("cs_idx", "p_idx", "body")
    return won.join(bodies, ["cs_idx", "p_idx"]).join(supports, "canonical", "left").select("canonical", "cs_idx", "p_idx", "body", F.coalesce("supports", F.array().cast("array<string>")).alias("supports"), "n_pages", "strategy", "error")


def aliases_emitted(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias, canonical and the place (cs_idx, p_idx) where it was first used: the renames in the order of use, each once."""
    used = resolved(pages, aliases).where("norm <> canonical")
    return used.groupBy(F.col("norm").alias("alias"), "canonical").agg(F.min(F.struct("cs_idx", "p_idx")).alias("_at")).select("alias", "canonical", "_at.cs_idx", "_at.p_idx")


def violations(pages: DataFrame) -> DataFrame:
    """kind, source_id, slug, n: duplicate slugs of a source, not just one summary, a summary of another slug than the source's, reserved slugs."""
    duplicate = pages.groupBy("source_id", "slug").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_slug").alias("kind"), "source_id", "slug", "n")
    summaries = pages.groupBy("source_id").agg(F.count_if(F.col("page_type") == "summary").alias("n"), F.min(F.when(F.col("page_type") == "summary", F.col("slug"))).alias("slug"))
    missing = summaries.where("n <> 1").select(F.lit("summary_slug_missing").alias("kind"), "source_id", F.lit(None).cast("string").alias("slug"), "n")
    other = summaries.where((F.col("n") == 1) & (F.col("slug") != T.summary_slug(F.col("source_id")))).select(F.lit("summary_slug_mismatch").alias("kind"), "source_id", "slug", "n")
    reserved = pages.where(F.col("slug").startswith("summary-") & (F.col("page_type") != "summary")).groupBy("source_id", "slug").agg(F.count("*").alias("n")).select(F.lit("reserved_slug").alias("kind"), "source_id", "slug", "n")
    return duplicate.unionByName(missing).unionByName(other).unionByName(reserved)


def response_digest(pages: DataFrame) -> DataFrame:
    """cs_idx, n_pages, page_types (type to number), n_links, summary_slug (if there is just one summary): a result's shape, without bodies."""
    types = pages.where("page_type IS NOT NULL").groupBy("cs_idx", "page_type").count().groupBy("cs_idx").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page_type", "count")))).alias("page_types"))
    summary = F.when(F.col("page_type") == "summary", F.col("slug"))
    counts = pages.groupBy("cs_idx").agg(F.count("*").alias("n_pages"), F.sum(F.size(T.wikilinks(F.col("body")))).alias("n_links"), F.when(F.count(summary) == 1, F.min(summary)).alias("summary_slug"))
    return counts.join(types, "cs_idx", "left").select("cs_idx", "n_pages", F.coalesce("page_types", F.create_map().cast("map<string,bigint>")).alias("page_types"), "n_links", "summary_slug")


def last_domains(pages: DataFrame) -> DataFrame:
    """slug, domain: of the last page, in order, that emits the slug; null if that one has none."""
    return pages.groupBy("slug").agg(F.max_by("domain", F.struct("cs_idx", "p_idx")).alias("domain"))


def combined(results: DataFrame) -> DataFrame:
    """run_id, notes, aliases: a run's results (run_id, ordinal, notes, aliases) put together in order. A run's record is one row by its nature."""
    rows = results.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "notes", "aliases"))).alias("_r"))
    one = lambda c: F.flatten(F.transform("_r", lambda r: F.coalesce(r[c], F.array().cast("array<string>"))))
    return rows.select("run_id", one("notes").alias("notes"), one("aliases").alias("aliases"))


def final_status(error: Column, repaired: Column, attempts: Column) -> Column:
    """Of a compiled source; repaired: by syntax, slug or boundary."""
    fixed = F.coalesce(repaired, F.lit(False))
    return F.when(error.isNotNull(), "quarantined").when(fixed & (attempts == 2), "retried-and-repaired").when(fixed, "repaired").when(attempts > 1, "retried").otherwise("clean")


def normalized_stop(raw: Column, api: Column) -> Column:
    """output_cap, complete, or unknown: nothing is guessed."""
    spelled = lambda by: F.try_element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), api) == raw
    return F.when(spelled(CAP_STOPS), "output_cap").when(spelled(OK_STOPS), "complete").otherwise("unknown")


def recency(first_run_id: Column, run_id: Column) -> Column:
    return F.when(first_run_id.isNull(), "age_unknown").when(first_run_id == run_id, "cohort").otherwise("pre_run")


def first_keys(keys: Column) -> Column:
    """The search keys that a request may have."""
    return F.slice(keys, 1, MOST_KEYS)


def first_match(path: Column, globs: list[str]) -> Column:
    """The first of the globs that a path matches; null: none. The rules are a list in the code or its configuration."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(path.rlike("^" + fnmatch.translate(g).replace(r"\Z", r"\z").replace(r"\z", "$")), g) for g in globs])


def overridden(rows: DataFrame, force_signal: list[str], force_noise: list[str]) -> DataFrame:
    """rows (path, kdb_signal, reject_reason) with rule, match and what they change: noise goes before signal, the first match of a list counts."""
    noise, signal = first_match(F.col("path"), force_noise), first_match(F.col("path"), force_signal)
    own = rows.withColumns({"_n": noise, "_s": signal}).withColumn("rule", F.when(F.col("_n").isNotNull(), "force_noise").when(F.col("_s").isNotNull(), "force_signal"))
    reason = F.when((F.col("rule") == "force_noise") & (F.col("kdb_signal") == "signal"), F.concat(F.lit("deterministic override via force_noise: "), "_n"))
    reason = reason.when((F.col("rule") == "force_signal") & (F.col("kdb_signal") == "noise"), F.lit(None)).otherwise(F.col("reject_reason"))
    forced = F.when(F.col("rule") == "force_noise", "noise").when(F.col("rule") == "force_signal", "signal").otherwise(F.col("kdb_signal"))
    return own.withColumns({"match": F.when(F.col("rule") == "force_noise", F.col("_n")).when(F.col("rule") == "force_signal", F.col("_s")), "reject_reason": reason, "kdb_signal": forced}).drop("_n", "_s")


def feeder_outcomes(messages: DataFrame, seen_ids: DataFrame, seen_urls: DataFrame) -> DataFrame:
    """message_id, outcome, dedup_of: skipped, promo, dedup or converted, of messages (message_id, ordinal, url, promo, filename).

    Promotions stand before duplicates and block no later message of their address. Of a new address the first message is converted, found by an
    aggregate; the others are its duplicates. Messages without an address are no duplicates.
    """
    new = messages.join(seen_ids.select("message_id").withColumn("_seen", F.lit(True)), "message_id", "left")
    open_ = F.col("_seen").isNull() & ~F.col("promo")
    firsts = new.where(open_ & F.col("url").isNotNull()).groupBy("url").agg(F.min_by(F.struct("message_id", "filename"), F.struct("ordinal", "message_id")).alias("_first"))
    known = seen_urls.select("url", F.col("filename").alias("_known"))
    rows = new.join(firsts, "url", "left").join(known, "url", "left")
    dedup = F.coalesce("_known", F.when(F.col("_first.message_id") != F.col("message_id"), F.col("_first.filename")))
    outcome = F.when(F.col("_seen").isNotNull(), "skipped").when(F.col("promo"), "promo").when(dedup.isNotNull(), "dedup").otherwise("converted")
    return rows.select("message_id", outcome.alias("outcome"), F.when(outcome == "dedup", dedup).alias("dedup_of"))
