"""Graph intake: a compiled batch folded into new versions of all tables, as joins over the whole batch.

A batch has pages (source_id, page_pos, slug, title, page_type, body, outgoing: array or null), sources (source_id, hash, domain, ...), aliases
(alias_slug, canonical_slug, algorithm, pos) and reconcile operations (type, from, to). Phases run in their fixed order: scan refresh,
moves and deletions, entities, links and supports, derived domains, aliases, deprecation. Every phase is a function of
tables, so a failed one leaves the committed version as it was; a commit is a new version folder and a pointer.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import wikilinks

ENTITY = "slug string, title string, page_type string, status string, canonical_id string, created_at string, updated_at string, first_run_id string, last_run_id string"
SOURCE = "source_id string, status string, hash string, domain string, summary string, source_type string, first_seen_at string, last_seen_at string, ingest_state string, ingest_count long, last_run_id string, moved_to string"
LINKS = "src string, dst string, run_id string, created_at string"
SUPPORTS = "source_id string, slug string, role string, hash_at_time string, run_id string, created_at string"
ALIAS = "alias_slug string, canonical_slug string, run_id string, created_at string, algorithm string"
PENDING = "link_id string, source_slug string, target_slug string, first_run_id string, last_run_id string, created_at string, updated_at string"
TABLES = {"entity": ENTITY, "source": SOURCE, "links": LINKS, "supports": SUPPORTS, "alias_of": ALIAS, "pending": PENDING}


@dataclass
class State:
    entity: DataFrame
    source: DataFrame
    links: DataFrame
    supports: DataFrame
    alias_of: DataFrame
    pending: DataFrame


def empty(spark) -> State:
    return State(**{k: spark.createDataFrame([], v) for k, v in TABLES.items()})


def lit(x: str):
    return F.lit(x)


def latest_page(pages: DataFrame) -> DataFrame:
    """The last page of each slug in the batch."""
    return pages.withColumn("_k", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("page_pos")))).where("_k = 1").drop("_k")


def refresh_sources(s: State, scanned: DataFrame, run: str, at: str) -> State:
    """Scanned sources: first_seen_at only on creation; ingest state is never touched."""
    new = scanned.select("source_id", F.col("hash").alias("_hash"))
    x = s.source.join(new.withColumn("_new", lit(True)), "source_id", "full_outer")
    now = F.col("_new").isNotNull()
    columns = {
        "status": F.when(now, "active").otherwise(F.col("status")), "hash": F.coalesce("_hash", "hash"), "first_seen_at": F.coalesce("first_seen_at", F.when(now, lit(at))), "last_seen_at": F.when(now, lit(at)).otherwise(F.col("last_seen_at")),
        "ingest_count": F.coalesce("ingest_count", lit(0)).cast("long"), "last_run_id": F.when(now, lit(run)).otherwise(F.col("last_run_id")),
    }
    return replace(s, source=x.withColumns(columns).select(*s.source.columns))


def move_sources(s: State, moves: DataFrame) -> State:
    """MOVED (from, to): supports follow with their properties if the new source exists, else they vanish."""
    m = moves.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    known = s.source.select(F.col("source_id").alias("_known"))
    moved = s.supports.join(m, F.col("source_id") == F.col("_from")).join(known, F.col("_to") == F.col("_known"), "left_semi").withColumn("source_id", F.col("_to")).select(*s.supports.columns)
    kept = s.supports.join(m, F.col("source_id") == F.col("_from"), "left_anti")
    source = s.source.join(m, F.col("source_id") == F.col("_from"), "left").withColumns({"status": F.when(F.col("_to").isNotNull(), "moved").otherwise(F.col("status")), "moved_to": F.coalesce("_to", "moved_to")}).select(*s.source.columns)
    return replace(s, source=source, supports=kept.union(moved))


def erase(s: State, gone: DataFrame) -> State:
    """Entities gone (slug), with every edge at them; links waiting at their targets stay, those they carry go."""
    g = gone.select(F.col("slug").alias("_g")).distinct()
    anti = lambda t, c: t.join(g, F.col(c) == F.col("_g"), "left_anti")
    return replace(s, entity=anti(s.entity, "slug"), links=anti(anti(s.links, "src"), "dst"), supports=anti(s.supports, "slug"), alias_of=anti(anti(s.alias_of, "alias_slug"), "canonical_slug"), pending=anti(s.pending, "source_slug"))


def delete_sources(s: State, deleted: DataFrame) -> State:
    """DELETED (source_id): canonical entities that only those sources support go, with their aliases."""
    d = deleted.select("source_id").distinct()
    lost = s.supports.join(d, "source_id", "left_semi").select("slug").distinct()
    left = s.supports.join(d, "source_id", "left_anti").select("slug").distinct()
    canonical = s.entity.where("canonical_id IS NULL").select("slug")
    orphans = lost.join(left, "slug", "left_anti").join(canonical, "slug", "left_semi")
    aliases = s.entity.join(orphans.select(F.col("slug").alias("_c")), F.col("canonical_id") == F.col("_c"), "left_semi").select("slug")
    out = erase(s, orphans.union(aliases))
    mark = out.source.join(d.withColumn("_d", lit(True)), "source_id", "left").withColumn("status", F.when(F.col("_d"), "deleted").otherwise(F.col("status"))).select(*s.source.columns)
    return replace(out, source=mark, supports=out.supports.join(d, "source_id", "left_anti"))


def upsert_entities(s: State, pages: DataFrame, run: str, at: str) -> State:
    """created_at and first_run_id stay; canonical_id is cleared and outgoing alias edges go; a page without a status is active."""
    new = latest_page(pages).select("slug", F.col("title").alias("_title"), F.col("page_type").alias("_type"), lit(True).alias("_new"))
    x = s.entity.join(new, "slug", "full_outer")
    now = F.col("_new").isNotNull()
    pick = lambda c, v: F.when(now, v).otherwise(F.col(c))
    entity = x.select("slug", pick("title", F.col("_title")).alias("title"), pick("page_type", F.col("_type")).alias("page_type"), pick("status", lit("active")).alias("status"), pick("canonical_id", F.lit(None)).alias("canonical_id"), F.coalesce("created_at", lit(at)).alias("created_at"), pick("updated_at", lit(at)).alias("updated_at"), F.coalesce("first_run_id", lit(run)).alias("first_run_id"), pick("last_run_id", lit(run)).alias("last_run_id"))
    alias = s.alias_of.join(new.select(F.col("slug").alias("_s")), F.col("alias_slug") == F.col("_s"), "left_anti")
    return drain(replace(s, entity=entity, alias_of=alias), new.select("slug"), run, at)


def drain(s: State, arrived: DataFrame, run: str, at: str) -> State:
    """Pending links whose target arrived become links if their carrier exists and the link does not; either way they leave the ledger."""
    a = arrived.select(F.col("slug").alias("_a")).distinct()
    due = s.pending.join(a, F.col("target_slug") == F.col("_a"), "left_semi")
    carrier = due.join(s.entity.select(F.col("slug").alias("_c")), F.col("source_slug") == F.col("_c"), "left_semi").select(F.col("source_slug").alias("src"), F.col("target_slug").alias("dst")).distinct()
    new = carrier.join(s.links.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", lit(run).alias("run_id"), lit(at).alias("created_at"))
    return replace(s, links=s.links.union(new), pending=s.pending.join(a, F.col("target_slug") == F.col("_a"), "left_anti"))


def replace_links(s: State, pages: DataFrame, run: str, at: str) -> State:
    """A page's links anew, in multiplicity: its outgoing list, or else the sorted links of its body; targets that are missing wait in the ledger."""
    p = latest_page(pages)
    out = p.select(F.col("slug").alias("src"), F.explode(F.coalesce(F.col("outgoing"), wikilinks(F.coalesce("body", lit(""))))).alias("dst"))
    known = s.entity.select(F.col("slug").alias("_t"))
    there = out.join(known, F.col("dst") == F.col("_t"), "left_semi").select("src", "dst", lit(run).alias("run_id"), lit(at).alias("created_at"))
    absent = out.join(known, F.col("dst") == F.col("_t"), "left_anti").distinct().select(F.concat_ws("|", "src", "dst").alias("link_id"), F.col("src").alias("source_slug"), F.col("dst").alias("target_slug"))
    own = p.select(F.col("slug").alias("_p"))
    old = s.pending.select("link_id", F.col("first_run_id").alias("_f"), F.col("created_at").alias("_c"))
    waiting = absent.join(old, "link_id", "left").select("link_id", "source_slug", "target_slug", F.coalesce("_f", lit(run)).alias("first_run_id"), lit(run).alias("last_run_id"), F.coalesce("_c", lit(at)).alias("created_at"), lit(at).alias("updated_at"))
    return replace(s, links=s.links.join(own, F.col("src") == F.col("_p"), "left_anti").union(there), pending=s.pending.join(own, F.col("source_slug") == F.col("_p"), "left_anti").union(waiting))


def replace_supports(s: State, pages: DataFrame, sources: DataFrame, run: str, at: str) -> State:
    """The supports of the batch's sources anew; the role is primary for a source's summary page."""
    b = sources.select("source_id", "hash")
    new = pages.select("source_id", "slug", "page_type").distinct().join(b, "source_id").select("source_id", "slug", F.when(F.col("page_type") == "summary", "primary").otherwise("supporting").alias("role"), F.col("hash").alias("hash_at_time"), lit(run).alias("run_id"), lit(at).alias("created_at"))
    return replace(s, supports=s.supports.join(b, "source_id", "left_anti").union(new))


def ingest_state(s: State, sources: DataFrame, run: str) -> State:
    """Batch sources: ingested once more, with their meta data; source_type only if it is given."""
    b = sources.select("source_id", *[F.col(c).alias(f"_{c}") for c in ("hash", "domain", "summary", "source_type")], lit(True).alias("_b"))
    x = s.source.join(b, "source_id", "left")
    now = F.col("_b").isNotNull()
    return replace(s, source=x.withColumns({"ingest_state": F.when(now, "in_graph_db").otherwise(F.col("ingest_state")), "ingest_count": F.col("ingest_count") + F.when(now, 1).otherwise(0), "domain": F.when(now, F.col("_domain")).otherwise(F.col("domain")), "summary": F.when(now, F.col("_summary")).otherwise(F.col("summary")), "source_type": F.coalesce("_source_type", "source_type"), "hash": F.coalesce("_hash", "hash"), "last_run_id": F.when(now, lit(run)).otherwise(F.col("last_run_id"))}).select(*s.source.columns))


def materialize_aliases(s: State, aliases: DataFrame, run: str, at: str) -> State:
    """Aliases (the last entry of each): an entity of status and type alias; an edge only where the canonical entity exists; self-aliases are skipped."""
    a = aliases.where("alias_slug <> canonical_slug").groupBy("alias_slug").agg(F.max_by(F.struct("canonical_slug", "algorithm"), "pos").alias("x")).select(F.col("alias_slug").alias("slug"), F.col("x.canonical_slug").alias("_canonical"), F.col("x.algorithm").alias("_algorithm"))
    x = s.entity.join(a, "slug", "full_outer")
    now = F.col("_canonical").isNotNull()
    pick = lambda c, v: F.when(now, v).otherwise(F.col(c)).alias(c)
    entity = x.select("slug", F.coalesce("title", "slug").alias("title"), pick("page_type", lit("alias")), pick("status", lit("alias")), pick("canonical_id", F.col("_canonical")), F.coalesce("created_at", lit(at)).alias("created_at"), pick("updated_at", lit(at)), F.coalesce("first_run_id", lit(run)).alias("first_run_id"), pick("last_run_id", lit(run)))
    edge = a.join(s.entity.select(F.col("slug").alias("_c")), F.col("_canonical") == F.col("_c"), "left_semi").select(F.col("slug").alias("alias_slug"), F.col("_canonical").alias("canonical_slug"), lit(run).alias("run_id"), lit(at).alias("created_at"), F.col("_algorithm").alias("algorithm"))
    kept = s.alias_of.join(a.select(F.col("slug").alias("_s")), F.col("alias_slug") == F.col("_s"), "left_anti")
    return replace(s, entity=entity, alias_of=kept.union(edge))


def deprecate(s: State, before: DataFrame, pages: DataFrame, run: str, at: str) -> State:
    """What the batch's sources supported before and no source supports now is deprecated."""
    lost = before.select("slug").distinct().join(pages.select("slug"), "slug", "left_anti").join(s.supports.select("slug"), "slug", "left_anti").withColumn("_lost", lit(True))
    x = s.entity.join(lost, "slug", "left")
    hit = F.coalesce(F.col("_lost") & F.col("canonical_id").isNull() & (F.col("status") != "deprecated"), lit(False))
    return replace(s, entity=x.withColumns({"status": F.when(hit, "deprecated").otherwise(F.col("status")), "updated_at": F.when(hit, lit(at)).otherwise(F.col("updated_at")), "last_run_id": F.when(hit, lit(run)).otherwise(F.col("last_run_id"))}).select(*s.entity.columns))


def apply_batch(s: State, pages: DataFrame, sources: DataFrame, aliases: DataFrame, scanned: DataFrame, reconcile: DataFrame, run: str, at: str) -> State:
    """All phases of one compiled batch."""
    s = refresh_sources(s, scanned, run, at)
    s = move_sources(s, reconcile.where("type = 'MOVED'"))
    s = delete_sources(s, reconcile.where("type = 'DELETED'").select(F.col("from").alias("source_id")))
    before = s.supports.join(sources.select("source_id"), "source_id", "left_semi")
    s = upsert_entities(s, pages, run, at)
    s = replace_links(s, pages, run, at)
    s = replace_supports(s, pages, sources, run, at)
    s = ingest_state(s, sources, run)
    s = materialize_aliases(s, aliases, run, at)
    return deprecate(s, before, pages, run, at)


def retract(s: State, slugs: DataFrame) -> State:
    """A cleanup: the slugs go, with every edge at them."""
    return erase(s, slugs)


def rebuild(spark, batches: list[tuple]) -> State:
    """All batches replayed in order, from nothing; each is committed before the next (see sources.versions)."""
    from quarry.sources.versions import commit, load

    path, version = None, 0
    state = empty(spark)
    for batch in batches:
        state = apply_batch(state, *batch)
        path, version = commit(state, path)
        state = load(spark, path, version)
    return state
