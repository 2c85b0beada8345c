"""Graph reads: neighbourhoods, paths, provenance, counts and key resolution, all as joins over whole sets of slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.fixpoint import keep
from quarry.plans.graph_view import Graph

DIRECTIONS = ("in", "out", "both")


def hops(links: DataFrame, direction: str) -> DataFrame:
    """(a, b): one step from a to b."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    out, back = links.select(F.col("src").alias("a"), F.col("dst").alias("b")), links.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def neighbors(links: DataFrame, starts: DataFrame, direction: str = "out", depth: int = 1) -> DataFrame:
    """start, slug: what is reached from each start (column slug) in 1..depth steps, itself excluded; a frontier join per step."""
    if depth < 1:
        raise ValueError("depth is at least 1")
    step = hops(links, direction)
    seen = starts.select(F.col("slug").alias("start"), "slug").distinct()
    front = seen
    for _ in range(depth):
        reached = front.join(step, F.col("slug") == F.col("a")).select("start", F.col("b").alias("slug")).distinct()
        front = keep(reached.join(seen, ["start", "slug"], "left_anti"))
        seen = seen.union(front)
    return seen.where("start != slug").select("start", "slug")


def shortest_path(links: DataFrame, entity: DataFrame, start: str, end: str, max_hops: int = 6) -> DataFrame:
    """slug_path, hops: one row with the directed path of fewest hops, the least by slugs among equals; none if there is none."""
    if max_hops < 1:
        raise ValueError("max_hops is at least 1")
    here = entity.where(F.col("slug") == start).select(F.array("slug").alias("path"), "slug")
    if start == end:
        return here.select(F.col("path").alias("slug_path"), F.lit(0).cast("long").alias("hops"))
    step, seen, front = hops(links, "out"), here.select("slug"), here
    for _ in range(max_hops):
        reached = front.join(step, F.col("slug") == F.col("a")).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("slug"))
        front = keep(reached.join(seen, "slug", "left_anti").groupBy("slug").agg(F.min("path").alias("path")).select("path", "slug"))
        if front.where(F.col("slug") == end).head(1) or not front.head(1):
            break
        seen = seen.union(front.select("slug"))
    return front.where(F.col("slug") == end).select(F.col("path").alias("slug_path"), (F.size("path") - 1).cast("long").alias("hops"))


def entities_for_source(g: Graph, source_id: str) -> DataFrame:
    return g.supports.where(F.col("source_id") == source_id).join(g.entity.select("slug", "title", "page_type"), "slug").select("slug", "title", "page_type").distinct()


def sources_for_entity(g: Graph, slug: str) -> DataFrame:
    return g.supports.where(F.col("slug") == slug).join(g.source.select("source_id", "domain"), "source_id").select("source_id", "domain").distinct()


def subgraph_by_source(g: Graph, source_id: str) -> DataFrame:
    """src, dst of links whose two ends the source supports."""
    own = g.supports.where(F.col("source_id") == source_id).select("slug").distinct()
    return g.links.join(own, F.col("src") == F.col("slug"), "left_semi").join(own, F.col("dst") == F.col("slug"), "left_semi").select("src", "dst")


def active_canonical(entity: DataFrame) -> DataFrame:
    return entity.where("status = 'active' AND canonical_id IS NULL")


def belongs_to(g: Graph) -> DataFrame:
    """slug, domain, support_count of canonical entities: distinct sources per domain; a null or empty domain is none."""
    canonical = g.entity.where("canonical_id IS NULL").select("slug")
    return g.supports.join(g.source.where("domain <> ''").select("source_id", "domain"), "source_id").join(canonical, "slug", "left_semi").groupBy("slug", "domain").agg(F.countDistinct("source_id").alias("support_count"))


def supports_counts(g: Graph) -> DataFrame:
    """slug, n_sources of every active canonical page that is not a summary, those without a source included."""
    n = g.supports.groupBy("slug").agg(F.countDistinct("source_id").alias("n"))
    return active_canonical(g.entity).where("page_type <> 'summary'").select("slug").join(n, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n_sources"))


def first_run_ids(g: Graph, wanted: DataFrame) -> DataFrame:
    """Every wanted slug with the first_run_id of its active entity; null where that is unknown or empty."""
    known = g.entity.where("status = 'active'").select("slug", F.nullif("first_run_id", F.lit("")).alias("first_run_id"))
    return wanted.select("slug").distinct().join(known, "slug", "left")


def resolve(g: Graph, keys: DataFrame) -> DataFrame:
    """key, canonical_slug, first_run_id of every distinct trimmed key that resolves to an active entity.

    canonical_id goes before an alias edge, which goes before the entity itself; a declared alias whose target is not active does not fall back.
    """
    wanted = keys.select(F.trim("key").alias("key")).where("key <> ''").distinct()
    own = g.entity.select(F.col("slug").alias("key"), "status", "canonical_id")
    alias = g.alias_of.groupBy(F.col("alias_slug").alias("key")).agg(F.min("canonical_slug").alias("alias_to"))
    to = wanted.join(own, "key").join(alias, "key", "left").select("key", F.coalesce("canonical_id", "alias_to", F.when(F.col("status") == "active", F.col("key"))).alias("canonical_slug"))
    live = g.entity.where("status = 'active'").select(F.col("slug").alias("canonical_slug"), F.nullif("first_run_id", F.lit("")).alias("first_run_id"))
    return to.join(live, "canonical_slug").select("key", "canonical_slug", "first_run_id")


def stats(g: Graph) -> DataFrame:
    """name, n: a count per table and status."""
    parts = [
        g.entity.groupBy(F.concat(F.lit("entities_"), F.col("status")).alias("name")).count(),
        g.entity.groupBy(F.concat(F.lit("pages_"), F.col("page_type")).alias("name")).count(),
        *[t.groupBy(F.lit(name).alias("name")).count() for name, t in (("entities", g.entity), ("sources", g.source), ("links_to", g.links), ("supports", g.supports), ("alias_of", g.alias_of), ("belongs_to", belongs_to(g)))],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumnRenamed("count", "n")


def domains(g: Graph) -> DataFrame:
    return belongs_to(g).groupBy("domain").agg(F.count("*").alias("n_entities"))


def domain_pool(g: Graph, domain: str) -> DataFrame:
    """Active entities of a domain."""
    return active_canonical(g.entity).join(belongs_to(g).where(F.col("domain") == domain), "slug", "left_semi").select("slug", "title", "page_type")


def graph_kpis(g: Graph, run_id: str, share_of_largest: DataFrame, domain_count: int = 23) -> DataFrame:
    """One row of graph KPIs; a KPI whose population is empty is null."""
    counts = supports_counts(g).agg(F.count("*").alias("pages"), F.count_if(F.col("n_sources") >= 2).alias("reused"))
    active = active_canonical(g.entity).select("slug")
    live = active.agg(F.count("*").alias("active"))
    status = g.entity.where("status = 'active'").select("slug")
    between = g.links.join(status, F.col("src") == status["slug"], "left_semi").join(status, F.col("dst") == status["slug"], "left_semi").agg(F.count("*").alias("links"))
    sources = g.source.agg(F.count("*").alias("sources"), F.count_if(F.col("domain").isNull() | (F.col("domain") == "")).alias("no_domain"))
    supports = g.supports.agg(F.count("*").alias("supports"))
    everything = g.entity.agg(F.count("*").alias("entities"), F.count_if((F.col("status") == "deprecated") & (F.col("last_run_id") == run_id)).alias("gone"))
    derived = belongs_to(g)
    covered = active.join(derived, "slug", "left_semi").agg(F.count("*").alias("covered"))
    breadth = derived.agg(F.countDistinct("domain").alias("breadth"))
    row = counts
    for other in (live, between, sources, supports, everything, covered, breadth, share_of_largest):
        row = row.crossJoin(other)  # each has one row
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return row.select(
        ratio("reused", "pages").alias("entity_reuse"), F.round("share", 6).alias("graph_connectivity"), ratio("links", "active").alias("link_density"), ratio("supports", "sources").alias("supports_density"),
        ratio("gone", "entities").alias("deprecation_rate"), ratio("covered", "active").alias("belongs_to_coverage"), ratio("no_domain", "sources").alias("domain_null_rate"), F.round(F.col("breadth") / domain_count, 6).alias("domain_breadth"),
    )


def when_missing(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
