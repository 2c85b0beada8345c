"""Graph reads, analytics and integrity over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import reads as R
from quarry.operators import verify as V
from quarry.plans.graph_view import PRELUDE, graph_view
from quarry.queries.registry import query


def sql(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{PRELUDE}{''.join(', ' + m for m in more)} {body}"


KPI_RUN, START, END, SOURCE, PAGE = "run-3", "part-15", "part-105", "order-7", "part-1"


@query("c10_active_canonical", sql("SELECT slug, page_type FROM active"))
def _(spark, d):
    return R.active_canonical(graph_view(spark, d).entity).select("slug", "page_type")


@query("c10_supports_counts", sql("SELECT a.slug, CAST(count(DISTINCT u.source_id) AS BIGINT) AS n_sources FROM active a LEFT JOIN supports u ON a.slug = u.slug WHERE page_type <> 'summary' GROUP BY a.slug"))
def _(spark, d):
    return R.supports_counts(graph_view(spark, d))


@query("b12_belongs_to", sql("SELECT * FROM belongs"))
def _(spark, d):
    return R.belongs_to(graph_view(spark, d))


@query("c14_domains", sql("SELECT domain, CAST(count(*) AS BIGINT) AS n_entities FROM belongs GROUP BY domain"))
def _(spark, d):
    return R.domains(graph_view(spark, d))


@query("c04_entities_for_source", sql(f"SELECT DISTINCT slug, title, page_type FROM supports JOIN entity USING (slug) WHERE source_id = '{SOURCE}'"))
def _(spark, d):
    return R.entities_for_source(graph_view(spark, d), SOURCE)


@query("c04_sources_for_entity", sql(f"SELECT DISTINCT source_id, domain FROM supports JOIN source USING (source_id) WHERE slug = '{PAGE}'"))
def _(spark, d):
    return R.sources_for_entity(graph_view(spark, d), PAGE)


@query("c05_subgraph", sql(f"SELECT src, dst FROM links WHERE src IN (SELECT slug FROM supports WHERE source_id = '{SOURCE}') AND dst IN (SELECT slug FROM supports WHERE source_id = '{SOURCE}')"))
def _(spark, d):
    return R.subgraph_by_source(graph_view(spark, d), SOURCE)


@query("c06_deprecated", sql("SELECT slug, title, last_run_id FROM entity WHERE status = 'deprecated'"))
def _(spark, d):
    return graph_view(spark, d).entity.where("status = 'deprecated'").select("slug", "title", "last_run_id")


@query("c08_domain_pool", sql("SELECT slug, title, e.page_type FROM entity e JOIN active USING (slug) WHERE slug IN (SELECT slug FROM belongs WHERE domain = 'BUILDING')"))
def _(spark, d):
    return R.domain_pool(graph_view(spark, d), "BUILDING")


@query("c08_neighbor_slugs", sql("SELECT slug, direction, neighbor FROM (SELECT src AS slug, 'out' AS direction, dst AS neighbor FROM links UNION SELECT dst, 'in', src FROM links)"))
def _(spark, d):
    links = graph_view(spark, d).links
    return links.select(F.col("src").alias("slug"), F.lit("out").alias("direction"), F.col("dst").alias("neighbor")).union(links.select("dst", F.lit("in"), "src")).distinct()


WANTED = "SELECT 'part-' || p_partkey AS slug FROM part UNION ALL SELECT 'missing-' || p_partkey FROM part WHERE p_partkey % 50 = 0"


@query("c09_first_run_ids", sql("SELECT w.slug, nullif(e.first_run_id, '') AS first_run_id FROM w LEFT JOIN entity e ON w.slug = e.slug AND e.status = 'active'", f"w AS ({WANTED})"))
def _(spark, d):
    g = graph_view(spark, d)
    missing = g.entity.where("substr(slug, 6) % 50 = 0").select(F.concat(F.lit("missing-"), F.expr("substr(slug, 6)")).alias("slug"))
    return R.first_run_ids(g, g.entity.select("slug").union(missing))


@query(
    "c11_resolution",
    sql(
        """SELECT key, canonical_slug, nullif(first_run_id, '') AS first_run_id FROM (
          SELECT w.slug AS key, coalesce(e.canonical_id, a.canonical_slug, CASE WHEN e.status = 'active' THEN e.slug END) AS canonical_slug
          FROM w JOIN entity e ON w.slug = e.slug LEFT JOIN alias_of a ON a.alias_slug = w.slug
        ) JOIN (SELECT slug, first_run_id FROM entity WHERE status = 'active') t ON canonical_slug = t.slug""",
        f"w AS ({WANTED})",
    ),
)
def _(spark, d):
    g = graph_view(spark, d)
    return R.resolve(g, g.entity.select(F.concat(F.lit(" "), "slug", F.lit(" ")).alias("key")))


@query(
    "b16_stats",
    sql("""SELECT 'entities_' || status AS name, count(*) AS n FROM entity GROUP BY 1 UNION ALL SELECT 'pages_' || page_type, count(*) FROM entity GROUP BY 1
      UNION ALL SELECT 'entities', count(*) FROM entity UNION ALL SELECT 'sources', count(*) FROM source UNION ALL SELECT 'links_to', count(*) FROM links
      UNION ALL SELECT 'supports', count(*) FROM supports UNION ALL SELECT 'alias_of', count(*) FROM alias_of UNION ALL SELECT 'belongs_to', count(*) FROM belongs"""),
)
def _(spark, d):
    return R.stats(graph_view(spark, d))


COMPONENTS = (
    "und AS (SELECT src AS a, dst AS b FROM links WHERE src <> dst AND src IN (SELECT slug FROM active) AND dst IN (SELECT slug FROM active) UNION SELECT dst, src FROM links WHERE src <> dst AND src IN (SELECT slug FROM active) AND dst IN (SELECT slug FROM active))",
    "reach AS (SELECT slug AS slug, slug AS other FROM active UNION SELECT r.slug, u.b FROM reach r JOIN und u ON r.other = u.a)",
    "comp AS (SELECT slug, min(other) AS component FROM reach GROUP BY slug)",
)


@query("d06_components", sql("SELECT slug, component FROM comp", *COMPONENTS, recursive=True))
def _(spark, d):
    g = graph_view(spark, d)
    return A.components(R.active_canonical(g.entity), g.links)


@query(
    "m03_graph_kpis",
    sql(
        f"""SELECT
      round((SELECT count(*) FILTER (n >= 2) / count(*) FROM (SELECT a.slug, count(DISTINCT source_id) AS n FROM active a LEFT JOIN supports u ON a.slug = u.slug WHERE page_type <> 'summary' GROUP BY a.slug)), 6) AS entity_reuse,
      round((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)), 6) AS graph_connectivity,
      round((SELECT count(*) FROM links WHERE src IN (SELECT slug FROM entity WHERE status = 'active') AND dst IN (SELECT slug FROM entity WHERE status = 'active')) / (SELECT count(*) FROM active), 6) AS link_density,
      round((SELECT count(*) FROM supports) / (SELECT count(*) FROM source), 6) AS supports_density,
      round((SELECT count(*) FILTER (status = 'deprecated' AND last_run_id = '{KPI_RUN}') / count(*) FROM entity), 6) AS deprecation_rate,
      round((SELECT count(*) FROM active WHERE slug IN (SELECT slug FROM belongs)) / (SELECT count(*) FROM active), 6) AS belongs_to_coverage,
      round((SELECT count(*) FILTER (domain IS NULL OR domain = '') / count(*) FROM source), 6) AS domain_null_rate,
      round((SELECT count(DISTINCT domain) FROM belongs) / 23, 6) AS domain_breadth""",
        *COMPONENTS,
        recursive=True,
    ),
)
def _(spark, d):
    g = graph_view(spark, d)
    return R.graph_kpis(g, KPI_RUN, A.largest_share(A.components(R.active_canonical(g.entity), g.links)))


def neighbors_sql(direction: str, depth: int) -> str:
    step = {"out": "SELECT src AS a, dst AS b FROM links", "in": "SELECT dst, src FROM links", "both": "SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links"}[direction]
    return sql("SELECT DISTINCT start, slug FROM walk WHERE start <> slug", f"step(a, b) AS ({step})", f"walk AS (SELECT slug AS start, slug, 0 AS k FROM active UNION SELECT w.start, s.b, k + 1 FROM walk w JOIN step s ON w.slug = s.a WHERE k < {depth})", recursive=True)


for _direction, _depth in (("out", 1), ("in", 1), ("out", 2), ("both", 3)):

    @query(f"c01_neighbors_{_direction}_{_depth}" if (_direction, _depth) != ("out", 2) else "c01_neighbors_2", neighbors_sql(_direction, _depth))
    def _(spark, d, direction=_direction, depth=_depth):
        g = graph_view(spark, d)
        return R.neighbors(g.links, R.active_canonical(g.entity), direction, depth)


START_SQL = "(SELECT min(a.src) FROM links a JOIN links b ON a.dst = b.src WHERE a.src <> b.dst)"


@query(
    "c03_shortest_path",
    sql(
        "SELECT path AS slug_path, CAST(len(path) - 1 AS BIGINT) AS hops FROM walk WHERE slug = (SELECT dst FROM target) ORDER BY len(path), path LIMIT 1",
        f"target AS (SELECT max(b.dst) AS dst FROM links a JOIN links b ON a.dst = b.src WHERE a.src = {START_SQL} AND b.dst <> a.src)",
        f"walk AS (SELECT {START_SQL} AS slug, [{START_SQL}] AS path UNION ALL SELECT l.dst, list_append(w.path, l.dst) FROM walk w JOIN links l ON w.slug = l.src WHERE len(w.path) <= 6 AND NOT list_contains(w.path, l.dst) AND w.slug <> (SELECT dst FROM target))",
        recursive=True,
    ),
)
def _(spark, d):
    g = graph_view(spark, d)
    second = g.links.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    two = g.links.join(second, "dst").where("src <> end")
    first = two.agg(F.min("src")).first()[0]
    target = two.where(F.col("src") == first).agg(F.max("end")).first()[0]
    return R.shortest_path(g.links, g.entity, first, target)


def pagerank_sql(rounds: int) -> str:
    n = "(SELECT count(*) FROM entity)"
    parts = [
        "e AS MATERIALIZED (SELECT DISTINCT src, dst FROM links WHERE src <> dst AND src IN (SELECT slug FROM entity) AND dst IN (SELECT slug FROM entity))",
        "deg AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src)",
        f"r0 AS MATERIALIZED (SELECT slug, 1.0::DOUBLE / {n} AS s FROM entity)",
    ]
    for k in range(rounds):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT r.slug, 0.15 / {n} + 0.85 * (SELECT coalesce(sum(s), 0) FROM r{k} WHERE slug NOT IN (SELECT src FROM deg)) / {n} + 0.85 * coalesce(g.got, 0) AS s FROM r{k} r LEFT JOIN (SELECT e.dst, sum(q.s / deg.k) AS got FROM e JOIN r{k} q ON e.src = q.slug JOIN deg ON deg.src = e.src GROUP BY e.dst) g ON g.dst = r.slug)"
        )
    return sql(f"SELECT slug, round(s, 8) AS score FROM r{rounds}", *parts)


@query("d01_pagerank", pagerank_sql(12))
def _(spark, d):
    g = graph_view(spark, d)
    return A.pagerank(g.entity, g.links, tolerance=0.0, rounds=12).select("slug", F.round("score", 8).alias("score"))


@query("d03_hub_rank")
def _(spark, d):
    g = graph_view(spark, d)
    scores = A.pagerank(g.entity, g.links, tolerance=1e-12, rounds=100).select("slug", F.round("score", 9).alias("score"))
    return A.hub_rank(scores)


@query("d04_communities")
def _(spark, d):
    g = graph_view(spark, d)
    return A.communities(g.entity, g.links)


HOLE = "member AS (SELECT slug, CAST(substr(slug, 6) AS BIGINT) % 7 AS community FROM entity)"


@query("d05_structural_holes", sql("SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, count(*) AS n_links FROM links JOIN member x ON src = x.slug JOIN member y ON dst = y.slug WHERE x.community <> y.community GROUP BY 1, 2", HOLE))
def _(spark, d):
    g = graph_view(spark, d)
    return A.structural_holes(g.entity.select("slug", F.expr("cast(substr(slug, 6) as bigint) % 7").alias("community")), g.links)


@query("d09_degrees", sql("SELECT slug, i AS in_degree, o AS out_degree, round(3 + sqrt(i + o) * 2, 6) AS radius FROM (SELECT slug, (SELECT count(*) FROM links WHERE dst = slug AND src <> dst) AS i, (SELECT count(*) FROM links WHERE src = slug AND src <> dst) AS o FROM entity)"))
def _(spark, d):
    g = graph_view(spark, d)
    return A.degrees(g.entity, g.links)


SEEDS = f"seeds AS (SELECT DISTINCT slug FROM supports WHERE source_id <= '{SOURCE}')"


@query("d07_tier3", sql("SELECT DISTINCT slug FROM (SELECT dst AS slug FROM links WHERE src IN (FROM seeds) UNION SELECT src FROM links WHERE dst IN (FROM seeds)) WHERE slug IN (SELECT slug FROM active) AND slug NOT IN (FROM seeds)", SEEDS))
def _(spark, d):
    g = graph_view(spark, d)
    seeds = g.supports.where(F.col("source_id") <= SOURCE).select("slug").distinct()
    return A.tier3(g.links, seeds, R.active_canonical(g.entity))


@query("d08_layout")
def _(spark, d):
    g = graph_view(spark, d)
    labels = A.components(g.entity, g.links)
    largest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return A.layout(labels.join(largest, "component", "left_semi").select("slug"), g.links)


@query(
    "e04_invariants",
    sql("""SELECT 'C1' AS code, e.slug AS subject FROM entity e WHERE canonical_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM alias_of a WHERE a.alias_slug = e.slug AND a.canonical_slug = e.canonical_id)
      UNION ALL SELECT 'C2', a.alias_slug FROM alias_of a LEFT JOIN entity e ON e.slug = a.alias_slug WHERE e.canonical_id IS DISTINCT FROM a.canonical_slug
      UNION ALL SELECT 'C3', e.slug FROM entity e JOIN entity t ON e.canonical_id = t.slug WHERE t.canonical_id IS NOT NULL
      UNION ALL SELECT 'C4', src || '->' || dst FROM links JOIN entity t ON dst = t.slug WHERE t.canonical_id IS NOT NULL"""),
)
def _(spark, d):
    return V.invariants(graph_view(spark, d))


REPLAY = "replay AS (SELECT slug, title, page_type, CASE WHEN CAST(substr(slug, 6) AS BIGINT) % 37 = 0 THEN 'active' ELSE status END AS status FROM entity WHERE CAST(substr(slug, 6) AS BIGINT) % 41 <> 0)"


@query(
    "e05_replay_diff",
    sql(
        """SELECT coalesce(a.slug, b.slug) AS key, CASE WHEN a.slug IS NULL THEN 'missing_in_live' WHEN b.slug IS NULL THEN 'missing_in_replay' ELSE 'attribute_mismatch' END AS kind, CASE WHEN a.slug IS NOT NULL AND b.slug IS NOT NULL THEN 'status' END AS field
        FROM entity a FULL JOIN replay b ON a.slug = b.slug WHERE a.slug IS NULL OR b.slug IS NULL OR a.status IS DISTINCT FROM b.status""",
        REPLAY,
    ),
)
def _(spark, d):
    live = graph_view(spark, d).entity.select("slug", "title", "page_type", "status")
    key = F.expr("cast(substr(slug, 6) as bigint)")
    replay = live.where(key % 41 != 0).withColumn("status", F.when(key % 37 == 0, "active").otherwise(F.col("status")))
    return V.table_diff(live, replay, "slug", ["title", "page_type", "status"])
