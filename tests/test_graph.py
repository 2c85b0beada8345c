import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import intake as N
from quarry.operators import reads as R
from quarry.operators import verify as V
from quarry.plans.graph_view import Graph


def links(spark, *pairs):
    return spark.createDataFrame([p.split(">") for p in pairs], "src string, dst string")


def slugs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "slug string")


def reached(spark, l, start, direction, depth):
    return sorted(r.slug for r in R.neighbors(l, slugs(spark, start), direction, depth).collect())


def test_chain(spark):
    l, e = links(spark, "a>b", "b>c", "c>d"), slugs(spark, "a", "b", "c", "d", "lonely")
    assert reached(spark, l, "a", "out", 1) == ["b"] and reached(spark, l, "a", "out", 3) == ["b", "c", "d"]
    assert reached(spark, l, "c", "in", 2) == ["a", "b"] and reached(spark, l, "c", "both", 1) == ["b", "d"] and reached(spark, l, "lonely", "out", 1) == []
    assert R.shortest_path(l, e, "a", "d").first().slug_path == ["a", "b", "c", "d"]
    assert R.shortest_path(l, e, "d", "a").count() == 0 and R.shortest_path(l, e, "a", "a").first().hops == 0
    for bad in (lambda: R.neighbors(l, e, "other"), lambda: R.neighbors(l, e, "out", 0), lambda: R.shortest_path(l, e, "a", "b", 0)):
        with pytest.raises(ValueError):
            bad()


def test_star_pagerank(spark):
    l = links(spark, *[p for k in "123" for p in (f"hub>leaf-{k}", f"leaf-{k}>hub")], "hub>hub")
    scores = A.pagerank(slugs(spark, "hub", "leaf-1", "leaf-2", "leaf-3"), l, rounds=5)
    rows = A.top(scores).collect()
    assert rows[0].slug == "hub" and abs(sum(r.score for r in rows) - 1) < 1e-6
    assert [r.slug for r in A.top(scores, 2).collect()] == ["hub", "leaf-1"] and A.top(scores, 0).count() == 0
    with pytest.raises(ValueError):
        A.top(scores, -1)


def test_two_triangles(spark):
    tri = [f"{x}{i}>{x}{j}" for x in "ab" for i in "123" for j in "123" if i != j]
    l = links(spark, *tri, "a1>b1")
    e = slugs(spark, *[f"{x}{i}" for x in "ab" for i in "123"])
    member = A.communities(e, l)
    found = {r.slug: r.community for r in member.collect()}
    assert len({found[f"a{i}"] for i in "123"}) == 1 and len(set(found.values())) == 2
    assert [r.n_links for r in A.structural_holes(member, l).collect()] == [1]
    with pytest.raises(ValueError):
        A.communities(e, l, "other")


def test_invariants(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "slug string, canonical_id string")
    alias = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "d")], "alias_slug string, canonical_slug string")
    out = V.invariants(Graph(e, None, None, links(spark, "a>b"), alias)).collect()
    assert sorted((r.code, r.subject) for r in out) == [("C1", "d"), ("C2", "a"), ("C3", "c"), ("C4", "a->b")]


def pages(spark, *rows):
    return spark.createDataFrame([(s, k, slug, slug, "concept", None, out) for k, (s, slug, out) in enumerate(rows)], "source_id string, page_pos long, slug string, title string, page_type string, body string, outgoing array<string>")


def batch(spark, rows, run):
    p = pages(spark, *rows)
    sources = p.select("source_id").distinct().select("source_id", F.lit("h").alias("hash"), F.lit("d").alias("domain"), F.lit("s").alias("summary"), F.lit("note").alias("source_type"))
    none = spark.createDataFrame([], "alias_slug string, canonical_slug string, algorithm string, pos long")
    return p, sources, none, sources.select("source_id", "hash"), spark.createDataFrame([], "type string, `from` string, `to` string"), run, run


def test_pending_links_drain_and_deprecation(spark, tmp_path):
    from quarry.sources.versions import commit, current, load

    first = N.apply_batch(N.empty(spark), *batch(spark, [(f"s{k}", f"p{k}", ["hub"]) for k in range(20)], "r1"))
    root, v = commit(first, str(tmp_path / "g"))
    s = load(spark, root)
    assert v == current(spark, root) == 1 and s.links.count() == 0 and s.pending.count() == 20
    root, v = commit(N.apply_batch(s, *batch(spark, [("sh", "hub", []), ("s1", "other", ["p2"])], "r2")), root)
    s = load(spark, root)
    assert v == 2 and s.pending.count() == 0 and s.links.where("dst = 'hub'").count() == 20
    status = {r.slug: r.status for r in s.entity.collect()}
    assert status["p1"] == "deprecated" and status["p2"] == status["hub"] == "active"
