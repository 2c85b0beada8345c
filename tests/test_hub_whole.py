"""d03_hub_rank against PageRank that ends at 1e-12 or after 100 rounds, in plain Python."""

from quarry import queries
from quarry.queries.graph import graph_view


def test_hub_rank_of_converged_scores(spark, tiny):
    g = graph_view(spark, tiny)
    slugs = sorted({r.slug for r in g.entity.collect()})
    out = {s: set() for s in slugs}
    for r in g.links.collect():
        if r.src != r.dst and r.src in out and r.dst in out:
            out[r.src].add(r.dst)
    n, rank = len(slugs), dict.fromkeys(slugs, 1 / len(slugs))
    for _ in range(100):
        base = (0.15 + 0.85 * sum(rank[s] for s in slugs if not out[s])) / n
        new = dict.fromkeys(slugs, base)
        for s in slugs:
            for t in out[s]:
                new[t] += 0.85 * rank[s] / len(out[s])
        change, rank = sum(abs(new[s] - rank[s]) for s in slugs), new
        if change < 1e-12:
            break
    order = sorted(slugs, key=lambda s: (-round(rank[s], 9), s))
    found = {r.slug: r.hub_rank for r in queries.queries()["d03_hub_rank"](spark, tiny).collect()}
    assert found == {s: k for k, s in enumerate(order, 1)}


def test_layout_runs_all_ticks(spark, tiny):
    from quarry.operators import analytics

    asked, plain = [], analytics.layout
    try:
        analytics.layout = lambda nodes, links, ticks=300, seed=42: asked.append(ticks) or plain(nodes, links, ticks, seed)
        rows = queries.queries()["d08_layout"](spark, tiny).collect()
    finally:
        analytics.layout = plain
    assert asked == [300] and rows


def test_charge_is_that_of_all_pairs():
    import numpy as np

    from quarry.operators import analytics

    rng = np.random.default_rng(1)
    for xy in (rng.normal(0, 500, (1500, 2)), rng.normal(-3000, 5, (300, 2)), np.array([[0.0, 0], [280, 0], [560.1, 0], [-280, 0]]), np.zeros((1, 2)), np.zeros((0, 2))):
        d = xy[None] - xy[:, None]
        r2 = np.maximum((d**2).sum(axis=2), 1.0)
        assert np.allclose(analytics.charge(xy, 280.0), (d * ((r2 <= 280.0**2) / r2)[:, :, None]).sum(axis=1), rtol=0, atol=1e-9)
    k = np.arange(9000)
    spread, seen, plain = np.stack([10 * np.sqrt(k) * np.cos(k * 2.4), 10 * np.sqrt(k) * np.sin(k * 2.4)], axis=1), [], np.maximum
    try:
        np.maximum = lambda a, b, **more: seen.append(np.size(a)) or plain(a, b, **more)
        analytics.charge(spread, 280.0)
    finally:
        np.maximum = plain
    assert sum(seen) < 9000**2 / 3


def test_charge_weighs_a_pair_once():
    import numpy as np

    from quarry.operators import analytics

    k = np.arange(9000)
    spread, seen, plain = np.stack([10 * np.sqrt(k) * np.cos(k * 2.4), 10 * np.sqrt(k) * np.sin(k * 2.4)], axis=1), [], np.maximum
    try:
        np.maximum = lambda a, b, **more: seen.append(np.size(a)) or plain(a, b, **more)
        analytics.charge(spread, 280.0)
    finally:
        np.maximum = plain
    assert sum(seen) < 9000**2 / 10
    d = spread[None] - spread[:, None]
    r2 = (d**2).sum(axis=2)
    weight = (r2 <= 280.0**2) / plain(r2, 1.0)
    assert np.allclose(analytics.charge(spread, 280.0), np.einsum("ij,ijk->ik", weight, d), rtol=0, atol=1e-9)
