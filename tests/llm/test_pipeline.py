"""The pipeline's stages one by one against plain Python, on the smallest tables."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import common, near_dedup
from tests.llm.test_operators import brute_simhash, brute_substrings


def brute_near(texts):
    """The least ids of what 4 bits or a likeness of 0.8 link, and how many pairs only the likeness links."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    fp = {i: brute_simhash(t, 5) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    missed = 0
    for i in root:
        for j in root:
            if j < i:
                alike = bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
                bits = (fp[i] ^ fp[j]).bit_count() <= 4
                missed += alike and not bits
                if alike or bits:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i for i in root if find(i) == i}, missed


def test_stages(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = common.read_table(spark, tiny, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, tiny), name)
        if name != "packing":
            assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.collect())
        before, after = {r.doc_id: r.text for r in docs.collect()}, out.collect()
        if name == "near_dedup":
            assert {r.doc_id for r in after} == brute_near(before)[0]
        if name == "substring_dedup":
            removed = {d: n - g for d, n, g, _, _ in brute_substrings(list(before.items()))}
            assert all(0 <= removed[r.doc_id] - len(r.text.encode()) <= 6 for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == set(before)
        docs = out


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("crowd, tile", [(16, 1024), (2, 8)])
def test_near_stage_takes_every_likeness_from_four_fifths(spark, monkeypatch, crowd, tile):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "ROUNDS", 2 if crowd > 2 else 0)
    rng = random.Random(8)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        for copy in range(3):
            changed = list(words)
            for _ in range(copy * rng.randint(1, max(1, len(words) // 80))):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), "a few words"), (len(rows) + 1, "A  few words"), (len(rows) + 2, "")]
    keep, missed = brute_near(dict(rows))
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert missed > 20 and {r.doc_id for r in out.collect()} == keep


def test_first_digests_hold_what_alike_sets_must_share():
    for a in range(1, 400):
        for b in range(-(-4 * a // 5), 5 * a // 4 + 1):
            least, own, other = -(-4 * (a + b) // 9), *(len(near_dedup.prefix(np.arange(x))) for x in (a, b))
            wanted = max(1, a // 5)
            # However the shared digests lie, the first ones stand behind all that only one of the two has.
            assert least > min(a, b) or (wanted <= least and wanted + a - least <= own and wanted + b - least <= other)


def test_texts_that_share_a_third_by_chance_leave_before_whole_sets_are_made(spark):
    rng = random.Random(4)
    common = [[f"c{rng.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    rows = [(k, " ".join(common[k % 20] + [f"w{k}x{j}" for j in range(110)])) for k in range(60)]
    rows += [(60, rows[7][1] + " more"), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, found = near_dedup.fingerprints_and_candidates(docs, 5)
    left = {r.doc_id for r in own.join(found, "row").collect()}
    assert {7, 60} <= left and len(left) < 10


@pytest.mark.parametrize("labelled", [False, True])
def test_counts_in_passes_are_those_of_one(spark, labelled):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.unique(rng.choice(pool, 40)) for _ in range(30)]
    rows = [(k, k // 2, x.tobytes()) for k, x in enumerate(sets)]
    texts = spark.createDataFrame([*rows, rows[3]], "row long, label long, own binary").repartition(3)
    texts = texts if labelled else texts.drop("label")
    of = {k: k // 2 if labelled else k for k in range(30)}
    brute = {k: sum(any(of[j] != of[k] and v in sets[j] for j in range(30)) for v in x.tolist()) for k, x in enumerate(sets)}
    for passes in (1, 4, 8):
        found = near_dedup.shared_counts(texts, "own", 16, passes)
        assert {r.row: r.m for r in found.collect()} == {k: m for k, m in brute.items() if m}
    batch = texts.select("row", "own").toArrow().to_batches()
    sent = [sum(len(x) for b in near_dedup.packed_digests(iter(batch), "own", 16, k, 8) for x in b.column("keys").to_pylist()) for k in range(8)]
    assert all(sent) and max(sent) < sum(sent) / 4
