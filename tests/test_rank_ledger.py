import sqlite3

import pytest

from quarry.operators import ledger as L
from quarry.operators import rank as M
from quarry.operators import scan as S


def test_borda_ties_and_edges(spark):
    rows = [("k", c, v) for c, v in zip("abcde", (0.001, 0.001, 0.002, 0.005, 0.005), strict=True)] + [("one", "a", 3.0), ("flat", "a", 1.0), ("flat", "b", 1.0), ("null", "a", 1.0), ("null", "b", None), ("null", "c", 2.0)]
    out = M.borda(spark.createDataFrame(rows, "kpi string, candidate string, value double"), "kpi", lower=True).collect()
    found = {(r.kpi, r.candidate): r.borda for r in out}
    assert [found["k", c] for c in "abcde"] == [0.875, 0.875, 0.5, 0.125, 0.125]
    assert found["one", "a"] == 1.0 and found["flat", "a"] == 0.5 and ("null", "b") not in found and found["null", "a"] == 1.0 and found["null", "c"] == 0.0


def test_moves_pair_by_hash(spark):
    now = spark.createDataFrame([("new", "h1"), ("same", "h2"), ("copy", "h2"), ("changed", "h4")], "path string, hash string")
    old = spark.createDataFrame([("old", "h1", "p"), ("same", "h2", "p"), ("gone", "h9", "p"), ("changed", "h3", "p")], "path string, hash string, pipeline_id string")
    got = {(r.path, r.action, r.previous_path) for r in S.classify(now, old).collect()}
    assert got == {("new", "MOVED", "old"), ("same", "UNCHANGED", None), ("copy", "NEW", None), ("gone", "DELETED", None), ("changed", "CHANGED", None)}
    assert {r.action for r in S.classify(now, old, "other").collect()} == {"NEW"}


def test_calibration(spark):
    labels = spark.createDataFrame([("1", "weak", 1), ("1", "strong", 2), ("2", "noise", 1), ("3", "interesting", 1), ("4", "strong", 1)], "article_id string, action string, place int")
    topics = zip("1234", ("investment", "finance-econ", "geopolitics", "china-econ"), strict=True)
    verdicts = spark.createDataFrame([(i, "r", t, 0.1) for i, t in topics], "article_id string, run_id string, topic string, signal double")
    r = L.calibration(labels, verdicts, ["strong", "interesting"]).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.labeled, r.precision, r.recall) == (1, 1, 2, 0, 4, 0.5, 0.333333)


BODIES = ["the quick brown fox", "quick quick dog", "a lazy brown dog sleeps", "fox and dog", "nothing at all here", "brownish foxes run"]


@pytest.mark.parametrize("query", ["quick", "brown dog", "fox OR lazy", "dog NOT quick", '"quick brown"', "brown*", "(fox OR dog) AND lazy", "body:fox", "title:t1", "NEAR(quick fox, 2)"])
def test_search_against_sqlite(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE a USING fts5(id UNINDEXED, title, author, body)")
    rows = [(str(k), f"t{k}", "ann", b) for k, b in enumerate(BODIES)]
    db.executemany("INSERT INTO a VALUES (?, ?, ?, ?)", rows)
    want = dict(db.execute("SELECT id, rank FROM a WHERE a MATCH ?", (query,)).fetchall())
    df = spark.createDataFrame(rows, "article_id string, title string, author string, body string")
    got = {r.article_id: r.score for r in L.search(df, query).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query and "NOT" not in query and "(" not in query and "OR" not in query:
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("query", ['"open', "a-b", "(fox", "AND"])
def test_bad_queries(query):
    with pytest.raises(ValueError):
        L.Query(query)


def test_registered_queries():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 90 and set(o) <= set(q)
