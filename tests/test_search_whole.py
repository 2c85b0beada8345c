"""i04_search over documents with every letter, against sqlite FTS5."""

import sqlite3

import pytest

from quarry import queries


def test_search_takes_all_documents(spark, tmp_path):
    texts = ["Erou thonre groß", "erou straße thonre thonre weiß und mehr", "erou only", "thonre erou plain words here", "nothing", "ß", "groß und klein", "other", "more words"]
    rows = [(k, t, "de" if "ß" in t else "en", f"src{k % 2}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE a USING fts5(title, author, body)")
    db.executemany("INSERT INTO a(rowid, title, author, body) VALUES (?, ?, ?, ?)", [(k, s, lang, t) for k, t, lang, s, _ in rows])
    expect = dict(db.execute("SELECT rowid, bm25(a) FROM a WHERE a MATCH 'erou thonre'"))
    found = {r.article_id: r.score for r in queries.queries()["i04_search"](spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1, 3} and found == pytest.approx(expect, abs=2e-6)
