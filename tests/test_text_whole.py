"""The text queries over rows and characters of every kind."""

import hashlib

from quarry import queries


def test_text_queries_take_whole_documents(spark, tmp_path):
    texts = ["Große Straße", "two--Words here", "-edge- x", "a" * 300 + " [[far-link]] end", "first\n\n second \nthird", "plain"]
    spark.createDataFrame([(k, t, f"src{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    slugs = {r.doc_id: r.slug for r in run("t01_slugify")}
    assert set(slugs) == set(range(6)) and slugs[0] == "groe-strae"
    valid = {r.doc_id: (r.valid, r.collapsed) for r in run("t03_valid_slug")}
    assert len(valid) == 6 and valid[1] == (False, "two-words") and valid[2] == (False, "edge")
    links = {r.doc_id: r.slugs for r in run("t07_wikilinks")}
    assert links[3] == ["far-link", "page-3", "page-x"] and links[5] == ["page-5", "page-x"]
    rows = {(r.doc_id, r.paragraph_id, r.digest) for r in run("t20_paragraph_rows")}
    expect = {(i, f"p{k:04}", hashlib.md5(p.encode()).hexdigest()) for i, t in enumerate(texts) for k, p in enumerate((x.strip() for x in t.split("\n") if x.strip()), 1)}
    assert rows == expect
