import pytest

LONG = " ".join(f"word{k % 97}x{k % 13}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those that operators make."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, LONG, "en", "b"),
        (5, LONG, "en", "b"),
        (6, "  \n \t ", "fr", "b"),
        (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (7, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (8, "é 一\U0001f600 ß#$% <|endoftext|> x  y", "de", None),
        (None, "no id at all but words enough for a shingle or two", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("n_words", "kept", "fp", "row", "keys", "_row", "_h", "_drop", "node", "shard", "size", "start", "part", "label")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
