"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Defined results: a null text has no words; an empty table gives an empty table; repeated rows are judged
one by one; very long texts are judged whole; columns of the input that clash with a metric are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in a is that be was for it with as on by at this have or from an not are which you had her
de la le et les des en un une du que est pour qui dans par sur plus au avec ce il ne se pas
der die das und den von zu mit sich dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las del por con una su para es al lo como mas pero sus ya o
""".split()


@dataclass(frozen=True)
class Rule:
    """Kept only if low <= metric <= high; metric is SQL over the metric columns; a null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        parts = [f"({self.metric}) >= {self.low!r}D"] * (self.low is not None) + [f"({self.metric}) <= {self.high!r}D"] * (self.high is not None)
        return f"coalesce({' AND '.join(parts) or 'true'}, true)"


#: The production table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("words", "n_words", 10, 1_000_000),
    Rule("word_length", "word_chars / nullif(n_words, 0)", 1.5, 18.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_word_ratio", "if(n_words >= 50, n_stop_words / n_words, NULL)", 0.005, None),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
)

BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def with_metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, plus the metrics; three projections, no shuffle, all on the JVM."""
    trimmed = f"trim(BOTH '{WS_CHARS}' FROM _t)"
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    split = base.select(
        *keep,
        "_t",
        F.when(F.expr(trimmed) == "", F.array().cast("array<string>")).otherwise(F.split(F.expr(trimmed), WS)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    hashed = split.select(
        *keep,
        "_l",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("_w") >= 5, F.expr(f"transform(sequence(0, size(_w) - 5), i -> {_window_sql()})")).alias("_h"),
    )
    metrics = ("n_words", "word_chars", "n_symbols", "n_stop_words")
    marked = hashed.select(
        *keep,
        *metrics,
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.expr("sort_array(transform(_h, (h, i) -> struct(h, i)))")).alias("_s"),
    )
    twice = marked.select(
        *keep,
        *metrics,
        "n_lines",
        "n_dup_lines",
        F.expr("sort_array(transform(filter(_s, (x, k) -> get(_s, k - 1).h <=> x.h OR get(_s, k + 1).h <=> x.h), x -> x.i))").alias("_p"),
    )
    covered = F.expr("aggregate(_p, struct(-5 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(5, i - a.last) AS n), a -> a.n)")
    return twice.select(*keep, *metrics, "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _window_sql() -> str:
    return "xxhash64(" + ", ".join(f"_w[i + {k}]" for k in range(5)) + ")"


def verdict(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """base_failed and kept, compiled from the threshold table."""
    failed = F.expr(BASE_FAILED)
    kept = F.expr(" AND ".join(r.sql() for r in rules) or "true")
    return failed, ~failed & kept


def quality_rules(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the columns keep (doc_id if none), metrics, base_failed, kept."""
    failed, kept = verdict(rules)
    return with_metrics(docs, *(keep or ("doc_id",))).withColumns({"base_failed": failed, "kept": kept})


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    failed, kept = verdict(rules)
    # A filter is pushed below projections with its expressions written out, again and again; one on a row number stays above them.
    numbered = with_metrics(packed, "_row").withColumn("_at", F.monotonically_increasing_id())
    return numbered.where((F.col("_at") >= 0) & kept & ~failed).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
