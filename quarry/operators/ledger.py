"""Full-text ledger: search by bm25, gate verdicts, extraction triggers, sampling, calibration, chunking."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Topics, those that are always extracted, the signal that is enough, and the feedback that counts as positive.
TOPICS = ("investment", "finance-econ", "geopolitics", "china-econ", "ai-tech", "other")
EXTRACT_TOPICS, EXTRACT_SIGNAL = ("investment", "finance-econ"), 0.75
K1, B, FLOOR = 1.2, 0.75, 1e-6
CHUNK_WORDS, WHOLE_WORDS = 6000, 8000


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """article_id, sha, first_seen (kept from the first time), last_seen, replaced (whether paragraphs are written again)."""
    a, b = old.select("article_id", F.col("sha").alias("s0"), F.col("first_seen").alias("f0"), F.col("last_seen").alias("l0")), new.select("article_id", F.col("sha").alias("s1"), F.col("seen").alias("l1"))
    x = a.join(b, "article_id", "full_outer")
    return x.select("article_id", F.coalesce("s1", "s0").alias("sha"), F.coalesce("f0", "l1").alias("first_seen"), F.coalesce("l1", "l0").alias("last_seen"), (F.col("s1").isNotNull() & ~F.col("s0").eqNullSafe(F.col("s1"))).alias("replaced"))


def without_absent(ledger: DataFrame, present: DataFrame) -> DataFrame:
    return ledger.join(present.select("article_id"), "article_id", "left_semi")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded to lower case."""
    return F.filter(F.split(F.lower(F.translate(text, "àáâäãåçèéêëìíîïñòóôöõùúûüýÿÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(articles: DataFrame, *columns: str) -> DataFrame:
    """article_id, column, place, token, of every token of the columns."""
    one = [articles.select("article_id", F.lit(c).alias("column"), F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("place", "token")) for c in columns]
    return reduce(DataFrame.union, one)


class Query:
    """Query text to a boolean over term matches: implicit AND, OR, NOT, parentheses, "phrases", prefix*, column:term, NEAR(a b, n)."""

    TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"(\*?)|([^\s()":]+):(?=\S)|([^\s()":*]+)(\*?)|(\S))')

    def __init__(self, text: str):
        if text.count('"') % 2:
            raise ValueError("unterminated string")
        self.terms: list[tuple] = []  # (column or None, words, prefix, near or None)
        self.parts, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m or m[8]:
                raise ValueError(f"syntax error near {text[at:]!r}")
            at = m.end()
            if m[1] or m[2]:
                self.parts.append((m[1] or m[2], None))
            elif m[5]:
                self.parts.append(("column", m[5]))
            elif m[3] is not None:
                self.parts.append(("phrase", (m[3], bool(m[4]))))
            elif m[6] in ("AND", "OR", "NOT", "NEAR"):
                self.parts.append((m[6], None))
            elif not re.fullmatch(r"[\w\x80-\U0010ffff]+,?", m[6]):
                raise ValueError(f"syntax error near {m[6]!r}")
            else:
                self.parts.append(("phrase", (m[6], bool(m[7]))))
        self.at = 0
        self.tree = self.either()
        if self.at < len(self.parts):
            raise ValueError("syntax error")

    def peek(self):
        return self.parts[self.at][0] if self.at < len(self.parts) else None

    def next(self):
        if self.at >= len(self.parts):
            raise ValueError("syntax error at the end")
        self.at += 1
        return self.parts[self.at - 1]

    def either(self):
        out = self.both()
        while self.peek() == "OR":
            self.next()
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.but()
        while self.peek() in ("AND", "(", "phrase", "column", "NEAR"):
            if self.peek() == "AND":
                self.next()
            out = ("and", out, self.but())
        return out

    def but(self):
        out = self.one()
        while self.peek() == "NOT":
            self.next()
            out = ("not", out, self.one())
        return out

    def one(self, column=None):
        kind, value = self.next()
        if kind == "(":
            out = self.either()
            if self.next()[0] != ")":
                raise ValueError("missing parenthesis")
            return out
        if kind == "column":
            return self.one(value.lower())
        if kind == "NEAR":
            if self.next()[0] != "(":
                raise ValueError("NEAR needs parentheses")
            words, distance = [], 10
            while self.peek() == "phrase":
                word = self.next()[1][0]
                if word.endswith(",") or word.isdigit() and words and words[-1].endswith(","):
                    words.append(word)
                    continue
                words.append(word)
            if self.next()[0] != ")":
                raise ValueError("missing parenthesis")
            if len(words) > 1 and words[-2].endswith(",") and words[-1].isdigit():
                distance = int(words.pop())
            return self.term(column, [w.rstrip(",") for w in words], False, distance)
        if kind != "phrase":
            raise ValueError(f"syntax error near {kind}")
        return self.term(column, re.findall(r"[^\W_]+", value[0].lower()), value[1], None)

    def term(self, column, words, prefix, near):
        self.terms.append((column, [w.lower() for w in words], prefix, near))
        return ("term", len(self.terms) - 1)


def _close(first: str, other: str, near: int) -> Column:
    """Whether at has both words with at most near others between them."""
    return F.exists("at", lambda x: (x["token"] == first) & F.exists("at", lambda y: (y["token"] == other) & (F.abs(y["place"] - x["place"]) <= near + 1)))


def search(articles: DataFrame, text: str, limit: int | None = None, columns: tuple[str, ...] = ("title", "author", "body")) -> DataFrame:
    """article_id, score of the articles that match, by bm25 (lower is better); with a limit only the best."""
    q = Query(text)
    if not q.terms:
        raise ValueError("empty query")
    wanted = {w for _, words, _, near in q.terms for w in words}
    prefixes = {words[-1] for _, words, prefix, _ in q.terms if prefix and words}
    posts = postings(articles, *columns)
    lengths = articles.select("article_id", sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0)).alias("len"))
    total = lengths.agg(F.count("*").alias("N"), F.avg("len").alias("avg")).first()
    keep = F.col("token").isin(list(wanted))
    for p in prefixes:
        keep |= F.col("token").startswith(p)
    posts = posts.where(keep)
    # Where the words of each term stand: a term matches at a place if its words follow each other there.
    found = []
    for k, (column, words, prefix, near) in enumerate(q.terms):
        if near is not None and len(words) > 1:
            spots = posts.where(F.col("token").isin(words)).groupBy("article_id", "column").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("at"))
            close = reduce(lambda a, b: a & b, [_close(words[0], w, near) for w in words[1:]])
            hits = spots.where(close).select("article_id", F.lit(1).alias("n"))
        else:
            base = None
            for j, w in enumerate(words):
                match = F.col("token").startswith(w) if prefix and j == len(words) - 1 else F.col("token") == w
                own = posts.where(match).select("article_id", "column", (F.col("place") - j).alias("start"))
                base = own if base is None else base.join(own.distinct(), ["article_id", "column", "start"], "left_semi")
            if base is None:
                continue
            if column:
                base = base.where(F.col("column") == column)
            hits = base.select("article_id", F.lit(1).alias("n"))
        found.append(hits.groupBy("article_id").agg(F.sum("n").alias("f")).select("article_id", F.lit(k).alias("term"), "f"))
    if not found:
        return lengths.limit(0).select("article_id", F.lit(0.0).alias("score"))
    hits = reduce(DataFrame.union, found)
    n = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((total["N"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(total["avg"])))
    scored = hits.join(F.broadcast(n), "term").join(lengths, "article_id").groupBy("article_id").agg((-F.sum(weight)).alias("score"), F.collect_set("term").alias("terms"))

    def holds(node) -> Column:
        kind, *rest = node
        if kind == "term":
            return F.array_contains("terms", rest[0])
        a, b = map(holds, rest)
        return {"and": a & b, "or": a | b, "not": a & ~b}[kind]

    out = scored.where(holds(q.tree)).select("article_id", "score")
    return out if limit is None else out.orderBy("score", "article_id").limit(limit)


def parse_verdicts(responses: DataFrame, column: str = "response") -> DataFrame:
    """responses with ok, topic, signal, extract_ideas, extract_lessons, confidence, rationale: an unknown topic is other and extracts nothing; numbers are clamped to 0..1."""
    v = F.try_parse_json(F.col(column))
    kind = lambda x: F.schema_of_variant(x)
    part = lambda n: F.try_variant_get("_v", f"$.{n}", "variant")
    number = lambda n: F.when(kind(part(n)).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get("_v", f"$.{n}", "double"))))
    raw = F.when(kind(part("topic")) == "STRING", F.try_variant_get("_v", "$.topic", "string"))
    known = F.coalesce(raw.isin(*TOPICS), F.lit(False))
    flag = lambda n: known & F.coalesce((kind(part(n)) == "BOOLEAN") & F.try_variant_get("_v", f"$.{n}", "boolean"), F.lit(False))
    out = responses.withColumn("_v", v)
    return out.select(
        *responses.columns, F.coalesce(kind(F.col("_v")).startswith("OBJECT"), F.lit(False)).alias("ok"), F.when(known, raw).otherwise("other").alias("topic"), F.coalesce(number("signal"), F.lit(0.0)).alias("signal"),
        flag("extract_ideas").alias("extract_ideas"), flag("extract_lessons").alias("extract_lessons"), number("confidence").alias("confidence"), F.substring(F.coalesce(F.try_variant_get("_v", "$.rationale", "string"), F.lit("")), 1, 280).alias("rationale"),
    )


def latest(rows: DataFrame, key: str = "article_id") -> DataFrame:
    """All rows of the largest run_id of each key."""
    last = rows.groupBy(key).agg(F.max("run_id").alias("run_id"))
    return rows.join(last, [key, "run_id"], "left_semi")


def triggers(verdicts: DataFrame) -> DataFrame:
    """Latest verdicts that ask for extraction."""
    return latest(verdicts).where(F.col("topic").isin(*EXTRACT_TOPICS) | (F.col("signal") >= EXTRACT_SIGNAL) | F.col("exploration"))


def ungated(articles: DataFrame, verdicts: DataFrame, model: str, prompt: str) -> DataFrame:
    """Clean articles without a verdict of this model and prompt."""
    return articles.where("cleanliness = 'ok'").join(verdicts.where((F.col("model") == model) & (F.col("prompt_version") == prompt)), "article_id", "left_anti")


def proved(claims: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Claims of articles all of whose quotes stand in their paragraphs; one that does not takes its article with it."""
    x = claims.join(paragraphs, ["article_id", "paragraph_id"], "left").withColumn("_ok", F.coalesce(F.col("body").contains(F.col("quote")), F.lit(False)))
    bad = x.where("NOT _ok").select("article_id").distinct()
    return claims.join(bad, "article_id", "left_anti")


def first_of_key(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_k = 1").drop("_k")


def exploration_sample(articles: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """article_id of a round-robin over authors, the largest first: the n-th of each author, then by author's place."""
    n = articles.count()
    k = min(n, max(least, math.ceil(share * n)))
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("(unknown)"))
    named = articles.select("article_id", author.alias("author"))
    sizes = named.groupBy("author").agg(F.count("*").alias("size"))
    turn = named.withColumn("turn", F.row_number().over(Window.partitionBy("author").orderBy("article_id")))
    return turn.where(F.col("turn") <= k).join(sizes, "author").orderBy("turn", F.desc("size"), "author").limit(k).select("article_id")


def calibration(labels: DataFrame, verdicts: DataFrame, positive: list[str]) -> DataFrame:
    """One row: tp, fp, fn, tn, labeled, precision, recall, f1 of the latest label of each article against its latest verdict."""
    last = labels.groupBy("article_id").agg(F.max_by("action", "place").alias("action"))
    accept = F.col("topic").isin(*EXTRACT_TOPICS) | (F.col("signal") >= EXTRACT_SIGNAL)
    x = last.join(latest(verdicts).select("article_id", accept.alias("yes")), "article_id", "left").withColumn("pos", F.col("action").isin(positive))
    c = x.agg(*[F.count_if(e).alias(n) for n, e in (("tp", F.col("pos") & F.col("yes")), ("fp", ~F.col("pos") & F.col("yes")), ("fn", F.col("pos") & ~F.col("yes")), ("tn", ~F.col("pos") & ~F.col("yes")))], F.count("*").alias("labeled"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when((p == 0) | (r == 0), 0.0)
    return c.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def stratified_sample(rows: DataFrame, n: int, least: int = 2) -> DataFrame:
    """Of (article_id, topic, author, published): n by topic in proportion, at least two each where there are, evenly spaced; trimmed or filled up by id."""
    total = F.lit(rows.count())
    sizes = rows.groupBy("topic").agg(F.count("*").alias("g"))
    k = F.bround(F.lit(n) * F.col("g") / total)
    sizes = sizes.withColumn("k", F.least(F.col("g"), F.when(F.col("g") >= least, F.greatest(F.lit(least), k)).otherwise(F.col("g"))).cast("long"))
    order = Window.partitionBy("topic").orderBy(F.coalesce("author", F.lit("")), F.coalesce("published", F.lit("")), "article_id")
    placed = rows.withColumn("i", F.row_number().over(order) - 1).join(F.broadcast(sizes), "topic")
    # Place i is taken if it is floor(j * g / k) for a j: the least j that reaches it.
    j = F.ceil(F.col("i") * F.col("k") / F.col("g"))
    taken = placed.withColumn("taken", (j < F.col("k")) & (F.floor(j * (F.col("g") / F.col("k"))) == F.col("i")))
    count = taken.agg(F.count_if("taken")).first()[0]
    if count >= n:
        return taken.where("taken").orderBy("article_id").limit(n).select("article_id", "topic")
    rest = taken.where("NOT taken").orderBy("article_id").limit(n - count)
    return taken.where("taken").select("article_id", "topic").union(rest.select("article_id", "topic"))


def chunks(paragraphs: DataFrame) -> DataFrame:
    """article_id, place, chunk of (article_id, place, n_words): whole up to WHOLE_WORDS, else greedy chunks of whole paragraphs up to CHUNK_WORDS."""
    lists = paragraphs.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("place", "n_words"))).alias("p"), F.sum("n_words").alias("total"))
    step = lambda a, x: F.struct(
        F.when((a["w"] > 0) & (a["w"] + x["n_words"] > CHUNK_WORDS), x["n_words"]).otherwise(a["w"] + x["n_words"]).cast("long").alias("w"),
        F.when((a["w"] > 0) & (a["w"] + x["n_words"] > CHUNK_WORDS), a["c"] + 1).otherwise(a["c"]).alias("c"),
        F.concat(a["out"], F.array(F.when((a["w"] > 0) & (a["w"] + x["n_words"] > CHUNK_WORDS), a["c"] + 1).otherwise(a["c"]))).alias("out"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("out"))
    chunk = F.when(F.col("total") <= WHOLE_WORDS, F.transform("p", lambda x: F.lit(0))).otherwise(F.aggregate("p", zero, step)["out"])
    return lists.select("article_id", F.explode(F.arrays_zip(F.col("p"), chunk.alias("c"))).alias("x")).select("article_id", F.col("x.p.place").alias("place"), F.col("x.c").alias("chunk"))


def status(articles: DataFrame) -> DataFrame:
    return articles.groupBy("cleanliness", "kind").agg(F.count("*").alias("n"))


def resolve_authors(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """article_id, author_id: by alias, case folded; null where there is none."""
    a = aliases.select(F.lower("alias").alias("_a"), "author_id")
    return articles.join(a, F.lower(F.trim("author")) == F.col("_a"), "left").select("article_id", "author_id")
