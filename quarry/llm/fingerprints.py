"""Document fingerprints: Merkle trees over spans, paragraphs and sections.

Lines are paragraphs; blank lines, which are paragraphs themselves, end sections, and lines that begin with # begin them. A paragraph's leaves are spans of some
words each, cut where a word's own length says so (so that an insertion moves no later boundary). A leaf digests its bytes, a paragraph
the digests of its leaves, a section those of its paragraphs, the root those of its sections: every byte of the text is in a leaf or
is a boundary that the levels tell, so equal roots mean equal texts. A path of siblings proves a leaf against the root.

A fingerprint is text: the root, then for each section "/" and its digest, for each of its paragraphs ";", its digest and those of its leaves, each
digest cut to ROOT, NODE or LEAF hex digits (some 15 to 25 % of the text). Two fingerprints are compared from the root down: equal sections are
equal in all below and are not entered, of the others' paragraphs equal ones are not, and leaves count only in what is left. The likeness is the share of
leaves found in common (Dice): 1 for equal roots, 0 with nothing in common.

Defined results: a null text is an empty one (one blank paragraph, without leaves); two texts without leaves are alike only if equal; an empty
table gives an empty table; rows with the same doc_id stand in the order of their texts, rows without one first. Whole texts are digested, a document at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, input_bytes, shuffle_partitions

FULL = 16  # bytes of a digest within a tree
ROOT, NODE, LEAF, LONGEST = 32, 8, 6, 12  # hex digits in a fingerprint; words of a leaf
RANGES, PER_RANGE = 100_000, 40  # most ranges of doc_id, and ids looked at for each range's bounds


def leaf_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=FULL, person=b"leaf").digest()


def node_digest(children: bytes) -> bytes:
    return hashlib.blake2b(children, digest_size=FULL, person=b"node").digest()


def leaves(paragraph: str) -> list[str]:
    """Spans of words, which spaces join: a span ends after a word of five letters, or after LONGEST words."""
    words = paragraph.split(" ")
    out, start = [], 0
    for k, w in enumerate(words):
        if (len(w) == 5 and k > start) or k - start >= LONGEST - 1:
            out.append(" ".join(words[start : k + 1]))
            start = k + 1
    if start < len(words):
        out.append(" ".join(words[start:]))
    return out


class Tree(NamedTuple):
    """root, and of each section its digest and paragraphs, of each paragraph its digest and leaves."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]


def sections_of(text: str) -> list[list[str]]:
    """The lines of each section."""
    out: list[list[str]] = [[]]
    closed = False
    for line in text.split("\n"):
        if out[-1] and (closed or line.startswith("#")):
            out.append([])
        out[-1].append(line)
        closed = not line.strip()
    return out


def tree(text: str) -> Tree:
    sections = []
    for lines in sections_of(text):
        paragraphs = []
        for line in lines:
            own = [leaf_digest(x.encode("utf-8", "surrogatepass")) for x in leaves(line)] if line else []
            paragraphs.append((node_digest(b"".join(own)), own))
        sections.append((node_digest(b"".join([d for d, _ in paragraphs])), paragraphs))
    return Tree(node_digest(b"".join([d for d, _ in sections])), sections)


Step = tuple[bytes, bytes]


def proof(own: Tree, section: int, paragraph: int, leaf: int) -> list[Step]:
    """Of each level above a leaf: the digests before and after its branch."""
    _, paragraphs = own.sections[section]
    levels = [(paragraphs[paragraph][1], leaf), ([d for d, _ in paragraphs], paragraph), ([d for d, _ in own.sections], section)]
    return [(b"".join(level[:k]), b"".join(level[k + 1 :])) for level, k in levels]


def proven(data: bytes, path: list[Step], root: bytes) -> bool:
    """Whether a leaf of these bytes stands there in the tree of that root."""
    digest = leaf_digest(data)
    for before, after in path:
        digest = node_digest(before + digest + after)
    return digest == root


def written(own: Tree) -> str:
    """The fingerprint of a tree."""
    node, leaf = NODE // 2, LEAF // 2
    out = [own.root.hex()[:ROOT]]
    for digest, paragraphs in own.sections:
        out.append("/" + digest[:node].hex())
        out += [";" + d[:node].hex() + b"".join([x[:leaf] for x in spans]).hex() for d, spans in paragraphs]
    return "".join(out)


class Levels(NamedTuple):
    """A fingerprint's root, and by digest: how many sections and what they hold, as text; leaves is their number in all."""

    root: str
    sections: Counter
    leaves: int


def levels(fingerprint: str) -> Levels:
    """The sections of a fingerprint by digest and content; what lies below is taken apart only where it is looked into."""
    root, *sections = fingerprint.split("/")
    paragraphs = fingerprint.count(";")
    return Levels(root, Counter(sections), (len(fingerprint) - len(root) - len(sections) * (1 + NODE) - paragraphs * (1 + NODE)) // LEAF)


def leaf_count(section: str) -> int:
    return (len(section) - NODE - section.count(";") * (1 + NODE)) // LEAF


def common(x: Counter, y: Counter, weight) -> tuple[int, Counter, Counter]:
    """The weight of branches that both have, and the branches that only x and only y have."""
    both = x & y
    if not both:
        return 0, x, y
    return sum(weight(k) * n for k, n in both.items()), x - both, y - both


def likeness(a: Levels, b: Levels) -> float:
    """The share of leaves in common, found from the root down; only branches that differ are entered."""
    if a.root == b.root:
        return 1.0
    if not a.leaves + b.leaves:
        return 0.0
    found, x, y = common(a.sections, b.sections, leaf_count)
    if x and y:
        x, y = (Counter([p for s, n in c.items() for p in s.split(";")[1:] * n]) for c in (x, y))
        n, x, y = common(x, y, lambda p: (len(p) - NODE) // LEAF)
        found += n
        if x and y:
            x, y = (Counter([p[k : k + LEAF] for p, n in c.items() for k in list(range(NODE, len(p), LEAF)) * n]) for c in (x, y))
            found += common(x, y, lambda k: 1)[0]
    return 2 * found / (a.leaves + b.leaves)


def diff(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of b for paragraphs whose nodes differ from those of a at the same place; equal roots and equal sections are not entered."""
    x, y = ([s.split(";") for s in f.split("/")] for f in (a, b))
    if x[0] == y[0]:
        return []
    out = []
    for k, (section, *paragraphs) in enumerate(y[1:]):
        digest, *others = x[k + 1] if k + 1 < len(x) else [""]
        if section != digest:
            out += [(k, p) for p, branch in enumerate(paragraphs) if p >= len(others) or branch[:NODE] != others[p][:NODE]]
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of what follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def bounds_of(docs: DataFrame, ranges: int) -> list[int]:
    """Bounds of about equal ranges of doc_id, from PER_RANGE ids a range, chosen by a digest; they decide on tasks only, never on results."""
    n = docs.count()
    rate = min(1.0, ranges * PER_RANGE / max(1, n))
    chosen = docs.where((F.col("doc_id").isNotNull()) & (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1))
    ids = sorted(r["doc_id"] for r in chosen.select("doc_id").distinct().collect())
    return sorted({ids[len(ids) * k // ranges] for k in range(1, ranges)}) if ids else []


def dealt_keys(docs: DataFrame, n: int, ranges: int) -> list[int]:
    """For each range a number that hash partitioning into n deals to a partition of its own (as far as ranges <= n)."""
    spark = docs.sparkSession
    numbers = spark.range(int(n * (math.log(n) + 12))).select(F.col("id").cast("int").alias("k"))
    by = {r["p"]: r["k"] for r in numbers.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()}
    return [by.get(r % n, r) for r in range(ranges)]


def in_order(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """_part, _next, doc_id, text: rows dealt by range of doc_id; every range also has the first rows of the next range that has any (the last one: of the first), marked _next.

    A range is found by binary search in a constant array; bounds and one number a range reach the driver.
    """
    bounds = bounds_of(docs, parts)
    keys = dealt_keys(docs, max(parts, 1), len(bounds) + 1)
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to a constant
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds)).bit_length()))])
    # The number of bounds below the id: the largest r with bounds[r - 1] < id.
    below = lambda r, s: F.when((r + s <= len(bounds)) & (F.try_element_at(longs(bounds), r + s) < id_), r + s).otherwise(r)
    ranged = docs.withColumn("_range", F.aggregate(steps, F.lit(0), below))
    firsts = {r["_range"]: r["m"] for r in ranged.groupBy("_range").agg(F.min(id_).alias("m")).collect()}
    held = sorted(firsts)
    before = {r: held[k - 1] for k, r in enumerate(held)}
    number = lambda of: F.element_at(longs([of(r) for r in range(len(bounds) + 1)]), F.col("_range") + 1)
    is_first = number(lambda r: firsts.get(r, 0)) == id_
    copies = F.array_compact(F.array(F.struct(number(lambda r: keys[r]).cast("int").alias("_part"), F.lit(False).alias("_next")), F.when(is_first, F.struct(number(lambda r: keys[before.get(r, r)]).cast("int").alias("_part"), F.lit(True).alias("_next")))))
    return ranged.select(F.explode(copies).alias("c"), "doc_id", "text").select("c._part", "c._next", "doc_id", "text"), max(parts, 1)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by _part, _next, doc_id, text; a row waits for the one after it."""
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows: list[tuple] = []

    def known(doc_id, text):
        f = written(tree(text))
        return doc_id, text, f, levels(f)

    def row(x: tuple, y: tuple) -> tuple:
        changed = edited(x[1], y[1])
        f = written(tree(changed))
        return x[0], len(x[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), x[2], f, likeness(x[3], levels(f)), likeness(x[3], y[3])

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=fields)
        rows.clear()
        return out

    held, part, done = None, None, False
    for b in batches:
        for p, nxt, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("_part", "_next", "doc_id", "text")), strict=True):
            if p != part:
                held, part, done = None, p, False
            if done:
                continue
            x = known(doc_id, text)
            if held:
                rows.append(row(held, x))
            held, done = x, nxt
            if len(rows) >= 2000:
                yield batch()
    if rows:
        yield batch()


def fingerprints(docs: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """One row per document; see SCHEMA."""
    rows = documents(docs)
    most = min(input_bytes(docs) // part_bytes, rows.count() // PER_RANGE + 1)  # no more than rows call for: a source may not know its size
    parts = int(min(RANGES, max(shuffle_partitions(docs.sparkSession), most)))
    dealt, n = in_order(rows, parts)
    return dealt.repartition(n, "_part").sortWithinPartitions("_part", "_next", "doc_id", "text").mapInArrow(fingerprinted, SCHEMA)
