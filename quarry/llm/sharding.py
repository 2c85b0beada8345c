"""Sharding by best-fit-decreasing bin packing over groups of equal texts.

Groups, largest first, enter the shard with the tightest room that holds them, found in a balanced tree of rooms. The capacity is
the smallest (by bisection) at which best-fit-decreasing needs no more shards than there are: sizes come out near equal.

Groups of one size are a class and differ in nothing that best-fit-decreasing looks at: it fills the tightest shard with as many as fit, then the
next. So the driver gets the number of groups of each size, places classes, and gives back for each how many go to which shards; groups are
numbered within their class on the executors. Distinct sizes are few: n of them need n * n / 2 bytes of text at the least (at most
250,000 for 30 GB, 14 million for 100 TB, if nearly every text had a length of its own).

Defined results: a null text counts as an empty one; an empty table gives an empty table; repeated rows are rows of their own in
the shard of their text; a group larger than a fair share has a shard to itself, which then exceeds the others; equal sizes: groups in the order of
their numbers, which follow a digest of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, shuffle_partitions

OVERHEAD = 16


class Rooms:
    """A balanced tree (treap) of (room, bin): the least that is not below a wanted size, in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def rank(key: tuple[int, int]) -> int:
        return (key[1] * 0x9E3779B97F4A7C15 ^ key[0] * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1

    def split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self.split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = self.split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    def merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self.merge(a[3], b)
        return b[0], b[1], self.merge(a, b[2]), b[3]

    def add(self, room: int, bin_: int) -> None:
        key = (room, bin_)
        low, high = self.split(self.root, key)
        self.root = self.merge(self.merge(low, (key, self.rank(key), None, None)), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give the tightest room of at least size."""
        low, high = self.split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self.split(high, (node[0][0], node[0][1] + 1))
        self.root = self.merge(low, rest)
        return node[0]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[list[tuple[int, int]]] | None:
    """Of each class (size, number of groups), from the largest size on: (how many, bin) in turn; None if that takes more than bins.

    A group over capacity has a bin of its own.
    """
    rooms, placed, n = Rooms(), [], 0
    for size, count in classes:
        put = []
        while count:
            found = rooms.take(size)
            if found is None and n == bins:
                return None
            room, bin_ = found or (max(capacity, size), n)
            n += found is None
            m = min(count, room // size)
            put.append((m, bin_))
            count -= m
            rooms.add(room - m * size, bin_)
        placed.append(put)
    return placed


def fair_share(classes: list[tuple[int, int]], bins: int) -> int:
    """The least capacity that could do: groups over a fair share of what is left have a bin each."""
    total, left = sum(s * c for s, c in classes), bins
    for size, count in classes:
        for _ in range(count):
            if left < 2 or size * left <= total:
                return -(-total // left)
            total, left = total - size, left - 1
    return 1


def fewest_bytes(classes: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """The placement at about the least capacity at which bins bins do: steps that double, then bisection, to a 5,000th of a share."""
    low = fair_share(classes, bins)
    step, best, high = max(1, low // 5000), None, low
    while best is None:
        best = best_fit_decreasing(classes, high, bins)
        if best is None:
            low, high, step = high, high + step, 2 * step
    while high - low > max(1, low // 5000):
        trial = (low + high) // 2
        found = best_fit_decreasing(classes, trial, bins)
        low, high, best = (low, trial, found) if found else (trial, high, best)
    return best


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; the law is bytes."""
    rows = documents(docs).select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("_group"))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), "shard-groups")
    classes = [tuple(r) for r in groups.groupBy("_bytes").count().orderBy(F.desc("_bytes")).collect()]
    # Of each class the shards in turn, with the number of the class's groups in it and the shards before.
    table = []
    for (size, _), put in zip(classes, fewest_bytes(classes, shards) if classes else [], strict=True):
        ends, n = [], 0
        for m, bin_ in put:
            n += m
            ends.append((n, bin_))
        table.append((size, ends))
    placed = rows.sparkSession.createDataFrame(table, "_size long, _ends array<struct<n: long, bin: int>>")
    own = numbered(groups, "_bytes", "_group").join(placed, F.col("_bytes") == F.col("_size"))
    own = own.select("_group", F.filter("_ends", lambda x: x["n"] > F.col("slot"))[0]["bin"].alias("shard"))
    put = rows.join(own, "_group").select("doc_id", "size", "text_crc32", "shard")
    return numbered(put, "shard", "doc_id", "size", "text_crc32").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with slot, gapless from 0 within key: a key's rows are numbered in parts, each after the rows of the parts before it."""
    parts = max(1, shuffle_partitions(rows.sparkSession))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(key, "_part").count()
    before = counts.selectExpr(f"{key} AS _k", "_part AS _p", f"coalesce(sum(count) OVER (PARTITION BY {key} ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    own = dealt.selectExpr("*", f"row_number() OVER (PARTITION BY {key}, _part ORDER BY {', '.join(order)}) - 1 AS _own")
    return own.join(before, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p"))).withColumn("slot", (F.col("_before") + F.col("_own")).cast("long")).drop("_k", "_p", "_part", "_own", "_before")
