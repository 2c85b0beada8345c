"""SimHash near-dedup with pivot distance tables.

Fingerprints: 64 bits of the XXH64 of word shingles. Two fingerprints link if at most BITS bits differ. Distinct fingerprints are
compared, never their copies.

Candidates: the 64 bits are cut into m blocks; two fingerprints within k bits agree on all of at least m - k blocks, so
every linked pair shares a bucket of one of the C(m, k) choices of m - k blocks. m grows with the number of fingerprints so
that the mean bucket stays small. In a bucket a table of Hamming distances to PIVOTS fixed reference fingerprints discards
pairs whose coordinates differ by more than k somewhere (the triangle inequality); the survivors are verified on the bits.

A bucket only has to find what is connected, so a member that joined a component leaves the search: a dense bucket costs a few
passes, not a pass per pair. A bucket above HOT members is cut into tiles of members and each pair of tiles goes to a task of its own;
no pair is dropped. Links leave as (member, least member of its component).

near_dedup() also links texts whose sets of shingles have a Jaccard likeness of LIKE = 4/5 or more. Sets in the order of their digests: sets
this alike share at least 4/5 of the larger, so that their first n - 4n/5 + l(n) digests share l(min(a, b)) or more.

1. Texts of whose first digests others have fewer than l(n) = n/5 leave: no pairs are made for that, only counts by digest. Of 2n/5 digests half must
   be shared, so that what common words share by chance, which grows with the corpus, lets few texts through.
2. Of the others whole sets are counted alike: a text stays only if 4/5 of its set stands in texts of other components.
3. By a few minima of rehashed sets, each text is verified against one text of its group (that with the largest share in others): linear in the
   texts. A dense group of near copies falls into one component here, and 2 is done again with the new components.
4. What is left pairs up by shared first digests, where sizes and the counts of 2 allow a likeness of 4/5, and every pair is verified on the whole
   sets. Texts of a digest that more than CROWD have are compared by bitmaps in tiles of their crowd (what such digests connect): no pairs are emitted there.

Counts are made in up to PASSES passes over the digests, a part of their range each, so that what a pass sends is gone before the next begins.

The path loses no link but for equal digests (64 bits in a set, 32 bits or more in the counts, where they only let more texts through).

Defined results: a null or empty text has fingerprint zero, and such rows are linked like any other; fewer words than a shingle
are one shingle; equal rows have equal fingerprints; a row whose doc_id is null gets the least doc_id of its component, if any; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import PACKED, by_part, documents, input_bytes, key_groups, materialize, runs, scratch, shared_keys_of, shuffle_partitions, splitmix, step, tidy
from quarry.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
PIVOTS, HOT, CHUNK = 16, 8192, 1 << 16
SMALL = 48
LIKE, MINIMA, ROUNDS = (4, 5), 4, 2
CROWD, TILE = 16, 1024  # texts of a digest that are paired one by one; texts of a tile
ROWS, KEYS, FEW = 5_000, 1 << 20, 1_000_000  # rows and digests packed at once; rows that may be broadcast
PASSES, PASS_BYTES = 8, 1 << 28  # passes of a count at most (a power of two); bytes of input for which one is made
MIX = np.uint64(0x9FB21C651E98DF25)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, from the least on; bytes of a word count eight bits at a time."""
    n = len(hashes)
    if not n:
        return np.zeros(64, np.int64)
    starts = np.arange(0, n, 255)
    ones = np.uint64(0x0101010101010101)
    out = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ones, starts)
        out[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def digests(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in their order, CHUNK at a time."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    size, h = min(shingle, len(words)), xxhash.xxh64_intdigest
    for k in range(0, len(words) - size + 1 if words else 0, CHUNK):
        part = words[k : k + CHUNK + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.r_[0, ends[:-1]]
        spans = zip(starts[: len(part) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
        yield np.array([h(joined[i:j], SEED) for i, j in spans], np.uint64)


def folded(parts: list[np.ndarray]) -> int:
    """The fingerprint of a text, unsigned, from the digests of its shingles."""
    n, counts = sum(map(len, parts)), sum((bit_counts(h) for h in parts), np.zeros(64, np.int64))
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def simhash(text: str, shingle: int = SHINGLE) -> int:
    return folded(list(digests(text, shingle)))


def shingles(parts: list[np.ndarray]) -> np.ndarray:
    """A text's set: its distinct digests, in order."""
    return np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, alike: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; if alike, also a digest of its text, the size of its set and its first digests: row, n, first."""
    texts = documents(docs)
    texts = texts.withColumn("row", F.xxhash64("text")) if alike else texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, firsts = [], [], []
            for t in b.column("text"):
                parts = list(digests(t.as_py(), shingle))
                fps.append(folded(parts))
                if alike:
                    own = shingles(parts)
                    sizes.append(len(own))
                    firsts.append(prefix(own).tobytes())
            more = [b.column("row"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary())] if alike else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), *more], names=["doc_id", "fp", "row", "n", "first"][: 2 + len(more)])

    return texts.mapInArrow(lambda batches: tidy(work(batches)), "doc_id long, fp long" + ", row long, n long, first binary" * alike)


def blocks_for(n: int, bits: int) -> int:
    """The least number of blocks at which a bucket has few random members."""
    m = bits + 1
    while m < 64 and (64 * (m - bits)) // m < max(1, n).bit_length() - 2:
        m += 1
    return m


def buckets(fp: Column, m: int, bits: int) -> Column:
    """One bucket for each choice of m - bits of m blocks: the choice and the bits of its blocks, digested to a long."""
    edges = [64 * k // m for k in range(m + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in choice) for choice in combinations(range(m), m - bits)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.xxhash64(F.lit(c), fp.bitwiseAND(F.lit(signed(mask)).cast("long"))) for c, mask in enumerate(masks)])


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to the pivots (columns)."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (i, j) link: pairs with a coordinate difference over bits go first, the rest are verified."""
    ok = np.flatnonzero((np.abs(table[i] - table[j]) <= bits).all(axis=1))
    return ok[np.bitwise_count(fps[i[ok]] ^ fps[j[ok]]) <= bits]


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pivots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs in buckets (runs of fps) of at most SMALL members, by distance of places within the bucket."""
    keep = (sizes > 1) & (sizes <= SMALL)
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    left = np.repeat(starts + sizes, sizes) - at  # members from here to the bucket's end
    fps_at = fps[at]
    table = pivot_table(fps_at, pivots)
    a, b = [], []
    for step in range(1, int(sizes.max())):
        i = np.flatnonzero(left > step)
        ok = near(fps_at, table, i, i + step, bits)
        a.append(fps_at[i[ok]])
        b.append(fps_at[i[ok] + step])
    return np.concatenate(a), np.concatenate(b)


def bucket_links(fps: np.ndarray, pivots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) over the components of one bucket: a search in which members found leave the rest."""
    table = pivot_table(fps, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    todo = np.arange(len(fps))
    a, b = [], []
    while len(todo):
        root, todo = todo[0], todo[1:]
        front, members = [root], [root]
        while front and len(todo):
            x = front.pop()
            low, high = np.searchsorted(table[todo, 0], (table[x, 0] - bits, table[x, 0] + bits + 1))
            seen = todo[low:high]
            hits = near(fps, table, np.full(len(seen), x), seen, bits)
            if len(hits):
                found = seen[hits]
                todo = np.delete(todo, low + hits)
                members += found.tolist()
                front += found.tolist()
        if len(members) > 1:
            m = fps[members]
            a.append(m)
            b.append(np.full(len(m), m.view(np.int64).min(), np.int64).view(np.uint64))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def linked(batches: Iterator[pa.RecordBatch], bits: int, n_pivots: int) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a partition, whose rows are sorted by bucket."""
    pivots = splitmix(n_pivots, 5)
    for t in key_groups(batches, "bucket"):
        keys, fps = t.column("bucket").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        starts, sizes = runs(keys)
        a, b = small_links(fps, starts, sizes, pivots, bits)
        links = [(a.view(np.int64), b.view(np.int64))]
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            x, y = bucket_links(np.unique(fps[s : s + n]), pivots, bits)
            links.append((x.view(np.int64), y.view(np.int64)))
        a, b = (np.concatenate(c) for c in zip(*links, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def share(n: np.ndarray | int) -> np.ndarray | int:
    """How many digests a set of n shares at the least with one this alike, among those that prefix() takes of both."""
    return np.maximum(1, n // 5)


def prefix(ordered: np.ndarray, least: int = 0) -> np.ndarray:
    """The digests of a set, in order, of which sets this alike share least (share(n), if that is 0) or more."""
    n = len(ordered)
    return ordered[: n - -(-LIKE[0] * n // LIKE[1]) + (least or share(n))] if n else ordered


def packed_digests(batches: Iterator[pa.RecordBatch], column: str, parts: int, at_pass: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """by_part() of the digests in a column that fall into a pass, with their rows and, if there are any, labels; a row that a batch repeats counts once."""
    down = np.uint64(32 - (parts.bit_length() - 1))
    low, high = (np.uint64((k * parts // passes) << 32) for k in (at_pass, at_pass + 1))
    for b in batches:
        start, size = 0, 0
        for k in range(b.num_rows):
            size += len(b.column(column)[k].as_buffer())
            if size < 8 * KEYS and k + 1 - start < ROWS and k + 1 < b.num_rows:
                continue
            part = b.slice(start, k + 1 - start)
            start, size = k + 1, 0
            _, at = np.unique(part.column("row").to_numpy(), return_index=True)
            sets = [np.frombuffer(part.column(column)[i].as_buffer(), "<u8") for i in at.tolist()]
            keys = np.concatenate(sets) * MIX >> down
            of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            if passes > 1:
                now = (keys >= low) & (keys < high)
                keys, of = keys[now], of[now]
            yield by_part(keys, of, parts, *(part.column(c).to_numpy()[at] for c in ("row", "label") if c in b.schema.names))


def counted(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Of each part of packed_digests(), for each group of rows: how many digests a row has that others have too, packed."""
    for keys, ids in shared_keys_of(batches):
        order = np.lexsort((keys, ids))
        keys, ids = keys[order], ids[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])][: len(ids)]
        row, m = np.unique(ids[new], return_counts=True)
        group = ((row.view(np.uint64) * MIX >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        row, m, group = row[order], m[order].astype("<i4"), group[order]
        starts, sizes = runs(group)
        cut = lambda x: pa.array([x[i : i + n].tobytes() for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)], pa.binary())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pa.array(group[starts], pa.int32()), cut(row), cut(m)], names=["group", "rows", "ms"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each row, from counted()'s groups, sorted by group."""
    for t in key_groups(batches, "group", rows=1):
        row, at = np.unique(np.frombuffer(b"".join(t.column("rows").to_pylist()), "<i8"), return_inverse=True)
        m = np.bincount(at, np.frombuffer(b"".join(t.column("ms").to_pylist()), "<i4")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(m)], names=["row", "m"])


def shared_counts(texts: DataFrame, column: str, parts: int, passes: int = 1) -> DataFrame:
    """row and m: how many digests of the column stand in other rows (of another label, if texts have labels). The counts of each pass are a table, its shuffle files go before the next."""
    labelled, tasks = "label" in texts.columns, shuffle_partitions(texts.sparkSession)

    def of_pass(k: int) -> DataFrame:
        packed = texts.select("row", column, *["label"] * labelled).mapInArrow(lambda x: tidy(packed_digests(x, column, parts, k, passes)), PACKED + ", labels binary" * labelled)
        found = packed.repartition(min(parts // passes, max(16, tasks)), "part").sortWithinPartitions("part").mapInArrow(lambda x: tidy(counted(x, tasks)), "group int, rows binary, ms binary")
        return found.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(lambda x: tidy(summed(x)), "row long, m long")

    if passes == 1:
        return of_pass(0)
    counts = []
    for k in range(passes):
        with step(texts.sparkSession):
            counts.append(materialize(of_pass(k), "counts", keep=True))
    return reduce(DataFrame.union, counts).groupBy("row").agg(F.sum("m").alias("m"))


def minima(batches: Iterator[pa.RecordBatch], round_: int) -> Iterator[pa.RecordBatch]:
    """MINIMA keys of each set: the least of its digests, rehashed in as many ways."""
    odd = splitmix(2 * MINIMA, 11 + round_) | np.uint64(1)
    for b in batches:
        keys = []
        for x in b.column("own"):
            own = np.frombuffer(x.as_buffer(), "<u8")
            for k in range(MINIMA):
                y = own * odd[k]
                keys.append(int((((y ^ y >> np.uint64(29)) * odd[MINIMA + k]).min())) ^ k)
        rest = [pa.array(np.repeat(b.column(c).to_numpy(), MINIMA)) for c in ("row", "label", "n", "m")]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *rest], names=["key", "row", "label", "n", "m"])


def like_sizes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n (two rows: a pair's) of which others have m digests can be alike."""
    most = np.minimum(m[0], m[1])
    return (sum(LIKE) * most >= LIKE[0] * (n[0] + n[1])) & (LIKE[1] * n.min(axis=0) >= LIKE[0] * n.max(axis=0))


def star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: each row with the one of its group whose set stands in others by the largest share."""
    for t in key_groups(batches, "key"):
        key, row, label, n, m = (t.column(c).to_numpy() for c in ("key", "row", "label", "n", "m"))
        order = np.lexsort((row, -m / np.maximum(n, 1), key))
        key, row, label, n, m = key[order], row[order], label[order], n[order], m[order]
        starts, sizes = runs(key)
        first = np.repeat(starts, sizes)
        ok = (label != label[first]) & like_sizes(np.array([n, n[first]]), np.array([m, m[first]]))
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (np.minimum(row, row[first]), np.maximum(row, row[first]))], names=["a", "b"])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each digest by which a text is found: alike texts share one of them or more."""
    for b in batches:
        sets = [prefix(np.frombuffer(x.as_buffer(), "<u8"), 1) for x in b.column("own")]
        count = [len(x) for x in sets]
        token = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), *(pa.array(np.repeat(b.column(c).to_numpy(), count)) for c in ("row", "label", "n", "m"))], names=["token", "row", "label", "n", "m"])


def token_pairs(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: of a token's texts the pairs a < b that can be alike; of more than crowd texts each with the first, marked crowded."""
    for t in key_groups(batches, "token"):
        token, row, label, n, m = (t.column(c).to_numpy() for c in ("token", "row", "label", "n", "m"))
        order = np.lexsort((row, token))
        row, label, n, m = row[order], label[order], n[order], m[order]
        starts, sizes = runs(token[order])
        size = np.repeat(sizes, sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(row)) - 1
        a, b = [], []
        for step in range(1, crowd):
            i = np.flatnonzero((left >= step) & (size <= crowd))
            ok = (label[i] != label[i + step]) & like_sizes(np.array([n[i], n[i + step]]), np.array([m[i], m[i + step]]))
            a.append(row[i[ok]])
            b.append(row[i[ok] + step])
        few, i = sum(map(len, a)), np.flatnonzero(size > crowd)
        a, b = np.concatenate([*a, np.repeat(row[starts], sizes)[i]]), np.concatenate([*b, row[i]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= few)], names=["a", "b", "crowded"])


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, over the digests that at least two of the sets have."""
    values, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[places]
    whose = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[column >= 0]
    column = column[column >= 0]
    out = np.zeros((len(sets), 1 + int(column.max(initial=0)) // 64), np.uint64)
    np.bitwise_or.at(out, (whose, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return out


def tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block, a pair of tiles: the labels of alike texts, one from each tile (both from it, if it is one tile)."""
    for t in key_groups(batches, "block", rows=1):
        for at, size in zip(*(x.tolist() for x in runs(t.column("block").to_numpy())), strict=True):
            one = t.slice(at, size)
            label, n, m, tile = (one.column(c).to_numpy() for c in ("label", "n", "m", "tile"))
            bits, links = bitmaps([np.frombuffer(x.as_buffer(), "<u8") for x in one.column("own")]), set()
            several = tile.min() != tile.max()
            for i in np.flatnonzero(tile == tile.min()).tolist():
                j = np.flatnonzero((tile != tile[i]) & (label != label[i])) if several else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                j = j[like_sizes(np.array([np.full(len(j), n[i]), n[j]]), np.array([np.full(len(j), m[i]), m[j]]))]
                both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
                links |= {(int(label[i]), int(x)) for x in label[j[LIKE[1] * both >= LIKE[0] * (n[i] + n[j] - both)]]}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def crowd_links(crowds: DataFrame, texts: DataFrame, tile_rows: int) -> DataFrame:
    """Links (a, b) between the labels of alike texts of a crowd: texts that links (a, b) of crowds connect.

    A crowd is cut into tiles; each pair of tiles goes to a task of its own, which compares bitmaps and makes no rows of pairs.
    """
    of = components(crowds).select(F.col("node").alias("_row"), F.col("label").alias("crowd"))
    rows = materialize(texts.join(of, F.col("row") == F.col("_row")).drop("_row"), "crowds")
    sizes = rows.groupBy("crowd").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_tiles")).withColumnRenamed("crowd", "_crowd")
    tiled = rows.join(sizes, F.col("crowd") == F.col("_crowd")).withColumn("tile", F.pmod(F.xxhash64("row", F.lit(3)), F.col("_tiles")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.xxhash64("crowd", F.least(t, "tile"), F.greatest(t, "tile")))
    dealt = tiled.select(F.explode(blocks).alias("block"), "tile", "label", "n", "m", "own")
    tasks = shuffle_partitions(texts.sparkSession)
    return dealt.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(lambda x: tidy(tile_links(x)), "a long, b long")


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are alike, by label."""
    for b in batches:
        ok = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(LIKE[1] * both >= LIKE[0] * (len(x) + len(y) - both))
        yield b.select(["la", "lb"]).filter(pa.array(ok, pa.bool_())).rename_columns(["a", "b"])


def linked_labels(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of those pairs whose sets are alike."""
    one = pairs.join(texts.select(F.col("row").alias("a"), F.col("own").alias("sa"), F.col("label").alias("la")), "a")
    both = one.join(texts.select(F.col("row").alias("b"), F.col("own").alias("sb"), F.col("label").alias("lb")), "b").select("la", "lb", "sa", "sb")
    return both.mapInArrow(lambda batches: tidy(verified(batches)), "a long, b long")


def relabelled(rows: DataFrame, links: DataFrame, label: str = "label") -> DataFrame:
    """rows with the labels of the components that links make of the old ones."""
    joined = components(links).select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(joined, rows[label] == joined["_node"], "left").withColumn(label, F.coalesce("_label", label)).drop("_node", "_label")


def joined(df: DataFrame, few: DataFrame) -> DataFrame:
    """df with the columns of few, a table by _row, which is broadcast if it may be: the texts or sets of df then stay where they are."""
    return df.join(F.broadcast(few) if few.count() <= FEW else few, F.col("row") == F.col("_row")).drop("_row")


def sets_of(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """row, n, the whole set (own) and the label of the texts that have a row and label in rows."""
    few = materialize(rows.select(F.col("row").alias("_row"), "label"), "rows")
    found = joined(documents(docs).select(F.xxhash64("text").alias("row"), "text"), few).dropDuplicates(["row"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(list(digests(t.as_py(), shingle))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), b.column("label")], names=["row", "n", "own", "label"])

    return found.mapInArrow(lambda batches: tidy(work(batches)), "row long, n long, own binary, label long")


def still_linked(texts: DataFrame, parts: int, passes: int) -> DataFrame:
    """The texts of whose set at least 4/5 stands in texts of other labels; m counts those digests."""
    counts = shared_counts(texts, "own", parts, passes).withColumnRenamed("row", "_row")
    few = texts.select("row", "n").join(counts, F.col("row") == F.col("_row")).where(F.col("m") * LIKE[1] >= F.col("n") * LIKE[0]).select("_row", "m")
    return joined(texts, materialize(few, "rows")).select("row", "label", "n", "own", "m")


def parts_for(docs: DataFrame) -> tuple[int, int]:
    """Parts that digests are dealt to, and passes that count them (one where Catalyst has no size and takes the largest)."""
    size = input_bytes(docs)
    passes = min(PASSES.bit_length() - 1, (size // PASS_BYTES).bit_length()) if size < 1 << 50 else 0
    return 1 << max(4, min(16, (size >> 22).bit_length())), 1 << passes


def candidates(docs: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of texts of whose first digests enough stand in others; own has row, n and first."""
    counts = shared_counts(own, "first", *parts_for(docs)).withColumnRenamed("row", "_row")
    sizes = own.select("row", "n").distinct()
    return sizes.join(counts, F.col("row") == F.col("_row")).where(F.col("m") >= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).select("row")


def fingerprints_and_candidates(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp, row and n of every row, and candidates(); first digests go with the step."""
    with step(docs.sparkSession):
        own = materialize(fingerprints(docs, shingle, alike=True), "fingerprints")
        found = materialize(candidates(docs, own), "rows", keep=True)
        return materialize(own.drop("first"), "fingerprints", keep=True), found


def alike_labels(docs: DataFrame, found: DataFrame, labels: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between the labels (row, label) of texts whose sets are alike; found has the rows of candidates()."""
    spark = docs.sparkSession
    (parts, passes), tasks = parts_for(docs), shuffle_partitions(spark)
    with step(spark):
        with step(spark):
            whole = materialize(sets_of(docs, found.join(labels, "row"), shingle), "sets", keep=True)
        texts = materialize(still_linked(whole, parts, passes), "sets", keep=True)
    links = []
    for k in range(ROUNDS):
        with step(spark):
            keyed = texts.mapInArrow(lambda x, k=k: tidy(minima(x, k)), "key long, row long, label long, n long, m long")
            stars = keyed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda x: tidy(star_pairs(x)), "a long, b long").distinct()
            new = materialize(linked_labels(stars, texts), "links", keep=True)
            links.append(new)
        with step(spark):
            texts = materialize(still_linked(materialize(relabelled(texts.drop("m"), new), "relabelled"), parts, passes), "sets", keep=True)
    with step(spark):
        found = texts.mapInArrow(lambda x: tidy(token_rows(x)), "token long, row long, label long, n long, m long")
        pairs = found.repartition(tasks, "token").sortWithinPartitions("token").mapInArrow(lambda x: tidy(token_pairs(x, CROWD)), "a long, b long, crowded boolean")
        pairs = materialize(pairs.distinct(), "pairs")
        links.append(materialize(linked_labels(pairs.where("NOT crowded").select("a", "b"), texts), "links", keep=True))
        links.append(materialize(crowd_links(pairs.where("crowded").select("a", "b"), texts, TILE), "links", keep=True))
    return reduce(DataFrame.union, links)


def fingerprint_links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints fp that connect exactly what pairs within bits connect."""
    n = fps.count()
    m = blocks_for(n, bits)
    dealt = fps.select(F.explode(buckets(F.col("fp"), m, bits)).alias("bucket"), "fp")
    # Buckets above hot are few (at most rows / hot), and found by a count with map-side combine.
    sizes = dealt.groupBy("bucket").count().where(F.col("count") > hot).select(F.col("bucket").alias("_b"), F.ceil(F.col("count") / F.greatest(F.lit(hot), F.col("count") / 64)).cast("int").alias("_tiles"))
    sizes = materialize(sizes, "hot-buckets")
    if sizes.head(1):
        tiled = dealt.join(sizes, F.col("bucket") == F.col("_b"), "left")
        tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("_tiles")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.xxhash64("bucket", F.least(t, tile), F.greatest(t, tile)))
        dealt = tiled.select(F.explode(F.when(F.col("_tiles").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return work.mapInArrow(lambda batches: tidy(linked(batches, bits, PIVOTS)), "a long, b long")


def near_classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, alike: bool = False) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach, of every row; alike also links by likeness of the shingles, and gives row."""
    with scratch(docs.sparkSession):
        own, found = fingerprints_and_candidates(docs, shingle) if alike else (materialize(fingerprints(docs, shingle), "fingerprints"), None)
        with step(docs.sparkSession):
            first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
            labels = components(fingerprint_links(own.select("fp").distinct(), bits))
            of = first.join(labels, first["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
            of = materialize(of, "classes", keep=True)
        if alike:
            by_text = own.select("row", "fp").distinct().join(of.select("fp", "label"), "fp").select("row", "label")
            of = materialize(relabelled(of, alike_labels(docs, found, by_text, shingle)), "classes")
        least = of.groupBy("label").agg(F.min("first").alias("component_id"))
        classes = of.join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
        return materialize(own.join(classes, own["fp"] == classes["_fp"]).select("doc_id", "fp", "component_id", *["row"] * alike), "near", keep=True)


def near_dedup(docs: DataFrame, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """The rows of docs that have the least doc_id of their class, by bits or likeness; rows of a class that repeat that doc_id stay, rows without a doc_id too."""
    classes = near_classes(docs, shingle, bits, alike=True)
    gone = classes.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (text == gone["_row"]), "left_anti")
