"""Suffix-array dedup by bucket-pointer refinement, over the suffixes of all documents at once.

Asked for: the bytes covered by a LENGTH-byte string that also starts in a document with a smaller doc_id. That needs suffixes
sorted to depth LENGTH only, so refinement stops there, and buckets of suffixes are all that has to be kept apart.

1. Bucket identifiers by refinement, in each document: b1 is a byte's; b2q[i] is made of bq[i] and bq[i + q], the
   identifier at the later offset, and every level reuses the one before (1, 2, 4, 8, 16, then Q = 24 and 48, 50). Identifiers
   are 64-bit digests of the bucket's string, so that they hold for all documents without a global sort.
2. The q-gram buckets. Of every LENGTH-byte string the least Q-gram identifier is its bucket; strings next to each other mostly
   share one, so about one Q-gram in 14 is sent. Equal strings have equal buckets, whatever stands around them. Buckets
   whose strings stand in one document only are final (singletons) and leave.
3. Refinement of the others. All strings of a document in a row that share a bucket are one run. The runs of a bucket are sorted by the depth LENGTH
   identifiers at their first offset; that gives buckets with new numbers, which are sorted by the identifiers at the last offset (LENGTH bytes each,
   so that two cover a run of up to LENGTH + 1 strings; longer ones also by a digest of those at every LENGTH-th offset between). Each pass sorts by the
   numbers of the one before, and a bucket of one member leaves. A run that a smaller document also has is wholly repeated. Of each
   final bucket the smallest document stays to represent it.
4. Where a q-gram bucket still holds several of them, the representatives' strings are sorted on their own (depth LENGTH) identifiers and buckets: a string
   repeats if a smaller representative has it. That settles the rest, since any document that has the string is represented.

Strings are told apart by two identifiers of 64 bits, the bucket's and the depth LENGTH one; only within a bucket are they compared. With b
different strings in a bucket, a false equality has a chance of b * b / 2**65 there: under 1e-6 in all for 1e12 strings in buckets of 10.

A hot string costs a row for each document that has it, in packed form in step 2; no pairs are made anywhere. Of a bucket, or of equal runs, in
several documents of one map task only representatives go to the bucket's task; the others are settled there and dealt by document, so that a hot
bucket costs its task a few rows for each map task. Each document
goes through one shuffle with its text; only those with a bucket left go on. Sort keys are buckets, spread over all tasks.

Defined results: a null text is an empty one; texts under LENGTH bytes stay; rows without a doc_id stay as they are and remove nothing;
rows with the same doc_id do not remove each other's bytes; an empty table gives an empty table; bytes are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import PACKED, bucketed, by_part, documents, input_bytes, key_groups, materialize, release, runs, shared_keys_of, shuffle_partitions, splitmix, tidy

LENGTH, Q = 50, 24
PART_BYTES, CHUNK = 16 << 20, 1 << 18
DOCS, ROWS = 60_000, 5_000  # documents of a group and rows of a chunk: together under the 65,536 that 16 bits number
SALTS = 1024  # numbers that a part's known buckets are dealt over
KEYS = 1 << 20  # shared buckets of several parts, or settled runs, that leave together
RUNS = 150_000  # runs compared within a task before they are dealt by bucket
MOST = (1 << 22) - 1  # strings of a run: 22 bits of a packed run
BYTES = splitmix(256, 7)
M1, M2, S = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of buckets (a, b): a's string followed by b's."""
    x = a * M1
    x += b
    x ^= x >> S
    x *= M2
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every offset: bucket identifiers at depth Q and at depth LENGTH. Both are empty for data under LENGTH bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    level = BYTES[np.frombuffer(data, np.uint8)]
    levels = {}
    for q in (1, 2, 4, 8):
        levels[q] = level
        level = pair(level[: n - 2 * q + 1], level[q:])
    b24 = pair(level[: n - 23], levels[8][16:])
    b48 = pair(b24[: n - 47], b24[24:])
    return b24, pair(b48[: n - 49], levels[2][48:])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, by doubling."""
    out, w = values, 1
    while 2 * w <= width:
        out = np.minimum(out[: len(out) - w], out[w:])
        w *= 2
    rest = width - w
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def string_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of strings with one bucket, of several texts at once: text, first string, number of strings, bucket, place in the joined texts; and the strings' identifiers by place."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    b24, b50 = identifiers(b"".join(texts))
    if not len(b50):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), b50)
    bucket = least(b24, LENGTH - Q + 1)
    inside = np.zeros(len(bucket) + 1, np.int8)
    long = np.flatnonzero(sizes >= LENGTH)
    inside[begin[long]] = 1
    inside[begin[long] + sizes[long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.r_[True, (bucket[1:] != bucket[:-1]) | ~inside[:-1]]
    starts = np.flatnonzero(inside & new)
    ends = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
    n = ends - starts + 1
    if len(n) and n.max() > MOST:  # a run this long is several, wherever it starts
        pieces = -(-n // MOST)
        step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST
        n = np.minimum(MOST, np.repeat(n, pieces) - step)
        starts = np.repeat(starts, pieces) + step
    text = np.searchsorted(begin[long], starts, side="right") - 1
    return long[text], starts - begin[long][text], n, bucket[starts], starts, b50


def between(starts: np.ndarray, n: np.ndarray, b50: np.ndarray) -> np.ndarray:
    """Of runs of over LENGTH + 1 strings: a digest of the identifiers at every LENGTH-th offset between the first and the last; of others 0."""
    out = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(n > LENGTH + 1)
    if len(long):
        m = (n[long] - 2) // LENGTH
        begin = np.cumsum(m) - m
        offset = LENGTH * (1 + np.arange(m.sum()) - np.repeat(begin, m))
        out[long] = np.add.reduceat(pair(b50[np.repeat(starts[long], m) + offset], offset.astype(np.uint64) * M2), begin)
    return out


def refine(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bucket numbers after each bucket is sorted by its members' values, identifiers of a later offset; buckets of one member are final."""
    many = np.bincount(number)[number] > 1
    number, values, out = number[many], values[many], number.copy()
    order = np.lexsort((values, number))
    new = np.r_[True, (number[order][1:] != number[order][:-1]) | (values[order][1:] != values[order][:-1])][: len(order)]
    fresh = np.empty(len(order), np.int64)
    fresh[order] = np.cumsum(new) - 1 + len(out)
    out[many] = fresh
    return np.unique(out, return_inverse=True)[1]


def chunks(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    """Rows of a batch with their texts as bytes, a few hundred kB and ROWS rows at a time; columns follow as slices."""
    text, start, held, size = batch.column("text"), 0, [], 0
    for k in range(batch.num_rows):
        held.append(text[k].as_py().encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK or len(held) == ROWS or k + 1 == batch.num_rows:
            yield held, *(batch.column(c).slice(start, len(held)) for c in columns)
            start, held, size = k + 1, [], 0


def parts_for(docs: DataFrame) -> int:
    """A power of two: parts over which buckets are dealt, from the size of the input; several for each task, so that tasks are alike."""
    return 1 << max(4, min(16, max((2 * input_bytes(docs) // PART_BYTES).bit_length(), (4 * shuffle_partitions(docs.sparkSession)).bit_length() - 1)))


def packed_buckets(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each batch and part: the buckets (32 bits below those of the part) and the documents they stand in.

    Of a bucket that several documents of a batch share, only the least and the greatest of them go to its part; all go to a part of
    another number (parts * salt above), where the bucket is shared too. A hot bucket so costs its part two entries a batch.
    """
    bits = parts.bit_length() - 1
    down = np.uint64(32 - bits)
    keys, whose, ids, size = [], [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        doc, rank = np.unique(np.array(ids, "<i8"), return_inverse=True)
        both = np.concatenate(keys)
        both <<= np.uint64(16)  # a key has 48 bits at most
        both |= rank[np.concatenate(whose)].astype(np.uint64)
        for x in (keys, whose, ids):
            x.clear()
        both.sort()
        key, of = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
        starts, sizes = runs(key)
        ends = starts + sizes - 1
        shared = of[starts] != of[ends]
        known = np.repeat(shared, sizes)
        sent = ~known
        sent[starts[shared]] = sent[ends[shared]] = True
        yield by_part(key[sent], of[sent], parts, doc)
        if known.any():
            made = by_part(key[known], of[known], parts, doc)
            salt = 1 + int(key[known].sum(dtype=np.uint64) % np.uint64(SALTS))
            yield made.set_column(0, "part", pa.array(made.column("part").to_numpy() + parts * salt, pa.int32()))

    for b in batches:
        for texts, doc_ids in chunks(b, "doc_id"):
            text, _, _, bucket, _, _ = string_runs(texts)
            bucket >>= down
            order = np.lexsort((bucket, text))
            text, bucket = text[order], bucket[order]
            new = np.r_[True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])][: len(text)]
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            new &= known[text]
            keys.append(bucket[new])
            whose.append((text[new] + len(ids)).astype(np.uint16))
            ids += doc_ids.fill_null(0).to_pylist()
            size += sum(map(len, texts))
            if size >= PART_BYTES or len(ids) > DOCS:
                yield from out()
                size = 0
    if ids:
        yield from out()


def shared_buckets(batches: Iterator[pa.RecordBatch], groups: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Of the parts of a task, by which rows are sorted, for each group of documents: the buckets that stand in other documents too, in packed form."""

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        group = (ids.view(np.uint64) * M1 >> np.uint64(33)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        starts, sizes = runs(group[order])
        rows = [order[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(group[order][starts], pa.int32()), pa.array([ids[r].astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([keys[r].astype("<u8").tobytes() for r in rows], pa.binary())], names=["group", "ids", "keys"])

    held, n = [], 0
    for keys, ids in shared_keys_of(batches):
        held.append((keys & np.uint64((parts << 32) - 1), ids))
        n += len(ids)
        if n >= KEYS:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a group: its shared buckets. Rows are sorted by group."""
    for t in key_groups(batches, "group", rows=1):
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<i8")
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<u8")
        order = np.argsort(ids, kind="stable")
        ids, keys = ids[order], keys[order]
        starts, sizes = runs(ids)
        for k in range(0, len(starts), 10_000):
            s, n = starts[k : k + 10_000], sizes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array([keys[i : i + m].tobytes() for i, m in zip(s.tolist(), n.tolist(), strict=True)], pa.binary())], names=["_id", "keys"])


RUN_SCHEMA = "bucket long, first long, last long, rest long, doc_id long, row long, span long, known boolean"


def combined(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Runs, of which those that a smaller document of this batch has too are known to be repeated: these are dealt by their document, not their bucket."""
    bucket, first, last, rest, doc, row, span = columns
    n = span & MOST
    mixed = pair(pair(first.view(np.uint64), last.view(np.uint64)) + rest.view(np.uint64), bucket.view(np.uint64)) + n.astype(np.uint64)
    order = np.lexsort((doc, mixed))
    new = np.zeros(max(0, len(order) - 1), bool)
    for x in (bucket, first, last, rest, n):
        new |= x[order][1:] != x[order][:-1]
    starts = np.flatnonzero(np.r_[True, new][: len(order)])
    known = np.empty(len(order), bool)
    known[order] = doc[order] > np.repeat(doc[order][starts], np.diff(np.r_[starts, len(order)]))
    bucket = np.where(known, pair(doc.view(np.uint64), row.view(np.uint64)).view(np.int64), bucket)
    first, last, rest = (np.where(known, 0, x) for x in (first, last, rest))  # not needed again
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, first, last, rest, doc, row, span, known)], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])


def document_runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The runs whose bucket is shared; span has the first string and, in 22 bits, the number of strings."""
    down = np.uint64(32 - (parts.bit_length() - 1))
    held: list[list[np.ndarray]] = []
    for b in batches:
        for texts, doc_ids, rows, keys in chunks(b, "doc_id", "row", "keys"):
            text, first, n, bucket, starts, b50 = string_runs(texts)
            shared = np.unique(np.frombuffer(b"".join(keys.to_pylist()), "<u8"))
            chosen = np.flatnonzero(np.isin(bucket >> down, shared))
            text, at, n = text[chosen], starts[chosen], n[chosen]
            keys = [x.view(np.int64) for x in (bucket[chosen], b50[at], b50[at + n - 1], between(at, n, b50))]
            held.append([*keys, doc_ids.to_numpy()[text], rows.to_numpy()[text], first[chosen] << 22 | n])
            if sum(len(x[0]) for x in held) >= RUNS:
                yield combined([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
    if held:
        yield combined([np.concatenate(c) for c in zip(*held, strict=True)])


def packed_rows(doc: np.ndarray, row: np.ndarray, groups: int, **lists: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """For each group of documents, packed: its (doc, row), and of each (chosen, values) how many chosen values each has, and these."""
    group = ((pair(doc.view(np.uint64), row.view(np.uint64)) >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((row, doc, group))
    doc, row, group = doc[order], row[order], group[order]
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])][: len(doc)])
    begin, sizes = runs(group[starts])
    cut = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
    edges = np.r_[begin, begin[-1:] + sizes[-1:]]
    names, columns = ["group", "docs", "rows"], [pa.array(group[starts[begin]], pa.int32()), cut(doc[starts].astype("<i8"), edges), cut(row[starts].astype("<i8"), edges)]
    for name, (chosen, values) in lists.items():
        chosen, values = chosen[order], values[order]
        places = np.r_[0, np.cumsum(chosen)][np.r_[starts, len(doc)]]
        names += [f"n_{name}", name]
        columns += [cut(np.diff(places).astype("<i4"), edges), cut(values[chosen].astype("<i8"), places[edges])]
    return pa.RecordBatch.from_arrays(columns, names=names)


def by_row(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[pa.RecordBatch]:
    """A record for each (_doc, _row) with its lists, from packed_rows() sorted by group."""
    for t in key_groups(batches, "group", rows=1):
        joined = lambda c, kind, t=t: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        doc, row = joined("docs", "<i8"), joined("rows", "<i8")
        order = np.lexsort((row, doc))
        new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(doc)]
        starts = np.flatnonzero(new)
        place = np.empty(len(doc), np.int64)
        place[order] = np.cumsum(new) - 1
        doc, row, found = doc[order][starts], row[order][starts], []
        for c in lists:
            whose, values = np.repeat(place, joined(f"n_{c}", "<i4")), joined(c, "<i8")
            found.append((values[np.argsort(whose, kind="stable")], np.r_[0, np.cumsum(np.bincount(whose, minlength=len(doc)))]))
        for k in range(0, len(doc), 10_000):
            n = len(doc[k : k + 10_000])
            cut = [pa.ListArray.from_arrays(pa.array(at[k : k + n + 1] - at[k], pa.int32()), pa.array(values[at[k] : at[k + n]])) for values, at in found]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k : k + n]), pa.array(row[k : k + n]), *cut], names=["_doc", "_row", *lists])


def refined(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by bucket; those wholly repeated (done) and representatives in buckets with several identifiers (todo), packed by group of documents."""

    def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, row, span, done = (np.concatenate(x) for x in zip(*held, strict=True))
        return packed_rows(doc, row, groups, done=(done, span), todo=(~done, span))

    held, n = [], 0
    for t in key_groups(batches, "bucket"):
        repeated = t.column("known").to_numpy().copy()
        is_open, of = np.zeros(len(repeated), bool), np.flatnonzero(~repeated)
        doc, span, row = (t.column(c).to_numpy() for c in ("doc_id", "span", "row"))
        if len(of):
            number = bucket_of = np.unique(t.column("bucket").to_numpy()[of], return_inverse=True)[1]
            for values in (span & MOST, *(t.column(c).to_numpy() for c in ("first", "last", "rest"))):
                number = refine(number, values[of])
            order = np.lexsort((doc[of], number))
            starts, sizes = runs(number[order])
            repeated[of[order]] = doc[of][order] > np.repeat(doc[of][order][starts], sizes)
            classes = np.bincount(bucket_of[order][starts], minlength=bucket_of.max() + 1)
            is_open[of] = ~repeated[of] & (classes[bucket_of] > 1)
        chosen = np.flatnonzero(repeated | is_open)
        held.append((doc[chosen], row[chosen], span[chosen], repeated[chosen]))
        n += len(chosen)
        if n >= KEYS:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def gathered(rows: DataFrame, step: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], tasks: int, *lists: str) -> DataFrame:
    """A row for each _doc and _row with its lists, from rows sorted for a step that makes packed_rows()."""
    packed = rows.mapInArrow(lambda x: tidy(step(x, 2 * tasks)), "group int, docs binary, rows binary, " + ", ".join(f"n_{c} binary, {c} binary" for c in lists))
    return packed.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(lambda x: tidy(by_row(x, *lists)), "_doc long, _row long, " + ", ".join(f"{c} array<long>" for c in lists))


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n strings lie in the runs."""
    marks = np.zeros(n + 1, np.int32)
    first = spans >> 22
    np.add.at(marks, first, 1)
    np.add.at(marks, first + (spans & MOST), -1)
    return np.cumsum(marks[:n]) > 0


def open_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct strings of the representatives' open runs, by identifier."""
    for b in batches:
        for texts, doc_ids, rows, todo in chunks(b, "doc_id", "row", "todo"):
            sizes = np.array([len(t) for t in texts], np.int64)
            spans = todo.flatten().to_numpy()
            whose = np.repeat(np.arange(len(texts)), np.diff(todo.offsets.to_numpy()))
            n = spans & MOST
            starts = (np.cumsum(sizes) - sizes)[whose] + (spans >> 22)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, whose = np.repeat(starts, n) + offset, np.repeat(whose, n)
            b24, b50 = identifiers(b"".join(texts))
            string, bucket = b50[at], least(b24, LENGTH - Q + 1)[at]
            order = np.lexsort((string, whose))
            string, bucket, whose = string[order], bucket[order], whose[order]
            new = np.r_[True, (whose[1:] != whose[:-1]) | (string[1:] != string[:-1])][: len(string)]
            string, bucket, whose = string[new], bucket[new], whose[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (string.view(np.int64), bucket.view(np.int64), doc_ids.to_numpy()[whose], rows.to_numpy()[whose])], names=["string", "bucket", "doc_id", "row"])


def repeated_strings(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by string: the strings of which the document is not the smallest that has them, packed by group of documents."""

    def out(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, row, string = (np.concatenate(x) for x in zip(*held, strict=True))
        return packed_rows(doc, row, groups, strings=(np.ones(len(string), bool), string))

    held, n = [], 0
    for t in key_groups(batches, "string"):
        string, doc = t.column("string").to_numpy(), t.column("doc_id").to_numpy()
        number = refine(np.unique(string, return_inverse=True)[1], t.column("bucket").to_numpy())
        least_of = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_of, number, doc)
        later = doc > least_of[number]
        held.append((doc[later], t.column("row").to_numpy()[later], string[later]))
        n += len(held[-1][0])
        if n >= KEYS:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def without(data: bytes, removed: np.ndarray) -> tuple[bytes, int, int]:
    """The remaining bytes, the number of bytes removed and of maximal removed spans, from the strings removed."""
    gone = np.zeros(len(data) + 1, np.int32)
    at = np.flatnonzero(removed)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + LENGTH, -1)
    gone = np.cumsum(gone[: len(data)]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def shared_keys(rows: DataFrame, parts: int, tasks: int) -> DataFrame:
    """_id and keys, of each document that has shared buckets."""
    packed = rows.select("doc_id", "text").mapInArrow(lambda x: tidy(packed_buckets(x, parts)), PACKED)
    shared = packed.repartition(min(parts, max(tasks, 16)), "part").sortWithinPartitions("part").mapInArrow(lambda x: tidy(shared_buckets(x, 2 * tasks, parts)), "group int, ids binary, keys binary")
    return materialize(shared.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(lambda x: tidy(document_keys(x)), "_id long, keys binary"), "keys")


def settled_runs(others: DataFrame, parts: int, tasks: int) -> DataFrame:
    """_doc, _row and packed runs: done (wholly repeated) and todo (to look into)."""
    found = others.select("doc_id", "row", "text", "keys").mapInArrow(lambda x: tidy(document_runs(x, parts)), RUN_SCHEMA)
    return materialize(gathered(found.repartition(tasks, "bucket").sortWithinPartitions("bucket"), refined, tasks, "done", "todo"), "runs")


def same_row(texts: DataFrame, found: DataFrame) -> Column:
    """Joins by doc_id alone, by which texts are bucketed; row, which tells rows with one doc_id apart, is checked on what meets."""
    return (texts["doc_id"] == found["_doc"]) & (texts["row"].bitwiseXOR(found["_row"]) == 0)


def settled_strings(others: DataFrame, per_row: DataFrame, tasks: int) -> DataFrame:
    """_d, _r and the identifiers of repeated strings in open runs."""
    asked = per_row.where(F.size("todo") > 0)
    open_ = others.join(asked, same_row(others, asked)).select("doc_id", "row", "text", "todo")
    strings = open_.mapInArrow(lambda x: tidy(open_strings(x)), "string long, bucket long, doc_id long, row long")
    later = gathered(strings.repartition(tasks, "string").sortWithinPartitions("string"), repeated_strings, tasks, "strings")
    return materialize(later.withColumnsRenamed({"_doc": "_d", "_row": "_r"}), "strings")


def removals(docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, text, keep), in buckets by doc_id and row; and per row that has any shared bucket, what is removed.

    The latter: _doc, _row, done (packed runs of strings wholly repeated), todo (runs to look into), strings (identifiers repeated).
    Each step is written to the shared scratch folder; its shuffle files go before the next step begins.
    """
    spark = docs.sparkSession
    rows = documents(docs, *keep)
    parts, tasks = parts_for(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = shared_keys(rows, parts, tasks)
    release(spark)
    joined = rows.join(wanted, rows["doc_id"] == wanted["_id"], "left").select("doc_id", F.xxhash64("text").alias("row"), "text", "keys", *keep)
    table = bucketed(joined, "documents", "doc_id")
    release(spark)
    others = table.where("keys IS NOT NULL")
    per_row = settled_runs(others, parts, tasks)
    release(spark)
    lists = settled_strings(others, per_row, tasks)
    release(spark)
    both = per_row.join(lists, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")), "left").select("_doc", "_row", "done", "todo", "strings")
    return table.select("doc_id", "row", "text", *keep), both


def removed_strings(data: bytes, done: np.ndarray, todo: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which strings of a document go."""
    n = max(0, len(data) - LENGTH + 1)
    out = covered(done, n)
    if len(todo) and len(strings):
        b50 = identifiers(data)[1]
        out |= covered(todo, n) & np.isin(b50.view(np.int64), strings)
    return out


def substring_dedup(docs: DataFrame, *keep: str, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the columns keep of every row; kept (the remaining text, less characters cut in two) with_text."""
    texts, found = removals(docs, *keep)
    lists = ("done", "todo", "strings")
    rows = texts.join(found, same_row(texts, found), "left").select("doc_id", "text", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in lists], *keep)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    schema = T.StructType(schema.fields + [T.StructField("kept", T.StringType())] * with_text + [rows.schema[c] for c in keep])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, *found in zip(b.column("doc_id").to_pylist(), b.column("text"), *(b.column(c) for c in lists), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                done, todo, strings = (x.values.to_numpy() for x in found)
                kept, n, spans = without(data, removed_strings(data, done, todo, strings)) if len(done) or len(strings) else (data, 0, 0)
                out.append((doc_id, len(data), n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)[: 5 + with_text])
            types = [pa.int64()] * 4 + [pa.string()] * 2
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types)] + [b.column(c) for c in keep], names=names)

    return rows.mapInArrow(lambda x: tidy(work(x)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of text; characters that lose some of their bytes go. Texts that lose nothing stay, null ones too."""
    rest = F.struct(F.col("text").isNull().alias("_null"), *[F.col(c).alias(f"_{c}") for c in docs.columns if c != "text"])
    out = substring_dedup(docs.select("doc_id", "text", rest.alias("_rest")), "_rest", with_text=True)
    text = F.when(~F.col("_rest")["_null"], F.col("kept"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_rest")[f"_{c}"].alias(c) for c in docs.columns])
