"""Packing of instruction data by vector bin packing with the dot-product heuristic.

Items have a vector of demands: tokens, segments (one each) and loss-bearing tokens (responses; prompts bear no loss). A sequence is open
at a time; the item with the largest dot product of its demands and what the sequence has left, both as shares of the limits, enters next, as long
as it fits in every dimension. If none fits, the item of which the longest beginning fits is cut there.

Every partition packs on its own, so no text is shuffled and no group meets in one task. A partition holds POOL items with their ids at most,
however many it has in all. The last sequence of a partition may be short; those of TAILS partitions are packed once more, together.

Defined results: a null or empty text is the end id alone; an empty table gives an empty table; repeated rows are packed as
rows of their own; an example longer than a sequence is cut; a null doc_id is kept; equal demands: the item that came last enters first;
equal dot products: more tokens, then more loss.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, key_groups, materialize, tidy
from quarry.llm.tokens import encoded, encoder, vocabulary

POOL, TAILS = 4_000, 64
END = b"\0\0\0\0"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Limits:
    """Of a sequence. Fewer loss-bearing tokens than tokens: a part is kept for prompts, so that sequences weigh alike in the loss."""

    tokens: int = 1024
    segments: int = 8
    loss_tokens: int = 1008


class Item(NamedTuple):
    """Ids of a document from start on; which places of the document bear loss, a tuple of (from, to); and its demands, see item()."""

    doc_id: int | None
    doc_tokens: int
    start: int
    data: bytes
    spans: tuple
    tokens: int
    loss: int
    lead: int

    def cut(self, n: int) -> tuple[Item, Item]:
        return item(self.doc_id, self.doc_tokens, self.start, self.data[: 4 * n], self.spans), item(self.doc_id, self.doc_tokens, self.start + n, self.data[4 * n :], self.spans)


def item(doc_id: int | None, doc_tokens: int, start: int, data: bytes, spans: tuple) -> Item:
    """An item with its tokens, how many of them bear loss, and how many come before the first that does (lead)."""
    n, loss, lead = len(data) // 4, 0, -1
    for i, j in spans:
        i, j = max(start, i), min(start + n, j)
        if i < j:
            loss += j - i
            lead = i - start if lead < 0 else lead
    return Item(doc_id, doc_tokens, start, data, spans, n, loss, n if lead < 0 else lead)


class Pool:
    """Items by class (tokens, loss-bearing tokens, lead), by tokens; an item of a class is as good as another. A class without items bears GONE."""

    GONE = 1 << 40

    def __init__(self, limits: Limits, items: list[Item]):
        by: dict[tuple[int, int, int], list[Item]] = defaultdict(list)
        for x in items:
            by[x.tokens, x.loss, x.lead].append(x)
        keys = sorted(by)
        self.items = [by[k] for k in keys]
        self.tokens, self.loss, self.lead = np.array(keys, np.int64).reshape(-1, 3).T.copy()
        self.size, self.by_tokens, self.by_loss = len(items), limits.loss_tokens**2, limits.tokens**2

    def best(self, tokens: int, loss: int) -> int | None:
        """The class that fits with the largest dot product with what is left, as shares of the limits; ties: more tokens, more loss.

        An item is one segment whatever its class, so that dimension only closes sequences; the others are compared as whole numbers.
        """
        n = int(np.searchsorted(self.tokens, tokens, side="right"))
        if not n:
            return None
        score = self.tokens[:n] * (tokens * self.by_tokens) + self.loss[:n] * (loss * self.by_loss)
        score[self.loss[:n] > loss] = -1
        at = n - 1 - int(score[::-1].argmax())
        return at if score[at] >= 0 else None

    def longest(self, tokens: int, loss: int) -> tuple[int, int]:
        """The class of whose items the longest beginning fits, and its length (0: none)."""
        fit = np.minimum(np.minimum(self.tokens, tokens), self.lead + loss)
        at = len(fit) - 1 - int(fit[::-1].argmax())
        return at, max(0, int(fit[at]))

    def take(self, at: int) -> Item:
        self.size -= 1
        found = self.items[at].pop()
        if not self.items[at]:
            self.loss[at], self.lead[at] = self.GONE, -self.GONE
        return found

    def put(self, new: Item) -> None:
        at = int(np.searchsorted(self.tokens, new.tokens))
        self.tokens, self.loss, self.lead = (np.insert(x, at, v) for x, v in ((self.tokens, new.tokens), (self.loss, new.loss), (self.lead, new.lead)))
        self.items.insert(at, [new])
        self.size += 1

    def tidy(self) -> None:
        """Drop the classes without items."""
        here = self.loss < self.GONE
        if 2 * np.count_nonzero(here) < len(here):
            self.items = [x for x in self.items if x]
            self.tokens, self.loss, self.lead = self.tokens[here], self.loss[here], self.lead[here]


def pack(items: list[Item], limits: Limits, whole: bool = False) -> list[list[Item]]:
    """Sequences of items, or of pieces of them; whole items are not cut, and none may then exceed the limits."""
    pool, out = Pool(limits, items), []
    while pool.size:
        tokens, segments, loss, sequence = limits.tokens, limits.segments, limits.loss_tokens, []
        pool.tidy()
        while tokens and segments and pool.size:
            at = pool.best(tokens, loss)
            if at is not None:
                piece = pool.take(at)
            else:
                at, n = pool.longest(tokens, loss)
                if whole or not n:
                    break
                piece, rest = pool.take(at).cut(n)
                pool.put(rest)
            sequence.append(piece)
            tokens, segments, loss = tokens - piece.tokens, segments - 1, loss - piece.loss
        if not sequence:
            raise ValueError("an item exceeds the limits")
        out.append(sequence)
    return out


def document_items(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[Item]:
    """Documents: the first line is the prompt, if more follows; the rest and the end id bear loss."""
    size = encoder(path).sizes
    for b in batches:
        for part, ids, offsets in encoded(b, path):
            at = np.r_[0, np.cumsum(size[ids])]
            for doc_id, text, i, j in zip(part.column("doc_id").to_pylist(), part.column("text"), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                line = text.as_buffer().to_pybytes().find(b"\n") + 1
                prompt = int(np.searchsorted(at[i : j + 1], at[i] + line)) if line else 0
                yield item(doc_id, j - i + 1, 0, ids[i:j].tobytes() + END, ((prompt, j - i + 1),))


def conversation_items(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[Item]:
    """Conversations, from turns sorted by doc_id and turn: each turn ends with the end id; the assistant's turns bear loss."""
    held, key, spans, n = [], None, [], 0
    for b in batches:
        for part, ids, offsets in encoded(b, path):
            for doc_id, role, i, j in zip(part.column("doc_id").to_pylist(), part.column("role").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if held and doc_id != key:
                    yield item(key, n, 0, b"".join(held), tuple(spans))
                    held, spans, n = [], [], 0
                key = doc_id
                held.append(ids[i:j].tobytes() + END)
                spans += [(n, n + j - i + 1)] * (role == "assistant")
                n += j - i + 1
    if held:
        yield item(key, n, 0, b"".join(held), tuple(spans))


def rows_of(sequence: list[Item], sequence_id: int) -> Iterator[tuple]:
    offset = 0
    for k, x in enumerate(sequence):
        yield x.doc_id, x.start, x.tokens, zlib.crc32(x.data), x.doc_tokens, sequence_id, offset, x.loss, k
        offset += x.tokens


def table(rows: list[tuple], tails: list[tuple[int, Item]] | None = None) -> pa.RecordBatch:
    """Rows of pieces; with tails (group, item) also their ids and spans, to be packed again."""
    cols = [pa.array(c, pa.int64()) for c in zip(*rows, *[(x.doc_id, x.start, x.tokens, 0, x.doc_tokens, g, 0, 0, 0) for g, x in tails or []], strict=True)] or [pa.array([], pa.int64())] * 9
    if tails is not None:
        none = [None] * len(rows)
        cols += [pa.array([*none, *(x.data for _, x in tails)], pa.binary()), pa.array([*none, *([k for s in x.spans for k in s] for _, x in tails)], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=[*NAMES, "_ids", "_spans"][: len(cols)])


def packed(items: Iterator[Item], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Pieces of the items of a partition, sequence by sequence; those of its last, short one as tails."""
    partition, sequences = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    rests: list[Item] = []

    def put(sequence: list[Item]) -> None:
        nonlocal sequences
        rows.extend(rows_of(sequence, (partition << 33) + sequences))
        sequences += 1

    def flush() -> None:
        nonlocal rests
        done, rests = pack(rests, limits), []
        if done and sum(x.tokens for x in done[-1]) < limits.tokens:  # it may still be filled
            rests = done.pop()
        for sequence in done:
            put(sequence)

    for x in items:
        while x.tokens > limits.tokens or x.loss > limits.loss_tokens:
            first, x = x.cut(min(x.tokens, limits.tokens, x.lead + limits.loss_tokens))
            if first.tokens == limits.tokens:
                put([first])
            else:
                rests.append(first)
        rests.append(x)
        if len(rests) >= POOL:
            flush()
        if len(rows) >= 10_000:
            yield table(rows, [])
            rows.clear()
    if rests:
        flush()
    yield table(rows, [(partition // TAILS, x) for x in rests])


def repacked(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Pieces of the tails of a group of partitions, from rows sorted by group."""
    for t in key_groups(batches, "sequence_id", rows=1):
        for group in sorted(set(t.column("sequence_id").to_pylist())):
            items = [item(r["doc_id"], r["doc_tokens"], r["start"], r["_ids"], tuple(zip(r["_spans"][::2], r["_spans"][1::2], strict=True))) for r in t.to_pylist() if r["sequence_id"] == group]
            sequences = pack(items, limits)
            yield table([r for k, s in enumerate(sequences) for r in rows_of(s, (1 << 62) + (group << 33) + k)])


def pack_rows(rows: DataFrame, items, limits: Limits) -> DataFrame:
    """One row per piece of the items that items(batches) makes of each partition's rows; sequence_id is unique. See SCHEMA."""
    first = materialize(rows.mapInArrow(lambda batches: tidy(packed(items(batches), limits), "encoders"), SCHEMA + ", _ids binary, _spans array<long>"), "packed")
    tails = first.where("_ids IS NOT NULL").repartition("sequence_id").sortWithinPartitions("sequence_id", "doc_id", "start", "doc_tokens", "_ids")
    return first.where("_ids IS NULL").select(*NAMES).union(tails.mapInArrow(lambda batches: tidy(repacked(batches, limits), "encoders"), SCHEMA))


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pieces of documents (doc_id, text); see document_items()."""
    path = path or vocabulary()
    return pack_rows(documents(docs), lambda batches: document_items(batches, path), limits)


def pack_conversations(turns: DataFrame, path: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pieces of conversations (conv_id, turn, role, text), conv_id as doc_id; see conversation_items()."""
    path = path or vocabulary()
    rows = documents(turns.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text"), "turn", "role").where("doc_id IS NOT NULL")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "turn", "role", "text")
    return pack_rows(rows, lambda batches: conversation_items(batches, path), limits)
