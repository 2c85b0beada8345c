"""Token-id output as patched frame-of-reference blocks.

A segment is one binary value with the ids of consecutive documents:

    magic "QPF1" | u32 blocks | u32 documents | u64 ids | u32 x (blocks + 1) block starts
    | i64 x documents doc_id | u32 x documents ids of the document | blocks

and a block has up to BLOCK ids:

    u32 minimum | u16 ids | u8 width | u8 zero | u16 exceptions | u16 zero | packed bits | u16 x exceptions places | u32 x exceptions values

Ids less the block minimum are packed at the width that the PERCENTILE of them needs; those that need more are kept
whole in the exception list. Block starts are indexed, so that decode(segment, first, n) reads only the blocks it needs.

Segments are the rows of a Parquet table in ascending doc_id order (Spark's commit protocol then covers lost executors,
and the path may be in any store that Spark writes). Documents are dealt out by range of doc_id, a task per range.

Defined results: a null or empty text is the end id alone; an empty table gives no segment; repeated doc_ids keep all their
rows, ordered by text; a null doc_id sorts first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, tidy
from quarry.llm.tokens import encoded, vocabulary

MAGIC, BLOCK, PERCENTILE, SEGMENT = b"QPF1", 512, 90, 1 << 20
NO_ID = -(1 << 63)
SEGMENT_SCHEMA = "part int, number int, n_ids long, payload binary"


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids; full blocks of one width are packed together."""
    whole = len(ids) // BLOCK * BLOCK
    out: list[bytes] = []
    for part in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        n = part.shape[1]
        if not part.size:
            continue
        low = part.min(axis=1)
        rest = (part - low[:, None]).astype("<u4")
        at = min(n - 1, -(-PERCENTILE * (n - 1) // 100))
        widths = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(float))[1]
        outlier = rest.astype(np.uint64) >> widths[:, None].astype(np.uint64) > 0
        packed = np.where(outlier, 0, rest).astype("<u4")
        bodies: dict[int, bytes] = {}
        for w in np.unique(widths).tolist():
            which = np.flatnonzero(widths == w)
            bits = np.unpackbits(packed[which].reshape(-1).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
            bodies |= zip(which.tolist(), map(bytes, np.packbits(bits.reshape(len(which), n * w), axis=1, bitorder="little")), strict=True)
        counts = outlier.sum(axis=1)
        for k, (m, w, c) in enumerate(zip(low.tolist(), widths.tolist(), counts.tolist(), strict=True)):
            block = struct.pack("<IHBBHH", m, n, w, 0, c, 0) + bodies[k]
            if c:
                places = np.flatnonzero(outlier[k])
                block += places.astype("<u2").tobytes() + rest[k][places].tobytes()
            out.append(block)
    return out


def decode_block(data: memoryview) -> np.ndarray:
    low, n, width, _, exceptions, _ = struct.unpack_from("<IHBBHH", data)
    size = (n * width + 7) // 8
    out = np.zeros((n, 32), np.uint8)
    if width:
        out[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, 12), bitorder="little", count=n * width).reshape(n, width)
    ids = np.packbits(out, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    if exceptions:
        places = np.frombuffer(data, "<u2", exceptions, 12 + size)
        ids[places] = np.frombuffer(data, "<u4", exceptions, 12 + size + 2 * exceptions)
    return ids + np.uint32(low)


def encode_segment(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])
    head = MAGIC + struct.pack("<IIQ", len(blocks), len(doc_ids), len(ids))
    return b"".join([head, starts.astype("<u4").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), *blocks])


class Segment:
    """Reads a segment: its documents, and any range of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.data = memoryview(data)
        blocks, documents_, self.n_ids = struct.unpack_from("<IIQ", data, 4)
        at = 20
        self.starts = np.frombuffer(data, "<u4", blocks + 1, at)
        at += 4 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", documents_, at)
        at += 8 * documents_
        self.counts = np.frombuffer(data, "<u4", documents_, at)
        self.at = at + 4 * documents_

    def decode(self, first: int = 0, n: int | None = None) -> np.ndarray:
        end = self.n_ids if n is None else min(self.n_ids, first + n)
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (end - 1) // BLOCK + 1
        ids = [decode_block(self.data[self.at + int(self.starts[k]) : self.at + int(self.starts[k + 1])]) for k in range(a, b)]
        return np.concatenate(ids)[first - a * BLOCK : end - a * BLOCK]


def segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Segments of about size ids of the documents of a partition, in the order in which they come."""
    part, number = TaskContext.get().partitionId(), 0
    doc_ids, counts, held, n = [], [], [], 0
    end = np.array([end_id], np.uint32)

    def segment() -> pa.RecordBatch:
        nonlocal number, n
        payload = encode_segment(doc_ids, counts, np.concatenate(held))
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["part", "number", "n_ids", "payload"])
        for x in (doc_ids, counts, held):
            x.clear()
        number, n = number + 1, 0
        return out

    for b in batches:
        for rows, ids, offsets in encoded(b, path):
            for doc_id, i, j in zip(rows.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                counts.append(j - i + 1)
                held += [ids[i:j], end]
                n += j - i + 1
                if n >= size:
                    yield segment()
    if doc_ids:
        yield segment()


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2, size: int = SEGMENT, name: str = "tokens") -> DataFrame:
    """Write all documents in ascending doc_id order as segments; the table of segments, read from the files."""
    path = path or vocabulary()
    rows = documents(docs)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(lambda batches: tidy(segments(batches, path, end_id, size), "encoders"), SEGMENT_SCHEMA), name)


def read_documents(written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the written segments."""
    sizes = written.select("part", "number", "n_ids")
    # Ids before each part: as many rows as write tasks, so their sum may meet in one place.
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.selectExpr("part AS _part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before")
    within = sizes.selectExpr("part AS _p", "number AS _n", "sum(n_ids) OVER (PARTITION BY part ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _within")
    starts = within.join(before, within["_p"] == before["_part"]).selectExpr("_p", "_n", "coalesce(_before, 0) + coalesce(_within, 0) AS _start")
    schema = "part int, number int, doc_id long, first long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, payload in zip(b.column("part").to_pylist(), b.column("number").to_pylist(), b.column("payload"), strict=True):
                s = Segment(payload.as_py())
                ids = s.decode().astype("<u4")
                ends = np.cumsum(s.counts.astype(np.int64))
                firsts = ends - s.counts
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(firsts.tolist(), ends.tolist(), strict=True)]
                k = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([number] * k, pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NO_ID), pa.array(firsts, pa.int64()), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    rows = written.select("part", "number", "payload").mapInArrow(decode, schema)
    placed = rows.join(starts, (rows["part"] == starts["_p"]) & (rows["number"] == starts["_n"]))
    return placed.select("doc_id", (F.col("_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
