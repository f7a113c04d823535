"""Token-ID output in patched frame-of-reference blocks.

File format (little-endian). A file is one segment and a closing line feed::

    header   magic "PFB1", u32 partition, u32 segment, u32 documents, u64 ids, u32 blocks
    docs     i64 doc_id * documents, u8 has_id * documents, u32 ids * documents
    index    u64 start of each block, counted from the first block
    blocks   u32 minimum, u8 width, u8 exceptions, packed low bits of 128 values,
             exceptions * (u8 place, u32 value above the minimum)

A block holds 128 ids of the running id stream (the last one is filled up with its own minimum).
``width`` is the bit length at the chosen percentile of the block's distances to its minimum; what
needs more bits goes to the exception list. A segment holds whole documents in ascending doc_id
order, segments follow one another by (partition, segment).

Files are written by Spark's own text writer, whose rows are raw bytes, so they are committed like
any other output and may lie in any store that Spark reaches; they are read by ``binaryFile``.

Edge cases: null and empty texts give a document of the end id alone; rows with a null doc_id come
first; repeated rows are kept, ordered by text; an empty table gives no segment and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encode_batches, load_definition

BLOCK = 128
HEAD = struct.Struct("<4sIIIQI")
MAGIC = b"PFB1"
#: Ids after which a segment is closed at the next document end (about 4 MB of ids in memory).
SEGMENT_IDS = 1 << 20


#: Bit lengths of the values below 2**16, which nearly all distances are.
SHORT_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs; 0 for 0."""
    if values.size and values.max() < len(SHORT_BITS):
        return SHORT_BITS[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.int8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width to (blocks, 16 * width) bytes."""
    words = np.zeros((2 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[at] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), 16 * width)


def unpack(data: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").reshape(len(data), 2 * width).T)
    out = np.empty((BLOCK, len(data)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        v = words[at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[at + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return out.T


def encode_blocks(ids: np.ndarray, percentile: float) -> tuple[bytes, np.ndarray]:
    """The blocks of an id stream and the start of each."""
    if not len(ids):
        return b"", np.empty(0, np.uint64)
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    above = full - low[:, None]
    bits = bit_lengths(above)
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, rank, axis=1)[:, rank].astype(np.int64)
    wide = bits > width[:, None]
    outliers = wide.sum(axis=1)
    sizes = 6 + 16 * width + 5 * outliers
    start = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4")[:, None].view(np.uint8)
    out[start + 4], out[start + 5] = width, outliers
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            kept = np.where(wide[rows], 0, above[rows])
            out[start[rows][:, None] + 6 + np.arange(16 * w)] = pack(kept, int(w))
    row, place = np.nonzero(wide)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    at = start[row] + 6 + 16 * width[row] + 5 * nth
    out[at] = place
    out[at[:, None] + 1 + np.arange(4)] = above[row, place].astype("<u4")[:, None].view(np.uint8)
    return out.tobytes(), start.astype(np.uint64)


def decode_blocks(data: bytes | memoryview, start: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of blocks that begin at ``start``."""
    if not count:
        return np.empty(0, np.uint32)
    raw, start = np.frombuffer(data, np.uint8), start.astype(np.int64)
    low = np.ascontiguousarray(raw[start[:, None] + np.arange(4)]).view("<u4").ravel()
    width, outliers = raw[start + 4].astype(np.int64), raw[start + 5].astype(np.int64)
    full = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            full[rows] = unpack(raw[start[rows][:, None] + 6 + np.arange(16 * w)], int(w))
    row = np.repeat(np.arange(len(start)), outliers)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    at = start[row] + 6 + 16 * width[row] + 5 * nth
    full[row, raw[at]] = np.ascontiguousarray(raw[at[:, None] + 1 + np.arange(4)]).view("<u4").ravel()
    full += low[:, None]
    return full.ravel()[:count]


def encode_segment(part: int, number: int, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, percentile: float) -> bytes:
    blocks, start = encode_blocks(ids, percentile)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, part, number, len(doc_ids), len(ids), len(start))
    return b"".join([head, names.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), start.astype("<u8").tobytes(), blocks])


def decode_segment(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """(partition, segment, doc ids, ids of each document, all ids) of one file."""
    magic, part, number, docs, count, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    at = HEAD.size
    names = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    start = np.frombuffer(data, "<u8", blocks, at + 13 * docs)
    ids = decode_blocks(memoryview(data)[at + 13 * docs + 8 * blocks :], start, count)
    return part, number, [int(n) if k else None for n, k in zip(names, known, strict=True)], sizes, ids


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, percentile: float = 0.9, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode (doc_id, text) and write segment files under ``path``.

    One shuffle, by ranges of doc_id. A task holds one segment and one document at a time.
    """
    definition = load_definition(tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            data = encode_segment(part, number, names, np.concatenate(sizes), np.concatenate(ids), percentile)
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for batch in batches:
            who = batch.column(0).to_pylist()
            for at, flat, counts in encode_batches(batch.column(1), definition, end_id):
                names += who[at : at + len(counts)]
                sizes.append(counts)
                ids.append(flat)
                held += len(flat)
                if held >= segment_ids:
                    yield close()
                    number += 1
                    names, sizes, ids, held = [], [], [], 0
        if names:
            yield close()

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    files = ordered.mapInArrow(common.frugal(segments), "data binary").select(F.col("data").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: part, segment, place, doc_id, first (ids of its segment before
    it), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                if len(data) <= 1:
                    continue
                part, number, names, sizes, ids = decode_segment(data)
                ends = np.cumsum(sizes)
                wire = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wire[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(names)
                columns = [[part] * n, [number] * n, list(range(n)), names, ends - sizes, sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "segment", "place", "doc_id", "first", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(common.frugal(documents), "part long, segment long, place long, doc_id long, first long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token blocks, read them back, and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or common.scratch_path(spark, "token-blocks")
    write_tokens(docs, path, tokenizer_path, **options)
    rows = common.materialize(read_tokens(spark, path), "token-index")
    totals = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("ids"))
    totals = common.collect_floor(totals, "part", "ids", "before", within="segment").select("part", "segment", "before")
    return rows.join(totals, ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
