"""Near-duplicate documents by the Jaccard similarity of their word shingles.

A document is the set of its runs of ``words`` words. Candidates come from SimHash, whose fingerprints over
the same shingles link at two bits (``simhash.links``), and from MinHash, since most pairs at the threshold are more bits apart than
a popcount grid can tell from chance: documents that agree on one of ``BANDS`` bands of ``ROWS`` minima meet
in a bucket, and stay together if 256 one-bit minima don't rule the similarity out. What candidates connect is then compared exactly, set by set, in tiles
of bounded size, so no link below the threshold is ever made and only components leave a task.

A pair at the very threshold 0.8 meets in no bucket with probability (1 - 0.8**3)**20 = 6e-7 and is ruled
out by the bits with less than 1e-6; a more similar pair with less.

Edge cases: words and short texts as in ``simhash``; all texts without words are copies of one another;
rows without a doc_id take no part; repeated rows are copies; a very long text is a set like others, held whole
by the task that hashes it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import connected_components
from .embed_dedup import forest

ROWS, BANDS, SIGNS = 3, 20, 256
TILE = 128


def shingles(text: bytes | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.r_[0, ends[:-words]].tolist()
    return np.unique(np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def most_unlike(threshold: float, miss: float = 1e-6) -> int:
    """Differing signs that a pair at the threshold exceeds with probability ``miss`` at most."""
    p, tail = (1 - threshold) / 2, 1.0
    for d in range(SIGNS + 1):
        tail -= comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d)
        if tail <= miss:
            return d
    return SIGNS


@cache
def orders() -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the orders whose first elements are the minima."""
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, SIGNS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, SIGNS, np.uint64)


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """(signs, bands) of a set that isn't empty."""
    times, plus = orders()
    low = np.full(SIGNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        h = hashes[at : at + 2048]
        mixed = (h ^ (h >> np.uint64(31)))[None, :] * times[:, None] + plus[:, None]
        low = np.minimum(low, mixed.min(axis=1))
    signs = np.packbits(((low >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)).tobytes()
    bands = [int.from_bytes(hashlib.blake2b(bytes([i]) + low[i * ROWS : (i + 1) * ROWS].tobytes(), digest_size=8).digest(), "little", signed=True) for i in range(BANDS)]
    return signs, bands


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, signs, bands, fp) of (doc_id, text); key stands for the set, fp is the SimHash
    fingerprint. No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            keys, signs, bands, prints = [], [], [], [np.empty(0, np.uint64)]
            for a, b in common.byte_slices(texts):
                some = texts.slice(a, b - a).to_pylist()
                prints.append(simhash.fingerprint_texts(some, words))
                for text in some:
                    h = shingles(text, words)
                    s, m = sketch(h) if len(h) else (b"", [])
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    signs.append(s)
                    bands.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "key", "signs", "bands", "fp"])

    return docs.mapInArrow(common.frugal(run), "doc_id long, key binary, signs binary, bands array<long>, fp long")


def tree(signs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows whose bits differ in ``most`` places at most: each row
    reached is compared once with the rows not reached yet."""
    left, found = np.arange(len(signs)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(signs[left] ^ signs[at]).sum(axis=1, dtype=np.int64) <= most
            hit = left[near].tolist()
            found += [(at, b) for b in hit]
            todo += hit
            left = left[~near]
    return found


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that connect the classes ``first`` that may be similar."""
    most = most_unlike(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(group: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
            signs = np.frombuffer(b"".join(g[1] for g in group), np.uint64).reshape(len(group), -1)
            return [(group[i][0], group[j][0]) for i, j in tree(signs, most)]

        group: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for band, first, signs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if band != now:
                    if len(group) > 1:
                        found += edges(group)
                    group, now = [], band
                group.append((first, signs))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = edges(group) if len(group) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = classes.select(F.explode("bands").alias("band"), "first", "signs")
    return met.repartition("band").sortWithinPartitions("band", "first").mapInArrow(common.frugal(run), "a long, b long")


def alike(classes: DataFrame) -> DataFrame:
    """(a, b): edges that connect the classes ``first`` whose fingerprints are equal or linked."""
    prints = common.materialize(classes.groupBy("fp").agg(F.min("first").alias("head")), "prints")
    n = prints.count()
    equal = classes.join(common.apart(prints, n), "fp").select(F.col("head").alias("a"), F.col("first").alias("b"))
    ends = simhash.links(prints.select("fp")).join(common.apart(prints.select(F.col("fp").alias("a"), F.col("head").alias("ha")), n), "a")
    ends = ends.join(common.apart(prints.select(F.col("fp").alias("b"), F.col("head").alias("hb")), n), "b")
    return equal.where("a <> b").unionByName(ends.select(F.col("ha").alias("a"), F.col("hb").alias("b")))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Index pairs (left, right), or pairs of left alone, of sets at least that similar."""
    both = left + (right or [])
    size = np.array([len(s) for s in both])
    _, ids = np.unique(np.concatenate(both), return_inverse=True)
    ends = np.cumsum(size)
    skip = len(left) if right else 0
    base = ends[skip - 1] if skip else 0
    starts, marked = ends[skip:] - size[skip:] - base, np.zeros(len(ids), np.int32)
    others, sizes, found = ids[base:], size[skip:], []
    for i in range(len(left)):
        own = ids[ends[i] - size[i] : ends[i]]
        marked[own] = 1
        same = np.add.reduceat(marked[others], starts)
        marked[own] = 0
        # the comparison as Python's division does it
        near = same / (size[i] + sizes - same) >= threshold
        if not right:
            near[: i + 1] = False
        j = np.flatnonzero(near)
        found.append(np.stack([np.full(len(j), i), j + skip], axis=1))
    return np.concatenate(found)


def links(members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b): spanning edges of the links among (component, first, raw) of each component.

    A component is dealt to chunks of ``tile`` to four times as many; every two chunks meet in one tile.
    """
    sizes = common.apart(members.groupBy("component").agg(F.count("*").alias("n")), members.count())
    rows = members.join(sizes, "component").withColumn("chunks", F.ceil(F.col("n") / F.greatest(F.lit(tile), F.least(F.lit(4 * tile), F.col("n") / 8))).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("first"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("component", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "first", "raw")

    def edges(group: list[tuple]) -> list[tuple[int, int]]:
        left, right = ([g for g in group if g[3] == group[0][k]] for k in (1, 2))
        if not left or not right:
            return []
        sets = [[np.frombuffer(g[5], np.uint64) for g in side] for side in (left, right)]
        one = group[0][1] == group[0][2]
        names = [g[4] for g in (left if one else left + right)]
        pairs = linked(sets[0], None if one else sets[1], threshold)
        return [(names[a], names[b]) for a, b in forest(pairs, len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += edges(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = edges(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    tiles = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "first")
    return tiles.mapInArrow(common.frugal(run), "a long, b long")


def copies(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """((key, first), (node, component), n): the ``n`` sets with their smallest doc_id, and the components
    of those ids that are linked to another."""
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = sketches(source, words).groupBy("key").agg(F.min("doc_id").alias("first"), F.min("signs").alias("signs"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    classes = common.materialize(rows, "classes")
    n = classes.count()
    met = common.materialize(connected_components(candidates(classes, threshold).unionByName(alike(classes))), "met")
    linked_ids = met.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.byte_slices(texts):
                raw = [shingles(t, words).tobytes() for t in texts.slice(a, b - a).to_pylist()]
                keys = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["key", "raw"])

    wanted = classes.select("key", "first").join(common.apart(met, linked_ids), F.col("first") == F.col("node")).select("key", "first", "component")
    wanted = common.apart(wanted, linked_ids)
    some = source.join(common.apart(wanted.select(F.col("first").alias("doc_id")).distinct(), linked_ids), "doc_id", "left_semi")
    raw = some.select("doc_id", "text").mapInArrow(common.frugal(sets), "key binary, raw binary")
    members = common.materialize(raw.dropDuplicates(["key"]).join(wanted, "key").select("component", "first", "raw"), "members")
    return classes.select("key", "first"), connected_components(links(members, threshold)), n


def deduplicated(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component; every column is kept.

    Repeated rows, rows with the same doc_id and rows without one are treated as in ``simhash.deduplicated``.
    """
    classes, merged, n = copies(docs, threshold, words)
    others = merged.where("node <> component").select(F.col("node").alias("first"))
    kept = classes.join(common.apart(others, n), "first", "left_anti").select(F.col("first").alias("doc_id")).distinct()
    return common.one_each(docs, kept, n)
