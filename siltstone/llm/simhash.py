"""SimHash fingerprints and their near-duplicate groups by a segment-popcount grid.

A fingerprint maps to its bit counts per segment. The Manhattan distance of two such vectors never
exceeds the fingerprints' Hamming distance, so all links lie within that range in the small integer
grid of the counts: each distinct fingerprint is joined to the cells that differ from its own by at
most ``distance`` steps (half of them, since a pair needs to meet once), and pairs are verified on
all 64 bits. Documents of equal fingerprint are one class from the start and are never paired.

Edge cases: null text and text without words have fingerprint zero, linked like any other; fewer
words than a shingle: the whole sequence is the one shingle; repeated rows get the same fingerprint;
a null doc_id keeps its row and counts for a component only if no other id is in it; a very long text
is hashed whole, in a run of its own; an empty table gives no rows; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components


def fingerprint_texts(texts: list[bytes | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = []
    for text in texts:
        parts = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
        before = len(hashes)
        if len(parts) > words:
            # slices of the words joined by single spaces
            line = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            starts = np.r_[0, ends[: -words]].tolist()
            hashes += [xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        elif parts:
            hashes.append(xxh64_intdigest(b" ".join(parts), seed))
        counts.append(len(hashes) - before)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = np.array(counts)[full]
    h = np.array(hashes, np.uint64)
    starts = np.cumsum(n) - n
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[full] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); fp holds the 64 bits as a signed long. No exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = [fingerprint_texts(texts.slice(a, b - a).to_pylist(), words, seed) for a, b in common.byte_slices(texts)]
            made = np.concatenate(fp) if fp else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(common.frugal(run), "doc_id long, fp long")


def steps(segments: int, distance: int) -> list[tuple[int, ...]]:
    """Integer vectors of Manhattan length 1 to ``distance``, one of each pair of opposites."""
    found = set()

    def grow(at: tuple[int, ...], left: int) -> None:
        found.add(at)
        if left:
            for i in range(segments):
                for d in (1, -1):
                    grow((*at[:i], at[i] + d, *at[i + 1 :]), left - 1)

    grow((0,) * segments, distance)
    return sorted(v for v in found if v > (0,) * segments)


def segments_for(n: int, distance: int) -> int:
    """The segment count with the least expected work over ``n`` fingerprints: probes that are
    sent, and pairs of random fingerprints that meet in the grid."""
    from math import comb

    def work(s: int) -> float:
        width = 64 // s
        tie = comb(2 * width, width) / 4**width  # two random segments have as many bits
        near = comb(2 * width, width + 1) / 4**width  # or one more
        meet = tie**s + 2 * s * tie ** (s - 1) * near + 4 * comb(s, 2) * tie ** (s - 2) * near**2 if s > 1 else 1.0
        return n * len(steps(s, distance)) + n * n / 2 * meet * 0.3

    return min((2, 4, 8, 16), key=work)


def links(prints: DataFrame, distance: int = 2, segments: int | None = None) -> DataFrame:
    """(a, b): pairs of distinct fingerprints ``fp`` at most ``distance`` bits apart."""
    n = prints.count()
    segments = segments or segments_for(n, distance)
    width = 64 // segments
    base = width + 2 * distance + 1  # room for steps either way, so no two cells share a number

    def part(i: int) -> F.Column:
        mask = ((1 << width) - 1) << (i * width)
        return F.bit_count(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)))

    def code(v) -> int:
        return sum(x * base**i for i, x in enumerate(v))

    # A cell is one number in a mixed radix; a step is a constant added to it.
    cell = sum((part(i) + distance).cast("long") * F.lit(base**i) for i in range(segments))
    cells = prints.select("fp", cell.alias("cell"))
    codes = [code(v) for v in steps(segments, distance)]
    moves = F.array(*map(F.lit, codes))
    moved = cells.select(F.col("fp").alias("a"), F.explode(moves).alias("move"), "cell").select("a", (F.col("cell") + F.col("move")).alias("cell"))
    near = moved.join(common.apart(cells.withColumnRenamed("fp", "b"), n * len(codes)), "cell").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    same = cells.select(F.col("fp").alias("a"), "cell").join(common.apart(cells.select(F.col("fp").alias("b"), "cell"), n), "cell")
    same = same.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select("a", "b").unionByName(same.select("a", "b"))


def groups(docs: DataFrame, distance: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) per row of (doc_id, text)."""
    rows = common.materialize(fingerprints(docs, words, seed), "fingerprints")
    classes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    n = classes.count()
    found = links(classes.select("fp"), distance)
    # The links are few; their ends are named by the smallest document of each class.
    ends = found.join(common.apart(classes.select(F.col("fp").alias("a"), F.col("first").alias("fa")), n), "a")
    ends = ends.join(common.apart(classes.select(F.col("fp").alias("b"), F.col("first").alias("fb")), n), "b")
    merged = connected_components(ends.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    named = classes.join(common.apart(merged, n), F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return rows.join(common.apart(named, rows.count()), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group, one for each; every column is kept.

    Of rows with the same doc_id and text one stays; rows that share a doc_id but not the text share
    its fate. Rows without a doc_id are kept.
    """
    kept = groups(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    return common.one_each(docs, kept)
