"""Near-duplicate vectors by exact comparison inside cells.

Vectors are compared only within a label (and a length). A label is one cell, in which every pair is
compared, unless it is so large that several passes over smaller cells cost less: then each pass hashes
every distinct vector to the signs of its products with random directions, and the vectors that agree
on the first k signs are a cell. How full the cells of each k are is counted on the label's own vectors,
so k is small where they crowd, and a crowded label is compared whole. The number of passes follows from k alone:
a pair at the very threshold shares no cell with probability ``miss`` at most, however the vectors lie.
Cells are compared in square tiles of bounded size; inside a task only a spanning forest of the links
leaves. All distinct vectors of a component are compared in tiles once more, which gives each vector
its number of links; only counts leave a tile.

Equal vectors are one class from the start, so copies neither fill windows nor make pairs.

Edge cases: a vector that is null, empty, zero, or has null or non-finite parts links with nothing,
nor does one with a null label or null id; repeated rows are vectors of their own that link with each
other; an empty table gives no rows; only vec_id, embedding and label are looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

BITS = 48
#: The most signs that name a cell.
MOST_BITS = 40
TILE = 128
CHUNK = 1024


def passes_for(k: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has shared a cell but for probability ``miss``.

    It shares one if ``k`` signs agree, each with probability 1 - angle / pi.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** k
    return math.ceil(math.log(miss) / math.log1p(-agree)) if k else 1


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of bytes to unit vectors in double precision."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of index pairs over ``n`` items."""
    root, kept = list(range(n)), []
    for a, b in pairs.tolist():
        x, y = a, b
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def classes(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, key, raw): key and bytes of each vector that may link, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            who, labels, values = (batch.column(i) for i in range(3))
            for i, parts in enumerate(values):
                raw = key = None
                if parts.is_valid and who[i].is_valid and labels[i].is_valid and parts.values.null_count == 0:
                    x = parts.values.to_numpy(zero_copy_only=False)
                    if len(x) and np.isfinite(x).all() and np.any(x):
                        raw = (x + 0).astype(kind).tobytes()  # -0.0 becomes 0.0
                        key = hashlib.blake2b(raw + labels[i].as_py().encode(), digest_size=16).digest()
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([who, labels, pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "key", "raw"])

    return vectors.mapInArrow(common.frugal(run), "vec_id long, label string, key binary, raw binary")


def signs(x: np.ndarray, turn: int) -> np.ndarray:
    """The signs of pass ``turn`` as numbers of ``BITS`` bits, the first sign highest."""
    along = np.random.default_rng([turn, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return ((x @ along) > 0) @ (1 << np.arange(BITS, dtype=np.int64))[::-1]


def plan(items: DataFrame, kind: str, copy: int, threshold: float, miss: float) -> DataFrame:
    """(label, size, k, passes) of each label and length: the cells with the least expected work, in
    comparisons; sending a vector to a cell counts as ``copy`` of them."""
    groups = items.groupBy("label", F.octet_length("raw").alias("size")).agg(F.count("*").alias("n"))
    limit = 2 * copy * passes_for(1, threshold, miss)  # below it no pass pays
    if (groups.agg(F.max("n")).first()[0] or 0) <= limit:
        return groups.select("label", "size", F.lit(0).alias("k"), F.lit(1).alias("passes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(signs(unit([raw[i] for i in rows], kind), 0))], names=["label", "size", "hash"])

    large = common.small(groups.where(F.col("n") > limit))
    seen = items.withColumn("size", F.octet_length("raw")).join(large, ["label", "size"]).select("label", "size", "raw")
    seen = seen.mapInArrow(common.frugal(hashed), "label string, size int, hash long")
    cells = seen.select("label", "size", "hash", F.explode(F.sequence(F.lit(1), F.lit(MOST_BITS))).alias("k"))
    cells = cells.groupBy("label", "size", "k", F.expr(f"shiftright(hash, {BITS} - k)").alias("prefix")).agg(F.count("*").cast("double").alias("m"))
    full = cells.groupBy("label", "size", "k").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    times = F.array(*[F.lit(passes_for(k, threshold, miss)) for k in range(MOST_BITS + 1)])
    full = full.withColumn("cost", F.get(times, F.col("k")) * (copy * F.col("n") + F.col("pairs") / 2))
    best = full.groupBy("label", "size").agg(F.min(F.struct("cost", "k")).alias("best"))
    whole = F.col("n").cast("double") * F.col("n") / 2
    out = groups.join(best, ["label", "size"], "left").withColumn("k", F.when(F.col("best.cost") < whole, F.col("best.k")).otherwise(0))
    return out.select("label", "size", "k", F.get(times, F.col("k")).alias("passes"))


def spanning(hits: np.ndarray, one: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile; rows come before columns unless both are the same."""
    found = []
    skip = 0 if one else len(hits)
    rows, columns = hits.any(axis=1), hits.any(axis=0)  # not reached yet
    if one:
        columns = rows
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            across, new, shift = (hits[at], columns, skip) if at < len(hits) else (hits[:, at - skip], rows, 0)
            near = np.flatnonzero(across & new)
            new[near] = False
            found += [(at, j + shift) for j in near.tolist()]
            todo += (near + shift).tolist()
    return found


def cell_edges(items: DataFrame, kind: str, first: int, count: int, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning edges of the links inside the cells of ``count`` passes.

    A cell of m vectors is dealt to chunks of ``chunk``; every two meet in one tile, as does every one with itself.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            shape = np.array([(len(r), k) for r, k in zip(raw, batch.column(3).to_pylist(), strict=True)]).reshape(-1, 2)
            passes = batch.column(4).to_numpy()
            for n, k in np.unique(shape, axis=0).tolist():
                own = np.flatnonzero((shape == (n, k)).all(axis=1))
                for p in range(first, first + count):
                    rows = own[passes[own] > p]
                    if not len(rows):
                        continue
                    prefix = signs(unit([raw[i] for i in rows], kind), p) >> (BITS - k) if k else np.zeros(len(rows), np.int64)
                    part = batch.select([0, 1, 2]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), p)), pa.array(np.full(len(rows), n)), *part.columns, pa.array(prefix)],
                        names=["pass", "size", "rep", "label", "raw", "prefix"],
                    )

    def edges(group: list[tuple]) -> list[tuple[int, int]]:
        one = group[0][4] == group[0][5]
        left, right = ([g for g in group if g[6] == group[0][k]] for k in (4, 5))
        if not left or not right:
            return []
        hits = unit([g[8] for g in left], kind) @ unit([g[8] for g in right], kind).T >= threshold
        if one:
            np.fill_diagonal(hits, False)
        names = [g[7] for g in (left if one else left + right)]
        return [(names[a], names[b]) for a, b in spanning(hits, one)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:6] != group[0][:6]:
                    found += edges(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        found = edges(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    cell = ["pass", "size", "label", "prefix"]
    spread = items.select("rep", "label", "raw", "k", "passes").mapInArrow(common.frugal(hashed), "pass long, size long, rep long, label string, raw binary, prefix long")
    large = common.small(spread.groupBy(*cell).agg(F.count("*").alias("m")).where(F.col("m") > chunk))
    rows = spread.join(large, cell, "left").withColumn("chunks", F.coalesce(F.ceil(F.col("m") / chunk), F.lit(1)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = [*cell, "lo", "hi"]
    rows = rows.select(*cell, F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rep", "raw")
    return rows.repartition(*tile).sortWithinPartitions(*tile, "rep").mapInArrow(common.frugal(compare), "a long, b long")


def link_counts(members: DataFrame, kind: str, threshold: float, tile: int = TILE) -> DataFrame:
    """(rep, links): for (component, rep, copies, raw), the vectors linked to each, itself excluded.

    A component of c vectors is dealt to chunks of about c / 8 of them, between ``tile`` and 16 times as
    many, by hash; every two chunks meet in one tile, as does every chunk with itself.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    rows = members.join(sizes, "component").withColumn("chunks", F.ceil(F.col("n") / F.greatest(F.lit(tile), F.least(F.lit(16 * tile), F.col("n") / 8))).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("component", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rep", "copies", "raw")

    def counted(group: list[tuple]) -> tuple[list, list]:
        left = [g for g in group if g[3] == g[1]]
        right = [g for g in group if g[3] == g[2]]
        copies = lambda s: np.array([g[5] for g in s])
        if not left or not right:
            return [], []
        hits = unit([g[6] for g in left], kind) @ unit([g[6] for g in right], kind).T >= threshold
        if group[0][1] == group[0][2]:
            np.fill_diagonal(hits, False)
            return [g[4] for g in left], (hits @ copies(right)).tolist()
        return [g[4] for g in left + right], [*(hits @ copies(right)).tolist(), *(copies(left) @ hits).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            reps: list = []
            links: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    r, n = counted(group)
                    reps, links, group = reps + r, links + n, []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(links, pa.int64())], names=["rep", "links"])
        r, n = counted(group) if group else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(n, pa.int64())], names=["rep", "links"])

    tiles = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "rep")
    return tiles.mapInArrow(common.frugal(run), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, window: int = 64, miss: float = 1e-5, at_once: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label).

    One more copy of a vector is taken to cost as much as 16 * ``window`` comparisons.
    """
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = common.materialize(classes(plain, kind), "vectors")
    items = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("raw").alias("raw"))
    items = common.materialize(items, "classes")
    plans = common.materialize(plan(items, kind, 16 * window, threshold, miss), "plan")
    passes = plans.agg(F.max("passes")).first()[0] or 1
    dealt = items.withColumn("size", F.octet_length("raw")).join(common.small(plans), ["label", "size"])
    edges = None
    for first in range(0, passes, at_once):  # a few passes at a time bound the disk that copies take
        some = common.materialize(cell_edges(dealt, kind, first, min(at_once, passes - first), threshold), "links")
        edges = some if edges is None else edges.unionByName(some)
    merged = common.materialize(connected_components(edges), "components")
    members = items.join(merged, F.col("rep") == F.col("node")).select("component", "rep", "copies", "raw")
    links = link_counts(members, kind, threshold)
    named = merged.join(links, F.col("node") == F.col("rep"), "left").select("node", "component", "links")
    found = items.select("key", "rep", "copies").join(named, F.col("rep") == F.col("node"), "left")
    found = found.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
