"""Helpers shared by the training-data operators: scratch tables, prefix sums, readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import scratch_path

#: White space of the word contracts: space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to a Parquet table in the scratch folder and read it back.

    Cuts lineage like ``checkpoint()``: later stages read committed files, so a lost executor never
    recomputes what came before, and anything that depends on task numbers is fixed for good.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_slices(texts, most: int = 2 << 20):
    """(start, stop) of runs of an Arrow column of strings or binaries with about ``most`` bytes each,
    so that no more than one run is turned into Python objects at a time."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def byte_chunks(raw: bytes, sign: bytes = b" ", most: int = 1 << 20):
    """The bytes of a text in parts of about ``most``, each starting at a ``sign``; a run without one stays whole."""
    at = 0
    while len(raw) - at > most:
        to = raw.rfind(sign, at + 1, at + most)
        to = to if to > 0 else raw.find(sign, at + most)
        if to < 0:
            break
        yield raw[at:to]
        at = to
    yield raw[at:] if at else raw


def give_back() -> None:
    """Return this process's free memory to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def frugal(run):
    """A function over Arrow batches that gives its memory back to the system when it ends, since
    Python workers idle beside the stages that follow."""

    def ran(batches):
        yield from run(batches)
        give_back()

    return ran


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def apart(df: DataFrame, rows: int, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for a sort-merge join if it may have more than ``most_rows`` rows.

    Spark broadcasts by the size of files, which compression hides and which an explode doesn't raise:
    unmarked, a table of millions of rows can be sent through the driver.
    """
    return df.hint("merge") if rows > most_rows else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; extra columns of any name are left behind here."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def one_each(docs: DataFrame, kept: DataFrame, rows: int = 0) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``kept``, one for each id and text, and those without a doc_id.
    ``kept`` has at most ``rows`` rows, if that is known."""
    named = docs.where("doc_id is not null").select("doc_id", F.struct("*").alias("row")).join(apart(kept, rows), "doc_id", "left_semi")
    # The join leaves the rows dealt by doc_id, so this aggregate needs no exchange of its own.
    once = named.groupBy("doc_id", F.sha2(F.col("row.text"), 256).alias("_text")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    nameless = docs.where("doc_id is null").select(F.struct("*").alias("row"))
    return once.select("row").unionByName(nameless).select("row.*")


def with_positions(df: DataFrame, what: str) -> DataFrame:
    """Add ``_pid`` and ``_idx`` (place within the partition) and write the result.

    The order is that of the partitions as they come; ``materialize`` fixes it.
    """
    row = F.monotonically_increasing_id()
    return materialize(df.withColumn("_row", row), what).select(
        "*", F.shiftright("_row", 33).alias("_pid"), F.col("_row").bitwiseAND((1 << 33) - 1).alias("_idx")
    ).drop("_row")


def collect_floor(rows: DataFrame, key: str, total: str, out: str, within: str | None = None) -> DataFrame:
    """Exclusive prefix sum of ``total`` in the order (key, within).

    Two levels: sums of each ``key`` (as many rows as there were partitions) are summed first, then
    the rows inside one key.
    """
    from pyspark.sql import Window

    tops = rows.groupBy(key).agg(F.sum(total).alias("_t"))
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_base"))
    if within is None:
        return rows.join(tops, key).withColumn(out, F.col("_base")).drop("_base")
    inner = Window.partitionBy(key).orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(total).over(inner), F.lit(0)))
    return rows.join(tops, key).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it in an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, chunk: int = 128) -> Column:
    """array<int>, one longer than ``values``: the running total, from 0, of an associative ``op``.

    Chunks are totalled first, then the totals, then the values within each chunk: growing one array
    by one value at a time would copy it every time.
    """

    def along(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def whole(v: Column) -> Column:
        ks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / chunk).cast("int") - 1, F.lit(0)))
        part = lambda k: F.slice(v, k * chunk + 1, chunk)
        totals = F.transform(ks, lambda k: F.aggregate(part(k), F.lit(0), op))
        inside = lambda starts: F.flatten(F.transform(ks, lambda k: F.slice(along(part(k), F.get(starts, k)), 2, chunk)))
        long = let(along(totals, F.lit(0)), lambda starts: F.concat(F.array(F.lit(0)), inside(starts)))
        return F.when(F.size(v) <= chunk, along(v, F.lit(0))).otherwise(long)

    return let(values, whole)


def quantile_edges(rows: DataFrame, column: str, rows_each: int = 2048, least: int = 512, most: int = 1 << 16) -> list:
    """Approximate quantiles of a column that split it into about ``rows_each`` rows apiece."""
    parts = min(most, max(least, rows.count() // rows_each))
    cut = rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(cut or []))


def bucket(value: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are below ``value`` (-1 for null), by a search of 32 ways."""
    if not edges:
        return F.when(value.isNull(), -1).otherwise(0)
    table = F.array(*map(F.lit, edges))
    at = F.lit(0)
    step = 1
    while step * 32 < len(edges) + 1:
        step *= 32
    places = F.array(*map(F.lit, range(1, 33)))
    while step:
        at = _search(at, table, value, step, places)
        step //= 32
    return F.when(value.isNull(), -1).otherwise(at)


def _search(at: Column, table: Column, value: Column, step: int, places: Column) -> Column:
    below = lambda a: F.filter(places, lambda j: F.coalesce(F.get(table, (a + j * step - 1).cast("int")) < value, F.lit(False)))
    return let(at, lambda a: a + step * F.size(below(a)))
