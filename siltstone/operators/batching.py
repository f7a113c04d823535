"""Cutting an ordered list of files into batches of a byte budget.

A batch takes files in order until the next one wouldn't fit; a file over the budget is a batch of its own.
Each batch starts where the last one ended, so batch numbers are no running sum. Instead every file gets a
pointer to the file at which a batch that started with it would end, found by a search among the running sums;
the starts that are reached from the first file are then found by doubling the pointers, in as many rounds as
the number of batches has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import scratch_path, written

from .ranges import running_max, sums_before


def next_starts(placed: DataFrame, budget: int) -> DataFrame:
    """(at, to): for the file at each place, from 0, of (place, before, size) the place at which its batch would end."""
    ends = placed.select((F.col("before") + F.col("size")).alias("value"), F.lit(0).alias("asks"), F.col("place").alias("ends_at"), F.lit(None).cast("long").alias("at"))
    asks = placed.select((F.col("before") + budget).alias("value"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("ends_at"), F.col("place").alias("at"))
    # The last file that ends within the budget is the largest place among the ends up to that value.
    met = running_max(ends.unionByName(asks), ("value", "asks"), F.col("ends_at"), "last").where("asks = 1")
    return met.select("at", F.greatest(F.col("at") + 1, F.coalesce(F.col("last") + 1, F.lit(0))).alias("to"))


def starts_of(pointers: DataFrame) -> DataFrame:
    """(at, batch): the starts reached from place 0 and their numbers."""
    spark = pointers.sparkSession
    save = lambda frame: written(frame, scratch_path(spark, "pointers"))
    step = save(pointers)
    found, reach = save(step.where("at = 0").select("at", F.lit(0).cast("long").alias("batch"))), 1
    while True:
        further = found.join(step, "at").select(F.col("to").alias("at"), (F.col("batch") + reach).alias("batch"))
        further = save(further.join(pointers.select("at"), "at", "left_semi"))
        if further.isEmpty():
            return found
        found, reach = save(found.unionByName(further)), 2 * reach
        step = save(step.alias("a").join(step.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"))


def batches_by_bytes(rows: DataFrame, order: tuple[str, ...], size: Column, budget: int) -> DataFrame:
    """Add ``batch``, from 0: the rows in ``order``, which must tell them apart, in batches of at most ``budget`` bytes.
    Null and negative sizes count as 0."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    sized = rows.withColumn("_size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)))
    summed = sums_before(sized, order, F.lit(1).cast("long"), "_place")
    placed = written(sums_before(summed, order, F.col("_size"), "_before"), scratch_path(rows.sparkSession, "placed"))
    slim = placed.select(F.col("_place").alias("place"), F.col("_before").alias("before"), F.col("_size").alias("size"))
    starts = starts_of(written(next_starts(slim, budget), scratch_path(rows.sparkSession, "next")))
    marked = placed.join(starts.withColumnRenamed("at", "_place"), "_place", "left").withColumnRenamed("batch", "_start")
    return running_max(marked, ("_place",), F.col("_start"), "batch").select(*kept, "batch")
