"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.scratch import scratch_path, written


def sums_before(rows: DataFrame, order: tuple[str, ...], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each one in ``order``, 0 for the first.

    The rows are dealt by ranges of the order and written, so that their ranges are fixed; the sums of
    the ranges, one row each, are summed first, then the rows within every range. Rows that are equal
    in ``order`` share a range.
    """
    dealt = rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, scratch_path(rows.sparkSession, "ranges"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_value").over(before.partitionBy("_range").orderBy(*order)), F.lit(0))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return dealt.withColumn("_inner", inner).join(F.broadcast(ranges), "_range").select(*kept, (F.col("_base") + F.col("_inner")).alias(out))


def running_max(rows: DataFrame, order: tuple[str, ...], value: Column, out: str) -> DataFrame:
    """Add the largest ``value`` of all rows up to each one in ``order``, itself and its equals included; nulls don't count.

    Done by written ranges, as ``sums_before``.
    """
    dealt = rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, scratch_path(rows.sparkSession, "ranges"))
    ranges = dealt.groupBy("_range").agg(F.max("_value").alias("_max"))
    ranges = ranges.select("_range", F.max("_max").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    inner = F.max("_value").over(Window.partitionBy("_range").orderBy(*order))
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return dealt.withColumn("_inner", inner).join(F.broadcast(ranges), "_range").select(*kept, F.greatest("_base", "_inner").alias(out))
