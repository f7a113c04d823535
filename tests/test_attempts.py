import datetime

from pyspark.sql import functions as F

from siltstone.plans import queries
from siltstone.scratch import scratch_path
from siltstone.streaming import attempts


def test_steps():
    after = attempts.after
    assert after(None, 0, True, 3) == ("complete", 0) and after(None, 0, False, 3) == ("failed", 1)
    assert after("failed", 2, False, 3) == ("given up", 3) and after("failed", 2, False, 0) == ("failed", 3)
    assert after("given up", 3, True, 3) == ("given up", 3) and after("complete", 1, False, 3) == ("complete", 1)


def test_replayed_batches_change_nothing(spark, sf_dir):
    """Every attempt comes twice, the second time in a later batch; a restarted stream finds nothing new."""
    rows = queries.attempts(spark, sf_dir)
    once, table, checkpoint = (scratch_path(spark, n) for n in ("once", "table", "checkpoint"))
    folder = scratch_path(spark, "attempts")
    rows.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    attempts.keep_states(stream, table, checkpoint).awaitTermination()
    first = sorted(map(str, attempts.current_states(spark, table).collect()))
    rows.coalesce(1).write.mode("append").parquet(folder)
    attempts.keep_states(stream, table, checkpoint).awaitTermination()
    assert sorted(map(str, attempts.current_states(spark, table).collect())) == first
    attempts.keep_states(attempts.replayed(rows, 3), once, scratch_path(spark, "cp")).awaitTermination()
    assert sorted(map(str, attempts.current_states(spark, once).collect())) == first
    assert {r.status for r in attempts.current_states(spark, table).select(F.col("status")).distinct().collect()} >= {"complete", "given up"}


def test_odd_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    schema = "gav_path string, attempt long, at timestamp, ok boolean, error string"
    rows = spark.createDataFrame([("a", 1, at, None, "e"), (None, 1, at, True, None), ("b", None, at, True, None), ("c", 1, None, True, None), ("a", 2, at, False, None)], schema)
    table = scratch_path(spark, "odd")
    attempts.keep_states(attempts.replayed(rows, 1), table, scratch_path(spark, "odd-cp"), most=0).awaitTermination()
    assert [tuple(r)[:4] for r in attempts.current_states(spark, table).collect()] == [("a", "failed", 2, None)]
