"""Status and retries of each artifact as keyed state of a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siltstone.scratch import scratch_path

STATE = "status string, retries int, error string, at long, attempt long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def after(status: str | None, retries: int, ok: bool, most: int) -> tuple[str, int]:
    """(status, retries) after one more attempt: complete and given up are final; ``most`` failures (0: no number) give up."""
    if status in ("complete", "given up"):
        return status, retries
    if ok:
        return "complete", retries
    return ("given up" if 0 < most <= retries + 1 else "failed"), retries + 1


class Attempts(StatefulProcessor):
    """Folds the attempts of an artifact, in the order of (at, attempt), into its state. An attempt that isn't later
    than the last one counted changes nothing, so a batch that comes twice counts once."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle) -> None:
        self.state = handle.getValueState("attempts", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, retries, error, at, attempt = self.state.get() or (None, 0, None, None, None)
        was = (at, attempt)
        for r in sorted(rows, key=lambda r: (r.at, r.attempt)):
            if at is not None and (r.at, r.attempt) <= (at, attempt):
                continue
            before = status
            status, retries = after(status, retries, r.ok, self.most)
            if before not in ("complete", "given up"):
                error = None if r.ok else r.error
            at, attempt = r.at, r.attempt
        if (at, attempt) != was:
            self.state.update((status, retries, error, at, attempt))
            yield Row(gav_path=key[0], status=status, retries=retries, error=error, at=at)

    def close(self) -> None:
        pass


def attempt_states(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Update stream of (gav_path, status, retries, error, at) for a stream of (gav_path, attempt, at, ok, error), which holds an
    artifact's attempts in the order of time from batch to batch. Rows without a path, time or number are left out."""
    rows = attempts.where("gav_path is not null and at is not null and attempt is not null").select("gav_path", "attempt", F.unix_micros("at").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), "error")
    states = rows.groupBy("gav_path").transformWithState(Attempts(most), "gav_path string, status string, retries int, error string, at long", "Update", "None")
    return states.withColumn("at", F.timestamp_micros("at"))


def keep_states(attempts: DataFrame, table: str, checkpoint: str, most: int = 3) -> StreamingQuery:
    """Keep the states of a stream in a folder of one table for each batch, and stop when all is read. A batch that runs
    again replaces its own table."""
    spark = attempts.sparkSession

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number:012d}")

    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that holds such state
    try:
        return attempt_states(attempts, most).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, was)


def current_states(spark, table: str) -> DataFrame:
    """The last state of each artifact from what ``keep_states`` keeps."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("gav_path").agg(F.max_by(F.struct("status", "retries", "error", "at"), F.struct("at", "batch")).alias("s"))
    return last.select("gav_path", "s.*")


def replayed(rows: DataFrame, parts: int, order: str = "at") -> DataFrame:
    """A table as a file stream in ``parts`` batches of rising ``order``, for queries and tests."""
    spark, folder = rows.sparkSession, scratch_path(rows.sparkSession, "replayed")
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = sum(((F.col(order).cast("double") > c).cast("int") for c in cuts), F.lit(0))
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
