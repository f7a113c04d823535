"""Scheduled scans: what is due and what follows a run."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators.ranges import sums_before

SCHEMA = (
    "id long, task_id string, repo_url string, group_filter string, config string, scan_interval_sec long, status string, state_file string, "
    "created_at timestamp, last_run_at timestamp, next_run_at timestamp, last_run_status string, scan_count long"
)
SECRETS = ("auth_header", "auth_token", "auth_user", "auth_pass")

KINDS = {"str": "string", "int": "long", "float": "double", "bool": "boolean"}


def packed(**options: Column) -> Column:
    """The config text of a task: these options and the defaults of all others, without secrets."""
    every = {k: F.lit(v) for k, v in Config().snapshot().items()}
    if wrong := sorted(set(options) - set(every)):
        raise ValueError(f"no options of a task: {', '.join(wrong)}")
    return F.to_json(F.struct(*[v.alias(k) for k, v in (every | options).items()]))


def unpacked(config: Column) -> Column:
    """A struct of the options that a config text gives; null where it doesn't, secrets never."""
    return F.from_json(config, ", ".join(f"{f.name} {KINDS[str(f.type)]}" for f in fields(Config) if f.name not in SECRETS))


def due(tasks: DataFrame, now) -> DataFrame:
    """Active tasks whose time has come or that never ran; these first."""
    when = F.lit(now).cast("timestamp")
    rows = tasks.where((F.col("status") == "active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= when)))
    return rows.orderBy(F.col("next_run_at").asc_nulls_first(), "task_id")


def listed(tasks: DataFrame, status: str | None = None) -> DataFrame:
    rows = tasks.where(F.col("status") == status) if status else tasks
    return rows.orderBy(F.col("created_at").desc(), "task_id")


def placed(rows: DataFrame, *order) -> DataFrame:
    """Add ``place``, from 1, in an order that tells the rows apart, by ranges and not in one task."""
    return sums_before(rows, order, F.lit(1).cast("long"), "_before").withColumn("place", F.col("_before") + 1).drop("_before")


def after_run(tasks: DataFrame, ran_at, run_status: str, preserve_paused: bool = False) -> DataFrame:
    """The tasks as they stand after a run: one-shot ones are completed, recurring ones active again
    (``preserve_paused``: paused ones stay so) and due one interval later."""
    ran, every = F.lit(ran_at).cast("timestamp"), F.col("scan_interval_sec")
    status = F.when(every > 0, "active").otherwise("completed")
    if preserve_paused:
        status = F.when(F.col("status") == "paused", "paused").otherwise(status)
    following = F.when(every > 0, F.timestamp_seconds(F.unix_seconds(ran) + every))
    return tasks.withColumns({"last_run_at": ran, "last_run_status": F.lit(run_status), "scan_count": F.col("scan_count") + 1, "next_run_at": following, "status": status}).select(*tasks.columns)


def with_status(tasks: DataFrame, task_id: str, status: str) -> DataFrame:
    """Pause or resume one task."""
    return tasks.withColumn("status", F.when(F.col("task_id") == task_id, status).otherwise(F.col("status")))


def without(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.where(~F.col("task_id").eqNullSafe(F.lit(task_id)))
