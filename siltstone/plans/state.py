"""State of a scan between runs: a JSON checkpoint, and the set operations on what it holds."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators.ranges import sums_before
from siltstone.scratch import scratch_path, written

VERSION = 1
STATUSES = ("running", "completed", "interrupted", "finished")
#: Options whose change makes results incomparable: compared if the state has them, and always.
IF_SET = ("repo_url", "group", "rules_level", "max_file_size")
ALWAYS = ("rules_file", "rules_merge", "include_sources", "skip_pom")


class StateError(ValueError):
    """A state that can't be used."""


def new_state(config: Config, scan_id: str = "") -> dict:
    return {
        "version": VERSION, "status": "running", "scan_id": scan_id, "config_snapshot": config.snapshot(), "completed_artifacts": [], "failed_artifacts": [],
        "in_flight_artifacts": [], "failed_dirs": [], "discovery_cursor": [], "total_discovered": 0, "total_scanned": 0, "total_failed": 0,
    }


def save(state: dict, path: str) -> None:
    """Replace the file at once: the new text is synced beside it, a valid old one is kept as .bak."""
    new, old = Path(f"{path}.tmp"), Path(path)
    with new.open("w", encoding="utf-8") as f:
        json.dump(state, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    if old.exists():
        try:
            json.loads(old.read_text(encoding="utf-8"))
            os.replace(old, f"{path}.bak")
        except ValueError:
            pass
    os.replace(new, old)


def load(path: str) -> dict:
    """The state, or its backup if the file is damaged. A missing file is missing even if a backup is
    there; newer versions are refused, version 0 is taken over."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    try:
        state = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError:
        try:
            state = json.loads(Path(f"{path}.bak").read_text(encoding="utf-8"))
        except (OSError, ValueError):
            raise StateError(f"{path} is damaged and has no usable backup") from None
    if state.get("version", 0) > VERSION:
        raise StateError(f"state version {state['version']} is newer than {VERSION}")
    return state | {"version": VERSION}


def check_drift(state: dict, config: Config) -> None:
    """Refuse to go on with other options than the state's."""
    was, now = state.get("config_snapshot", {}), config.snapshot()
    empty = Config()
    before = {key: was[key] for key in IF_SET if was.get(key)} | {key: was.get(key, getattr(empty, key)) for key in ALWAYS}
    changed = [f"{key} was {old!r}, is now {now[key]!r}" for key, old in before.items() if old != now[key]]
    if changed:
        raise StateError("the interrupted scan had other options: " + "; ".join(changed))


def estimate(state: dict) -> dict:
    """Progress of a state for a message on resuming."""
    return {"status": state["status"], "discovered": state["total_discovered"], "scanned": state["total_scanned"], "failed": state["total_failed"], "in_flight": len(state["in_flight_artifacts"])}


def not_in(rows: DataFrame, done: DataFrame, key: str = "gav_path") -> DataFrame:
    """Rows whose key is not among those of ``done`` (completed or in-flight artifacts)."""
    return rows.join(done.select(key).distinct(), key, "left_anti").select(*rows.columns)


def pending(in_flight: DataFrame, failed_dirs: DataFrame, key: str = "gav_path") -> DataFrame:
    """What a resumed run looks at first."""
    return in_flight.select(key).unionByName(failed_dirs.select(key)).distinct()


def revisit(rows: DataFrame, pending_dirs: DataFrame, key: str = "gav_path") -> DataFrame:
    """Rows in one of the pending directories or below it.

    Every directory above a key is a candidate, so it is an equi-join, not a comparison of all pairs. Only
    the distinct keys are exploded and shuffled for it; the rows meet the keys found once.
    """
    parts = F.split(key, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = rows.select(key).distinct().select(key, F.explode(F.array_distinct(ups)).alias("_dir"))
    hit = above.join(pending_dirs.select(F.col(key).alias("_dir")).distinct(), "_dir", "left_semi").select(key)
    return rows.join(hit, key, "left_semi").select(*rows.columns)


def files_left(files: DataFrame, cursors: DataFrame, path: str = "path") -> DataFrame:
    """(run, files_left, next_path) for each interrupted walk of (run, cursor): how many files lie behind its cursor, the parts
    of the last path it saw, in the order of the walk, and the first of them.

    Files and cursors are laid out together in walk order; what is left follows from the number of files before each
    cursor, a running sum over ranges, so files and cursors are never compared in pairs. A null cursor has all files left.
    """
    rows = files.select(F.split(path, "/").alias("parts"), F.lit(0).alias("asks"), F.col(path).alias("path"), F.lit(None).cast("string").alias("run"))
    asks = cursors.select(F.coalesce("cursor", F.array().cast("array<string>")).alias("parts"), F.lit(1).alias("asks"), F.lit(None).cast("string").alias("path"), F.col("run").cast("string").alias("run"))
    every = rows.unionByName(asks)
    seen = written(sums_before(every, ("parts", "asks"), 1 - F.col("asks"), "seen"), scratch_path(files.sparkSession, "walks"))
    total = seen.where("asks = 0").agg(F.count("*").alias("n")).select("n").scalar()
    following = seen.where("asks = 0").select(F.col("seen").alias("at"), F.col("path").alias("next_path")).groupBy("at").agg(F.min("next_path").alias("next_path"))
    return seen.where("asks = 1").join(following, F.col("seen") == F.col("at"), "left").select("run", (total - F.col("seen")).alias("files_left"), "next_path")


def retryable(failed: DataFrame, most: int = 3) -> DataFrame:
    """Failed artifacts that may be tried again; 0 means without end."""
    return failed.where(F.lit(most <= 0) | (F.col("retries") < most))


ATTEMPTS = "repo_url string, gav_path string, at timestamp, ok boolean, error string"


def add_attempts(results: DataFrame, repo_url: str, at, path: str) -> None:
    """Append what became of each artifact of a batch to the table of attempts."""
    made = results.groupBy("gav_path").agg(F.max(F.col("status") == "failed").alias("bad"), F.first("error", ignorenulls=True).alias("error"))
    made.select(F.lit(repo_url).alias("repo_url"), "gav_path", F.lit(at).cast("timestamp").alias("at"), (~F.col("bad")).alias("ok"), "error").write.mode("append").parquet(path)


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """The table of attempts; empty before the first."""
    return spark.read.schema(ATTEMPTS).parquet(path) if os.path.isdir(path) else spark.createDataFrame([], ATTEMPTS)


def exhausted(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Artifacts that never succeeded and failed too often to be tried again, with their retries."""
    tried = attempts.groupBy("gav_path").agg(F.count_if(~F.col("ok")).alias("retries"), F.max("ok").alias("ok")).where("not ok").drop("ok")
    return not_in(tried, retryable(tried, most))


def add_new(existing: DataFrame, more: DataFrame, key: str = "gav_path") -> DataFrame:
    """``existing`` and those rows of ``more`` whose key is new."""
    return existing.unionByName(not_in(more, existing, key))


def mark_failed(failed: DataFrame, now: DataFrame, key: str = "gav_path") -> DataFrame:
    """Failed artifacts after a run: counts go up by one, the last error stays."""
    one = now.select(key, "error", "failed_at", F.lit(1).alias("retries"))
    both = failed.select(key, "error", "failed_at", "retries").unionByName(one)
    return both.groupBy(key).agg(F.max_by("error", "failed_at").alias("error"), F.max("failed_at").alias("failed_at"), F.sum("retries").cast("int").alias("retries"))


def evict(files: DataFrame, limit_mb: int = 500) -> DataFrame:
    """Files to delete, oldest first, until the rest fits (sizes in whole MB): (path, mtime, length)."""
    total = usage(files).select("mb").scalar()
    gone = sums_before(files, ("mtime", "path"), F.expr("length div 1048576"), "_before")
    return gone.where(total - F.col("_before") > limit_mb).drop("_before")


def usage(files: DataFrame) -> DataFrame:
    """One row: the whole MB and the number of the files."""
    return files.agg(F.coalesce(F.expr("sum(length) div 1048576"), F.lit(0)).alias("mb"), F.count("*").alias("files"))
