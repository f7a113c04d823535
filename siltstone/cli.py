"""Command line: scan, task, history, rules, version.

    python -m siltstone scan --repo /mirror --rules-level all --home /data/siltstone
    python -m siltstone task add|list|run|pause|resume|delete ...
    python -m siltstone history --home /data/siltstone
"""

from __future__ import annotations

import argparse
import datetime
import json
import math
import os
import signal
import sys
import uuid
from collections.abc import Iterator
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.scalars import gav_path, interval_text, parse_size
from siltstone.operators import rules, summary
from siltstone.operators.batching import batches_by_bytes
from siltstone.operators.listing import artifacts, first_per_key
from siltstone.plans import report, scan, state, store, tasks
from siltstone.scratch import scratch_path, written
from siltstone.sources import http
from siltstone.sources.files import with_content
from siltstone.streaming.incremental import scan_stream

VERSION = "0.1.0"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0)


def load_artifacts(spark: SparkSession, config: Config, done: DataFrame | None, todo: DataFrame | None) -> tuple[DataFrame, list[str], http.Options | None]:
    """(artifacts, directories that failed, how to fetch), from a folder, with content, or over HTTP, with
    url; what is ``done`` is left out, unless it lies in a ``todo`` directory."""
    failed: list[str] = []
    options = None
    if not config.repo_url.startswith("http"):
        found = scan.discover(spark, config)
    else:
        options = http.Options(config.timeout, config.retries, config.qps, http_limit(config), header=config.auth_header, token=config.auth_token, user=config.auth_user, password=config.auth_pass)
        files, bad = http.walk(spark, config.repo_url, options, config.browser_concurrency or max(config.concurrency, 32), config.group, config.include_sources, config.skip_pom)
        failed = [r.path for r in bad.collect()]
        found = artifacts(files, "path", config.include_sources, config.skip_pom, config.exclude or None)
        if config.one_file_per_gav:
            found = first_per_key(found)
    if done is not None:
        left = done if todo is None else state.not_in(done, state.revisit(done, todo))
        found = state.not_in(found, left)
    return found, failed, options


#: A scan has no more batches than this; their files grow with the repository instead.
MOST_BATCHES = 1000


def dealt(found: DataFrame, batch: str = "batch") -> Iterator[DataFrame]:
    """The rows of each batch in turn, from a table that is written once, a folder for each: a batch reads its own rows only."""
    path = scratch_path(found.sparkSession, "batches")
    found.repartition(batch).write.partitionBy(batch).parquet(path)
    kept = [c for c in found.columns if c != batch]
    for (number,) in sorted(found.sparkSession.read.parquet(path).select(batch).distinct().collect()):
        yield found.sparkSession.read.schema(found.select(*kept).schema).parquet(f"{path}/{batch}={number}")


def batches(found: DataFrame, config: Config, options: http.Options | None) -> Iterator[DataFrame]:
    """The artifacts in batches, all files of one set of coordinates in the same: over HTTP of about ``checkpoint_interval``
    files, in a folder of at most ``disk_budget_mb`` of files (without a budget, or if all fit, in one; ``--stream`` takes a
    folder by its own batches)."""
    if options is None:
        budget = config.disk_budget_mb << 20
        total = found.agg(F.sum("length")).first()[0] or 0
        if not budget or total <= budget:
            yield found
            return
        listed = written(found.drop("content"), scratch_path(found.sparkSession, "listed"))
        sets = batches_by_bytes(listed.groupBy("gav_path").agg(F.sum(F.when(F.col("error").isNull(), F.col("length"))).alias("size")), ("gav_path",), F.col("size"), budget)
        for some in dealt(listed.join(sets.select("gav_path", "batch"), "gav_path")):
            yield with_content(some)
        return
    n = found.count()
    interval = max(config.checkpoint_interval, math.ceil(n / MOST_BATCHES)) if config.checkpoint_interval else max(1, n)
    batch = F.pmod(F.xxhash64("gav_path"), F.lit(max(1, math.ceil(n / interval)))).alias("batch")
    for some in dealt(found.select("*", batch)) if n else ():
        yield http.fetch_all(some, options, config.download_concurrency or max(config.concurrency, 64))


def http_limit(config: Config) -> int:
    return parse_size(config.max_file_size)


def run_scan(spark: SparkSession, config: Config, home: str) -> int:
    """Scan in batches, keep each batch's results in the history as it ends, and report.

    A run that is killed loses the batch under way only. Failed downloads, oversize files and broken
    containers are records with status failed, which ``retry_failed`` takes up again. What is done is known from the history table, not from the state file, so resuming is an
    anti-join however much has been scanned; the file holds options, counters and failed directories.
    """
    config.validate()
    path, done, todo = os.path.join(home, config.state_file), None, None
    os.makedirs(home, exist_ok=True)
    history, tried = store.Store(spark, os.path.join(home, "history")), os.path.join(home, "attempts")
    current = state.new_state(config, uuid.uuid4().hex[:12])
    if config.resume and os.path.exists(path):
        current = state.load(path)
        state.check_drift(current, config)
        print("Resuming:", json.dumps(state.estimate(current)))
        known = history.read("records").where(F.col("repo_url") == config.repo_url)
        if config.retry_failed:
            known = known.where("status = 'complete'")
        done = known.select(gav_path(F.col("group_id"), F.col("artifact_id"), F.col("version")).alias("gav_path"))
        if config.retry_failed:  # what has failed too often isn't tried again
            done = done.unionByName(state.exhausted(state.attempts(spark, tried).where(F.col("repo_url") == config.repo_url)).select("gav_path"))
        if current["failed_dirs"]:
            todo = spark.createDataFrame([(p,) for p in current["failed_dirs"]], "gav_path string")
    state.save(current | {"status": "running"}, path)

    def stop(*_):  # finished batches are in the history already
        state.save(current | {"status": "interrupted"}, path)
        sys.exit(130)

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, stop)
    start = now()
    loaded = rules.load(config.rules_file or None, config.rules_level, config.rules_merge)
    found, failed_dirs, options = load_artifacts(spark, config, done, todo)
    if options is not None:
        found = written(found, scratch_path(spark, "artifacts"))
    before = {k: current[k] for k in ("total_discovered", "total_scanned", "total_failed")}
    current |= {"failed_dirs": failed_dirs}
    rows = scratch_path(spark, "scan-rows")
    parts = []
    for i, files in enumerate(batches(found, config, options)):
        part = scan.scan_files(files, loaded, carried=scan.CARRIED, into=f"{rows}/{i:08d}")
        history.save(*scan.history_rows(part, config.repo_url, now()))
        state.add_attempts(part.results, config.repo_url, now(), tried)
        parts.append(f"{rows}/{i:08d}")
        current |= {k: current[k] + part.totals[k] for k in before}
        state.save(current | {"status": "running"}, path)
    result = scan.result_of(spark.read.parquet(*parts) if parts else scan.scan_rows(found.limit(0).withColumn("content", F.lit(b"")), loaded, carried=scan.CARRIED), scan.CARRIED)
    total = result.summary.first()
    if config.output == "json":
        rows = report.details(result.findings).toLocalIterator()
        report.write_document(report.document(current["scan_id"], config.repo_url, config.concurrency, config.group, total, rows, start, now()), config.output_file or "-")
    else:
        report.print_report(result.findings, total)
    state.save(current | {"status": "completed"}, path)
    return 0


def run_stream(spark: SparkSession, config: Config, home: str) -> int:
    """Scan what is new in a mirrored folder in micro-batches of ``checkpoint_interval`` files; a run
    that was killed goes on after its last whole batch."""

    def progress(number: int, result: scan.ScanResult) -> None:
        total = result.summary.first()
        print(f"batch {number}: {total.total_scanned} scanned, {total.total_failed} failed, {total.total_findings} findings")

    history = store.Store(spark, os.path.join(home, "history"))
    scan_stream(spark, config, history, os.path.join(home, "stream"), progress).awaitTermination()
    return 0


class TaskTable:
    """The task table: small, one JSON row per task."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.path = spark, os.path.join(home, "tasks.json")

    def read(self) -> DataFrame:
        rows = json.load(open(self.path)) if os.path.exists(self.path) else []
        parse = lambda v: datetime.datetime.fromisoformat(v) if v else None
        return self.spark.createDataFrame([{**r, **{k: parse(r[k]) for k in ("created_at", "last_run_at", "next_run_at")}} for r in rows], tasks.SCHEMA)

    def write(self, rows: DataFrame) -> None:
        data = [r.asDict() for r in rows.collect()]
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path + ".tmp", "w") as f:
            json.dump(data, f, default=lambda v: v.isoformat(), indent=1)
        os.replace(self.path + ".tmp", self.path)


def run_task(args, config: Config, spark: SparkSession) -> int:
    table = TaskTable(spark, args.home)
    rows = table.read()
    if args.action == "add":
        if rows.where(rows.task_id == args.id).count():
            raise SystemExit(f"task {args.id} exists")
        row = [(rows.count() + 1, args.id, config.repo_url, config.group, json.dumps(config.snapshot()), config.interval, "active", f"{args.id}.json", now(), None, None, "", 0)]
        table.write(rows.unionByName(spark.createDataFrame(row, tasks.SCHEMA)))
    elif args.action == "list":
        tasks.listed(rows, args.status).select("task_id", "repo_url", "status", interval_text(F.col("scan_interval_sec")).alias("interval"), "next_run_at", "scan_count").show(1000, False)
    elif args.action in ("pause", "resume"):
        table.write(tasks.with_status(rows, args.id, {"pause": "paused", "resume": "active"}[args.action]))
    elif args.action == "delete":
        table.write(tasks.without(rows, args.id))
    elif args.action == "run":
        for t in tasks.due(rows, now()).collect():
            own = Config.from_snapshot(json.loads(t.config), resume=True, state_file=t.state_file)
            run_scan(spark, own, args.home)
            mine = table.read()
            ran = tasks.after_run(mine.where(mine.task_id == t.task_id), now(), "completed", preserve_paused=True)
            table.write(tasks.without(mine, t.task_id).unionByName(ran))
    return 0


def show_history(args, spark: SparkSession) -> int:
    s = store.Store(spark, os.path.join(args.home, "history"))
    if args.expire_days > 0:
        s.expire(now(), args.expire_days)
    recs, found = s.read("records"), s.read("findings")
    store.stats(recs, found).show()
    summary.by_rule(found).show(1000, False)
    summary.by_severity(found).show()
    store.recent(recs, args.limit).drop("id", "file_hash").show(args.limit, False)
    if args.export:
        report.write_export(store.export(found, recs), args.export)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone")
    commands = p.add_subparsers(dest="command", required=True)
    base = argparse.ArgumentParser(add_help=False)
    base.add_argument("--home", default=os.path.expanduser("~/.siltstone"))
    options = argparse.ArgumentParser(add_help=False)
    for f in fields(Config):
        flag = "--" + {"repo_url": "repo"}.get(f.name, f.name.replace("_", "-"))
        if isinstance(f.default, bool):
            options.add_argument(flag, dest=f.name, action="store_true")
        else:
            options.add_argument(flag, dest=f.name, type=type(f.default), default=f.default)
    s = commands.add_parser("scan", parents=[base, options])
    s.add_argument("--stream", action="store_true", help="scan new files of a folder in micro-batches")
    t = commands.add_parser("task", parents=[base, options])
    t.add_argument("action", choices=["add", "list", "run", "pause", "resume", "delete"])
    t.add_argument("id", nargs="?", default="")
    t.add_argument("--status", default=None)
    h = commands.add_parser("history", parents=[base])
    h.add_argument("--limit", type=int, default=20)
    h.add_argument("--export", default="")
    h.add_argument("--expire-days", type=int, default=0, help="first delete records older than this, with their findings")
    r = commands.add_parser("rules", parents=[base])
    r.add_argument("--rules-level", default="all")
    r.add_argument("--rules-file", default="")
    r.add_argument("--rules-merge", action="store_true")
    commands.add_parser("version")
    args = p.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "rules":
        for x in rules.load(args.rules_file or None, args.rules_level, args.rules_merge):
            print(f"{x.id:24} {x.severity:9} {x.engine or 'regex':8} {x.name}")
        return 0
    spark = session()
    if args.command == "history":
        return show_history(args, spark)
    config = Config(**{f.name: getattr(args, f.name) for f in fields(Config)})
    if args.command == "task":
        return run_task(args, config, spark)
    return (run_stream if args.stream else run_scan)(spark, config, args.home)
