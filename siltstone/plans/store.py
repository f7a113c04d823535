"""Scan history: records and findings as Parquet tables, with upserts, statistics and retention.

A record's key is (group_id, artifact_id, version, repo_url); its ``id`` is a hash of the key, so it is
known without reading the table and findings can be written beside it.
"""

from __future__ import annotations

import os
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.scratch import scratch_path, written

#: The status of a record that marks a deletion; no reader sees it.
DELETED = "deleted"
KEY = ("group_id", "artifact_id", "version", "repo_url")
RECORDS = "id long, group_id string, artifact_id string, version string, repo_url string, status string, findings_count long, scan_time timestamp, duration_ms long, error string, rule_matches array<string>, file_hash string"
FINDINGS = "id long, record_id long, rule_id string, rule_name string, severity string, file_path string, line_number int, line_content string, match string"


def record_id() -> F.Column:
    return F.xxhash64(*KEY)


def latest(records: DataFrame, key: tuple[str, ...] = KEY, seq: str | None = None) -> DataFrame:
    """One row per key: the last by scan_time (and ``seq``)."""
    order = [F.col("scan_time").desc_nulls_last()] + ([F.col(seq).desc_nulls_last()] if seq else [])
    w = Window.partitionBy(*key).orderBy(*order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Old rows with new ones in place of those of the same key; of several new ones the last."""
    new = latest(new, key)
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True).select(*old.columns)


def replace_findings(old: DataFrame, new: DataFrame, updated: DataFrame) -> DataFrame:
    """Findings with all those of the updated records (column ``id``) exchanged for the new ones."""
    kept = old.join(updated.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def is_scanned(keys: DataFrame, records: DataFrame) -> DataFrame:
    """The keys that have a completed record."""
    return keys.join(records.where("status = 'complete'").select(*KEY), list(KEY), "left_semi")


def stats(records: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: records, complete and failed ones, findings by record counts, critical and high findings."""
    found = findings.agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    return records.agg(
        F.count("*").alias("total_scanned"), F.count_if(F.col("status") == "complete").alias("total_complete"), F.count_if(F.col("status") == "failed").alias("total_failed"),
        F.coalesce(F.sum("findings_count"), F.lit(0)).alias("total_findings"),
    ).withColumn("critical", found.select("critical").scalar()).withColumn("high", found.select("high").scalar())


def recent(records: DataFrame, n: int = 20) -> DataFrame:
    return records.orderBy(F.col("scan_time").desc_nulls_last(), "id").limit(n)


def delete_older(records: DataFrame, findings: DataFrame, now, days: int, cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records not older than ``days``, or without a time, and their findings; without ``cascade`` all findings stay, those
    of deleted records too."""
    limit = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    kept = records.where((F.col("scan_time") >= limit) | F.col("scan_time").isNull())
    left = findings.join(kept.select(F.col("id").alias("record_id")), "record_id", "left_semi").select(*findings.columns) if cascade else findings
    return kept, left


def orphans(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings without a record."""
    return findings.join(records.select(F.col("id").alias("record_id")), "record_id", "left_anti")


def export(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with their record's coordinates, by severity (as text), group and artifact."""
    keys = records.select(F.col("id").alias("record_id"), "group_id", "artifact_id", "version", "repo_url")
    rows = findings.join(keys, "record_id").withColumn("gav", F.concat_ws(":", "group_id", "artifact_id", "version"))
    return rows.orderBy("severity", "group_id", "artifact_id", "version", "file_path", "line_number", "rule_id")


class Store:
    """The two tables in a folder, kept as a log of batches.

    A save writes its rows as the next batch, so it costs what the batch holds and not what the
    history holds. Readers take the last batch of every record and the findings that came with it. A
    batch counts once its records are committed, which is after its findings are; saving the same
    rows again (a batch replayed after a failure) changes nothing that is read. ``compact`` merges
    the log into one base batch and is run every ``merge_every`` saves.

    Several writers may save at once, on a file system that creates a file for one of them only: that
    claims a number, and of two saves of a record the higher number counts. What lies below the lowest
    number under way is merged. A writer that hasn't committed after ``claim_hours`` raises; the claim
    of one that died holds merging up for twice as long. One process at a time merges. Merged batches
    stay on disk until the next merge, for those who still read them.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 16, claim_hours: float = 24) -> None:
        self.spark, self.path, self.merge_every, self.claim_hours = spark, path.rstrip("/"), merge_every, claim_hours
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _list(self, folder: str) -> list:
        root = self._p(f"{self.path}/{folder}")
        return list(self._fs.listStatus(root)) if self._fs.exists(root) else []

    def _committed(self) -> list[tuple[int, bool, str]]:
        """(number, whether it is a base, folder) of the committed batches in order."""
        names = [s.getPath().getName() for s in self._list("records")]
        return sorted((int(n.split("-")[1]), n.startswith("base"), n) for n in names if "-" in n and self._fs.exists(self._p(f"{self.path}/records/{n}/_SUCCESS")))

    def _batches(self) -> list[tuple[int, str]]:
        """(number, folder) of the committed batches that count: the last base and what follows it."""
        found = self._committed()
        start = max((i for i, (_, base, _) in enumerate(found) if base), default=0)
        return [(number, name) for number, _, name in found[start:]]

    def _create(self, claim) -> bool:
        """Whether this call made the file."""
        if self._fs.getScheme() == "file":  # Hadoop looks before it creates here, so two could succeed
            self._fs.mkdirs(claim.getParent())
            try:
                os.close(os.open(self._fs.makeQualified(claim).toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            return self._fs.createNewFile(claim)
        except Py4JJavaError:
            if self._fs.exists(claim):
                return False
            raise

    def _claim(self) -> int:
        """A batch number that no other writer has or had."""
        last = lambda: max((n for n, _, _ in self._committed()), default=0)
        number = max([last()] + [int(s.getPath().getName()) for s in self._list("claims")]) + 1
        while True:
            claim = self._p(f"{self.path}/claims/{number:08d}")
            if self._create(claim):
                if number > last():
                    return number
                self._fs.delete(claim, False)  # of a batch merged since the look
            number += 1

    def _under_way(self) -> set[int]:
        """Numbers claimed by writers that haven't committed and may still do so. A writer gives up after
        ``claim_hours``; twice that leaves time for a commit begun before."""
        oldest = (time.time() - 2 * 3600 * self.claim_hours) * 1000
        live = {int(s.getPath().getName()) for s in self._list("claims") if s.getModificationTime() >= oldest}
        return live - {n for n, _, _ in self._committed()}

    def _all(self, table: str, names: list[str]) -> DataFrame:
        schema = {"records": RECORDS, "findings": FINDINGS}[table] + ", batch long"
        paths = [f"{self.path}/{table}/{name}" for name in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _current(self, names: list[str]) -> DataFrame:
        w = Window.partitionBy(*KEY).orderBy(F.desc("batch"), F.desc_nulls_last("scan_time"))
        last = self._all("records", names).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return last.where(~F.col("status").eqNullSafe(F.lit(DELETED)))

    def read(self, table: str, names: list[str] | None = None) -> DataFrame:
        """``records`` or ``findings`` as they stand, or as the named batches give them."""
        names = [name for _, name in self._batches()] if names is None else names
        if table == "records":
            return self._current(names).drop("batch")
        last = self._current(names).select(F.col("id").alias("record_id"), "batch")
        return self._all("findings", names).join(last, ["record_id", "batch"], "left_semi").drop("batch").select(*[c.split()[0] for c in FINDINGS.split(", ")])

    def _write(self, name: str, number: int, records: DataFrame, findings: DataFrame, until: float = float("inf")) -> None:
        for table, rows in (("findings", findings), ("records", records)):
            if time.time() > until:
                raise TimeoutError(f"batch {number} took longer than its claim holds")
            columns = [c.split()[0] for c in {"records": RECORDS, "findings": FINDINGS}[table].split(", ")]
            rows.select(*columns, F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/{table}/{name}")

    def save(self, records: DataFrame, findings: DataFrame) -> None:
        """Upsert records and replace their findings."""
        until, number = time.time() + 3600 * self.claim_hours, self._claim()
        self._write(f"batch-{number:08d}", number, latest(records.withColumn("id", record_id())), findings, until)
        if len(self._batches()) > self.merge_every:
            self.compact()

    def expire(self, now, days: int) -> None:
        """Delete the records older than ``days`` and their findings: a batch marks them as deleted, and what it marks is
        gone from the folder with the second merge after it."""
        every, none = self.read("records"), self.read("findings").limit(0)
        kept, _ = delete_older(every, none, now, days)
        old = written(every.join(kept.select("id"), "id", "left_anti").select(*every.columns), scratch_path(self.spark, "expired"))
        if not old.isEmpty():
            self.save(old.withColumn("status", F.lit(DELETED)), none)

    def compact(self) -> None:
        """One base batch in place of the batches below every number under way; those that the last
        merge replaced are deleted."""
        batches = self._batches()  # before the claims, so that no claim below the last batch is missed
        limit = min(self._under_way(), default=None)
        batches = [(n, name) for n, name in batches if limit is None or n < limit]
        if len(batches) < 2:
            return
        number, names = batches[-1][0], [name for _, name in batches]
        replaced = [name for _, _, name in self._committed() if name not in names and int(name.split("-")[1]) <= batches[0][0]]
        self._write(f"base-{number:08d}", number, self.read("records", names), self.read("findings", names))
        for name in replaced:
            for table in ("records", "findings"):
                self._fs.delete(self._p(f"{self.path}/{table}/{name}"), True)
        for claim in self._list("claims"):
            if int(claim.getPath().getName()) < number:
                self._fs.delete(claim.getPath(), False)
