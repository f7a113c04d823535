"""The scan: files to entries to lines to findings, with per-file results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions.scalars import parse_size
from siltstone.operators import rules as rule_sets
from siltstone.operators import split
from siltstone.operators.archive import Limits, expand
from siltstone.operators.detect import any_rule_applies, with_gates
from siltstone.operators.lines import MAX_LINE_BYTES, longest_line, split_by_line_limit, split_lines
from siltstone.operators.listing import artifacts, first_per_key, under_group
from siltstone.operators.rule_table import find
from siltstone.operators.rules import Rule
from siltstone.operators.summary import rule_matches, summary
from siltstone.scratch import scratch_path, written
from siltstone.sources.files import oversize_files, read_files, relative

from . import state, store


#: What findings and results carry along of an artifact.
CARRIED = ("group_id", "artifact_id", "version", "gav", "gav_path", "file_name")


@dataclass
class ScanResult:
    """Findings, one row per artifact file, and the one-row summary; ``totals`` were observed by the write of the rows."""

    findings: DataFrame
    results: DataFrame
    totals: dict | None = None

    @property
    def summary(self) -> DataFrame:
        return summary(self.results, self.findings)


def scan_text(files: DataFrame, rules: Sequence[Rule], engines: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, failed files) of (file_path, text, ...).

    One narrow stage: files no rule is for are dropped before their text is split, gates are computed
    once per file and carried to its lines.
    """
    ok, failed = split_by_line_limit(any_rule_applies(files, rules))
    lines = split_lines(with_gates(ok, rules))
    return find(lines, rules, engines), failed


def entries_of(files: DataFrame, limits: Limits, carried: Sequence[str], large: int) -> DataFrame:
    """Entries of all files. Zip containers of more than ``large`` bytes are split, if ``files`` come with their length,
    as those of a folder do; only lengths are read to see whether there are any."""
    if "length" not in files.columns:
        return expand(files, limits, carried, markers=True)
    splits = split.is_large(F.col("path"), F.col("length"), large) & (F.col("error").isNull() if "error" in files.columns else F.lit(True))
    if files.where(splits).select("path").isEmpty():
        return expand(files, limits, carried, markers=True)
    whole = expand(files.where(~splits), limits, carried, markers=True)
    return whole.unionByName(split.expand_split(files.where(splits).select("path", *carried), limits, carried, markers=True))


def scan_rows(files: DataFrame, rules: Sequence[Rule], limits: Limits = Limits(), engines: dict | None = None, carried: Sequence[str] = (), large: int = split.LARGE) -> DataFrame:
    """The rows of one scan in one narrow pass: a row for each finding, and for each container one
    without a finding that tells in ``_error`` why the container failed, if it did."""
    entries = with_gates(entries_of(files, limits, carried, large), rules)
    marker = F.col("text").isNull()
    entries = entries.where(marker | F.exists("_gates", lambda g: g))
    # A container that gave no entry failed if it has an error; a plain file fails by an endless line,
    # inside an archive such an entry is only left out.
    long = F.coalesce(longest_line(F.col("text")) >= MAX_LINE_BYTES, F.lit(False))
    plain = ~F.lower("container_path").rlike(r"\.(jar|war|ear|zip|tar|gz|tgz)\z")
    entries = entries.withColumn("_error", F.when(marker & (F.col("entry_ord") == 0), F.col("error")).when(long & plain, F.lit("token too long")))
    entries = entries.withColumn("text", F.when(~long, F.col("text"))).drop("error")
    return find(split_lines(entries, keep_null=True), rules, engines, keep_null=True)


def result_of(rows: DataFrame, carried: Sequence[str] = ()) -> ScanResult:
    """Findings and results from written rows of ``scan_rows``."""
    findings = rows.where("rule_id is not null").drop("_error")
    counts = rows.groupBy("container_path", *carried).agg(F.count("rule_id").alias("findings_count"), F.min("_error").alias("error"))
    status = F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status")
    return ScanResult(findings, counts.select("container_path", *carried, status, "error", "findings_count"))


def scan_files(files: DataFrame, rules: Sequence[Rule], limits: Limits = Limits(), engines: dict | None = None, carried: Sequence[str] = (), into: str | None = None, large: int = split.LARGE) -> ScanResult:
    """Scan (path, content, ...): containers are expanded, plain files scanned as they are.

    Files are read and expanded once, here: the rows of the scan go to a table (``into``, else the scratch
    folder), and findings, results and summary come from it. Findings carry container_path and the
    ``carried`` columns; results have status, error and findings_count of every file. A file that comes
    with an ``error`` (a failed download) is a failed result.
    """
    seen = Observation()
    rows = written(scan_rows(files, rules, limits, engines, carried, large).observe(seen, *totals_of_rows()), into or scratch_path(files.sparkSession, "scan"))
    return replace(result_of(rows, carried), totals=seen.get)


def totals_of_rows() -> list[Column]:
    """The totals of a scan from its rows: each file has one row without a path, and one with an error if it failed."""
    file, bad, found = F.col("rule_id").isNull() & F.col("file_path").isNull(), F.col("rule_id").isNull() & F.col("_error").isNotNull(), F.col("rule_id").isNotNull()
    return [F.count_if(file).alias("total_discovered"), (F.count_if(file) - F.count_if(bad)).alias("total_scanned"), F.count_if(bad).alias("total_failed"), F.count_if(found).alias("total_findings")]


def discover(spark: SparkSession, config: Config) -> DataFrame:
    """Artifacts of a mirrored repository folder, with their content (read only when it is used);
    those over the size limit have an error instead."""
    most = parse_size(config.max_file_size)
    files = read_files(spark, config.repo_url, most).withColumn("error", F.lit(None).cast("string"))
    if most:
        files = files.unionByName(oversize_files(spark, config.repo_url, most))
    files = relative(files, config.repo_url, "rel_path")
    rows = artifacts(under_group(files, config.group, "rel_path"), "rel_path", config.include_sources, config.skip_pom, config.exclude or None)
    return first_per_key(rows, "gav_path", "file_name") if config.one_file_per_gav else rows


def scan_repository(spark: SparkSession, config: Config, completed: DataFrame | None = None, engines: dict | None = None) -> ScanResult:
    """Scan what is new in a mirrored repository: artifacts whose path is among ``completed`` are left out."""
    config.validate()
    rules = rule_sets.load(config.rules_file or None, config.rules_level, config.rules_merge)
    found = discover(spark, config)
    if completed is not None:
        found = state.not_in(found, completed)
    if config.scan_concurrency > 0:
        found = found.repartition(config.scan_concurrency)
    return scan_files(found, rules, engines=engines, carried=CARRIED)


def history_rows(result: ScanResult, repo_url: str, now) -> tuple[DataFrame, DataFrame]:
    """(records, findings) for the store: one record for each set of coordinates."""
    keys = ["group_id", "artifact_id", "version"]
    records = result.results.groupBy(*keys).agg(
        F.when(F.max(F.col("status") == "failed"), "failed").otherwise("complete").alias("status"),
        F.sum("findings_count").alias("findings_count"), F.first("error", ignorenulls=True).alias("error"), F.first("gav").alias("gav"),
    )
    records = records.join(rule_matches(result.findings), "gav", "left").drop("gav").withColumns({"repo_url": F.lit(repo_url), "scan_time": F.lit(now).cast("timestamp"), "duration_ms": F.lit(None).cast("long"), "file_hash": F.lit(None).cast("string")})
    rows = result.findings.withColumn("repo_url", F.lit(repo_url))
    rows = rows.withColumn("record_id", store.record_id()).withColumn("id", F.xxhash64("record_id", "container_path", "file_path", "line_number", "rule_id", "pattern_ord", "match_ord"))
    return records, rows.select("id", "record_id", "rule_id", "rule_name", "severity", "file_path", "line_number", "line_content", "match")
