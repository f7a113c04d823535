"""Aggregates over findings and scan records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def by_grouping_sets(findings: DataFrame) -> DataFrame:
    """Counts by severity, by rule and in all, in one pass: (severity, rule_id, n)."""
    view = findings.select("severity", "rule_id")
    return view.groupingSets([["severity"], ["rule_id"], []], "severity", "rule_id").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def per_artifact(artifacts: DataFrame, findings: DataFrame, key: str = "gav") -> DataFrame:
    """Every artifact with its number of findings, 0 included."""
    counts = findings.groupBy(key).agg(F.count("*").alias("_n"))
    return artifacts.join(counts, key, "left").withColumn("findings_count", F.coalesce("_n", F.lit(0))).drop("_n")


def scan_totals(results: DataFrame) -> DataFrame:
    """One row: files discovered, scanned and failed, by the status of each."""
    done = F.col("status") == "complete"
    return results.agg(F.count("*").alias("total_discovered"), F.count_if(done).alias("total_scanned"), F.count_if(~done & F.col("status").isNotNull()).alias("total_failed"))


def summary(results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the totals with maps of counts by severity and by rule."""

    def counts(column: str) -> DataFrame:
        one = findings.groupBy(column).agg(F.count("*").alias("n"))
        return one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))))

    total = scan_totals(results).withColumn("total_findings", findings.agg(F.count("*")).scalar())
    return total.withColumn("by_severity", counts("severity").scalar()).withColumn("by_rule", counts("rule_id").scalar())


def rule_matches(findings: DataFrame, key: str = "gav") -> DataFrame:
    """The distinct rules that matched in each artifact, sorted."""
    return findings.groupBy(key).agg(F.sort_array(F.collect_set("rule_id")).alias("rule_matches"))


def summary_text(row) -> str:
    """A summary row as lines of text."""
    lines = ["Scan Summary:", f"  Discovered: {row.total_discovered}", f"  Scanned:    {row.total_scanned}", f"  Failed:     {row.total_failed}", f"  Findings:   {row.total_findings}"]
    if row.by_severity:
        lines.append("  By Severity:")
        lines += [f"    {s}: {row.by_severity[s]}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW") if s in row.by_severity]
    return "\n".join(lines) + "\n"
