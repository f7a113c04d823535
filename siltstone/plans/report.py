"""Reports: one JSON document, rows of JSON, console text."""

from __future__ import annotations

import json
import os
import shutil
import sys
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.summary import summary_text
from siltstone.scratch import scratch_path
from siltstone.sources.json_array import local, write_array

DETAIL = ("artifact", "file_path", "rule_id", "rule_name", "severity", "line_number", "line_content", "match", "description")
COLORS = {"CRITICAL": "1;31", "HIGH": "31", "MEDIUM": "33", "LOW": "36"}


def details(findings: DataFrame) -> DataFrame:
    """Findings as a report shows them: with the artifact, without engine and entropy."""
    return findings.withColumn("artifact", F.col("gav")).select(*DETAIL)


def write_rows(findings: DataFrame, path: str) -> None:
    """JSON lines, in as many files as there are tasks: the form for large results."""
    details(findings).write.mode("overwrite").json(path)


def document(scan_id: str, repo_url: str, concurrency: int, group: str, summary, rows: Iterable, start: datetime, end: datetime) -> str:
    """A whole report as indented JSON. Rows are read one after another."""
    stamp = lambda t: t.astimezone().isoformat(timespec="seconds")
    config = {"concurrency": concurrency} | ({"group_filter": group} if group else {})
    totals = {k: summary[k] for k in ("total_discovered", "total_scanned", "total_failed", "total_findings")}
    totals |= {k: summary[k] or {} for k in ("by_severity", "by_rule")}
    found = [{k: r[k] for k in DETAIL} for r in rows]
    return json.dumps({"scan_id": scan_id, "start_time": stamp(start), "end_time": stamp(end), "repo_url": repo_url, "config": config, "summary": totals, "findings": found}, indent=2, ensure_ascii=False)


def write_document(text: str, path: str = "-") -> None:
    if path in ("", "-"):
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def shorten(text: str, most: int = 80) -> str:
    s = text.strip()
    raw = s.encode()
    return s if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "..."


def print_finding(r, out=None) -> None:
    out = out or sys.stdout
    code = COLORS.get(r["severity"])
    shown = f"\033[{code}m{r['severity']}\033[0m" if code else r["severity"]
    out.write(f"\n  {shown} [{r['rule_id']}] {r['rule_name']}\n    Artifact: {r['artifact']}\n    File:     {r['file_path']}:{r['line_number']}\n    Match:    {shorten(r['match'])}\n")


def print_report(findings: DataFrame, summary_row, out=None) -> None:
    """Findings as they come, one partition at a time, and the summary."""
    out = out or sys.stdout
    for r in details(findings).toLocalIterator():
        print_finding(r, out)
    line = "=" * 60
    out.write(f"\n{line}\n{summary_text(summary_row)}\n{line}\n")


EXPORTED = ("gav", "repo_url", "rule_id", "rule_name", "severity", "file_path", "line_number", "line_content", "match")


def write_export(rows: DataFrame, path: str = "-") -> None:
    """All findings as one JSON array, null if there are none, in the order of ``rows``. Tasks write the rows and the driver
    joins their files; the file is there once it is whole."""
    whole = path if path not in ("", "-") else local(scratch_path(rows.sparkSession, "export"))
    if path in ("", "-"):
        os.makedirs(os.path.dirname(whole), exist_ok=True)
    write_array(rows.select(*EXPORTED), whole)
    if path in ("", "-"):
        with open(whole, encoding="utf-8") as f:
            shutil.copyfileobj(f, sys.stdout)
        os.remove(whole)


def export_json(rows: DataFrame) -> DataFrame:
    """One row with all findings as a JSON array, null if there are none: built in one task, so for
    results that fit there; ``write_export`` and ``write_rows`` are for others."""
    item = F.struct(*EXPORTED)
    order = F.struct("severity", "group_id", "artifact_id", "version", "file_path", "line_number", "rule_id")
    packed = rows.agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("v")))).alias("all"))
    return packed.select(F.when(F.size("all") > 0, F.to_json(F.transform("all", lambda x: x["v"]))).alias("json"))
