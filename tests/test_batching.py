import random

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.config import Config
from siltstone.operators import batching


def walk(sizes, budget):
    """Batch numbers of a sequential walk."""
    out, batch, used = [], 0, 0
    for i, s in enumerate(sizes):
        s = max(s or 0, 0)
        if i and used + s > budget:
            batch, used = batch + 1, 0
        used += s
        out.append(batch)
    return out


@pytest.mark.parametrize("budget", [1, 10, 100, 10_000])
def test_equals_a_walk(spark, budget):
    rng = random.Random(budget)
    sizes = [rng.choice([0, 1, 3, 9, 10, 11, 50, 250, None, -5]) for _ in range(400)]
    rows = list(enumerate(sizes))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "i int, size long")
    got = {r.i: r.batch for r in batching.batches_by_bytes(frame, ("i",), F.col("size"), budget).collect()}
    assert [got[i] for i in range(len(sizes))] == walk(sizes, budget)


def test_small_tables(spark):
    frame = spark.createDataFrame([], "i int, size long")
    assert batching.batches_by_bytes(frame, ("i",), F.col("size"), 5).count() == 0
    one = batching.batches_by_bytes(spark.createDataFrame([(3, 99)], "i int, size long"), ("i",), F.col("size"), 5).collect()
    assert [(r.i, r.batch) for r in one] == [(3, 0)]


def test_a_batch_reads_its_own_rows_only(spark):
    found = spark.range(900).select(F.concat(F.lit("g"), F.col("id") % 90).alias("gav_path"), (F.col("id") % 7).alias("batch"))
    parts = list(cli.dealt(found))
    assert len(parts) == 7
    for i, part in enumerate(parts):
        files = part.inputFiles()
        assert files and all(f"/batch={i}/" in f for f in files) and part.columns == ["gav_path"]
    assert sum(p.count() for p in parts) == 900


def test_folder_by_bytes(spark, tmp_path):
    """A folder over the budget is scanned in several batches, each within it, with the findings of one."""
    for i in range(12):
        d = tmp_path / "org" / f"a{i}" / "1.0"
        d.mkdir(parents=True)
        (d / f"a{i}-1.0.xml").write_text("password=abcdefgh1\n" * 20_000)  # 380 KB
    from siltstone.operators import rules
    from siltstone.plans import scan

    config = Config(repo_url=str(tmp_path), disk_budget_mb=1)
    found = scan.discover(spark, config)
    parts = list(cli.batches(found, config, None))
    assert len(parts) == 6 and all(p.agg(F.sum(F.length("content"))).first()[0] <= 1 << 20 for p in parts)
    key = lambda r: (r.file_path, r.line_number, r.match)
    got = sorted(key(r) for p in parts for r in scan.scan_files(p, list(rules.CORE)).findings.collect())
    assert got == sorted(map(key, scan.scan_files(found, list(rules.CORE)).findings.collect())) and len(got) == 240_000
