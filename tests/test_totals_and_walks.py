import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import rules, table_function
from siltstone.plans import scan, state
from siltstone.plans.queries import _containers, corpus


def test_files_left_of_many_runs(spark):
    rng = random.Random(7)
    name = lambda: rng.choice(["a", "b", "ab", "a b", "ä", "a-1"])
    files = sorted({"/".join(name() for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    cursors = [rng.choice(files).split("/")[: rng.randrange(1, 5)] for _ in range(80)] + [[], None, ["zz"]]
    runs = [(f"r{i}", c) for i, c in enumerate(cursors)]
    got = {r.run: (r.files_left, r.next_path) for r in state.files_left(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(runs, "run string, cursor array<string>")).collect()}
    key = lambda parts: [p.encode() for p in parts]
    for run, cursor in runs:
        left = sorted((f for f in files if key(f.split("/")) > key(cursor or [])), key=lambda f: key(f.split("/")))
        assert got[run] == (len(left), left[0] if left else None)
    assert state.files_left(spark.createDataFrame([], "path string"), spark.createDataFrame([("x", ["a"])], "run string, cursor array<string>")).first().files_left == 0


def test_totals_come_with_the_write(spark, sf_dir):
    """One job writes the rows of a scan and counts them; the totals are those of the summary."""
    files = _containers(spark, sf_dir).unionByName(spark.createDataFrame([("/r/broken.jar", bytearray(b"no zip")), ("/r/long.xml", bytearray(b"x" * (1 << 20) + b"\npassword=abcdefgh1")), ("/r/a.xml", bytearray(b"password=abcdefgh1"))], "path string, content binary"))
    files.write.parquet(path := scan.scratch_path(spark, "boxes"))
    files = spark.read.parquet(path)
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "scan")
    try:
        result = scan.scan_files(files, [r for r in rules.builtin("all") if r.engine != "entropy"])
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    total = result.summary.first()
    assert result.totals == {k: total[k] for k in ("total_discovered", "total_scanned", "total_failed", "total_findings")}
    assert result.totals["total_failed"] == 2 and result.totals["total_findings"] > 50


def test_engines_in_sql(spark):
    table_function.register_engine(spark, "numbers", lambda line: re.findall("[0-9]+", line))
    spark.createDataFrame([("a", 1, "x1 22"), ("a", 2, None), ("b", 1, ""), ("b", 2, "333")], "file_path string, line_number int, line string").createOrReplaceTempView("number_lines")
    rows = spark.sql("SELECT * FROM numbers(TABLE(number_lines) PARTITION BY file_path)")
    assert rows.columns == ["file_path", "line_number", "match_ord", "match"]
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 0, "1"), ("a", 1, 1, "22"), ("b", 2, 0, "333")]
    with pytest.raises(Exception, match="with a column line"):
        spark.sql("SELECT * FROM numbers(TABLE(SELECT 1 AS a))").collect()


def test_engine_of_sql_finds_what_detection_does(spark, sf_dir):
    table_function.register_engine(spark, "passwords", lambda line: re.findall("password=[^ ]+", line))
    lines = corpus(spark, sf_dir)
    lines.createOrReplaceTempView("corpus_lines")
    got = spark.sql("SELECT k, match FROM passwords(TABLE(corpus_lines))")
    want = lines.select("k", F.explode(F.regexp_extract_all("line", F.lit("password=[^ ]+"), F.lit(0))).alias("match"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
