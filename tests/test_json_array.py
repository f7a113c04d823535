import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import json_array


def test_round_trip_in_order(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit('"ü\n,{'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("some"))
    path = str(tmp_path / "a b.json")
    json_array.write_array(rows.repartitionByRange(7, "id").sortWithinPartitions("id"), path)
    whole = json.loads(open(path, encoding="utf-8").read())
    assert [r["id"] for r in whole] == list(range(1000)) and whole[3]["text"] == '"ü\n,{3'
    back = json_array.read_array(spark, path, "id long, text string, some long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert os.listdir(tmp_path) == ["a b.json"]


def test_empty_table_and_empty_tasks(spark, tmp_path):
    path = str(tmp_path / "x.json")
    json_array.write_array(spark.range(0), path)
    assert open(path).read() == "null\n"
    json_array.write_array(spark.range(100).repartition(5).where("id = 42"), path)
    assert json.loads(open(path).read()) == [{"id": 42}]


def test_failed_write_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "x.json")
    json_array.write_array(spark.range(3), path)
    bad = spark.range(10).repartition(3).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        json_array.write_array(bad, path)
    assert len(json.loads(open(path).read())) == 3 and os.listdir(tmp_path) == ["x.json"]


def test_a_task_that_ran_twice_counts_once(tmp_path):
    parts = tmp_path / "parts"
    parts.mkdir()
    for name, rows in (("1-8", '{"a":2}'), ("1-9", '{"a":2}'), ("0-7", '{"a":1}')):
        (parts / name).write_text(rows)
    writer = json_array.JsonArrayWriter({"path": str(tmp_path / "o.json"), "parts": str(parts)})
    writer.commit([json_array.Part(1, str(parts / "1-9"), 1), None, json_array.Part(0, str(parts / "0-7"), 1)])
    assert json.loads((tmp_path / "o.json").read_text()) == [{"a": 1}, {"a": 2}]


def test_stores_are_refused():
    with pytest.raises(ValueError):
        json_array.local("s3://b/x.json")
