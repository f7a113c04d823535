"""Running sums by ranges, several writers of a history, and exports in parts, against plain Python."""

import datetime
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import archive, listing
from siltstone.operators.ranges import sums_before
from siltstone.plans import queries, report, state, store, tasks


NOW = datetime.datetime(2024, 5, 1)
RECORD = "group_id string, artifact_id string, version string, repo_url string, status string, findings_count long, scan_time timestamp, duration_ms long, error string, rule_matches array<string>, file_hash string"
FOUND = "id long, record_id long, rule_id string, rule_name string, severity string, file_path string, line_number int, line_content string, match string"


def batch(spark, name: str, rule: str):
    rec = spark.createDataFrame([("g", name, "1", "r", "complete", 1, NOW, None, None, ["x"], None)], RECORD)
    found = rec.withColumn("record_id", store.record_id()).selectExpr("1L as id", "record_id", f"'{rule}' as rule_id", "'' as rule_name", "'LOW' as severity", "'f' as file_path", "1 as line_number", "'' as line_content", "'' as match")
    return rec, found


def rules_of(s: store.Store) -> set:
    return {r.rule_id for r in s.read("findings").collect()}


def test_sums_before(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 3, 9]), rng.randrange(10)) for i in range(3000)]  # one key holds a third
    df = spark.createDataFrame(rows, "i int, k int, n int").repartition(5)
    got = {r.i: r.before for r in sums_before(df, ("k", "i"), F.col("n"), "before").collect()}
    total, want = 0, {}
    for i, _, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        want[i] = total
        total += n
    assert got == want
    assert sums_before(df.limit(0), ("k",), F.col("n"), "before").count() == 0


def test_eviction_and_usage(spark):
    rng = random.Random(4)
    files = [(f"p{i}", rng.randrange(40), rng.randrange(3 << 20)) for i in range(500)]
    df = spark.createDataFrame(files, "path string, mtime int, length long").repartition(7)
    left, gone = sum(f[2] for f in files) >> 20, set()
    for path, _, n in sorted(files, key=lambda f: (f[1], f[0])):
        if left > 200:
            gone.add(path)
        left -= n >> 20
    assert {r.path for r in state.evict(df, 200).collect()} == gone
    assert tuple(state.usage(df).first()) == (sum(f[2] for f in files) >> 20, 500) and tuple(state.usage(df.limit(0)).first()) == (0, 0)


def test_walk_places(spark):
    paths = [("a/b/c",), ("a/b",), ("a-b/x",), ("a",), ("b",), ("a/a/z",)]
    got = listing.walk_places(spark.createDataFrame(paths, "path string").repartition(3)).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.place)] == sorted((p for p, in paths), key=lambda p: p.split("/"))
    assert sorted(r.place for r in got) == list(range(1, 7))


def test_revisit_takes_equal_rows_and_no_others(spark):
    rows = spark.createDataFrame([("a/b", 1), ("a/b", 1), ("a/b/c", 2), (None, 3), ("", 4)], "gav_path string, n int")
    dirs = spark.createDataFrame([("a/b",), (None,)], "gav_path string")
    assert sorted(r.n for r in state.revisit(rows, dirs).collect()) == [1, 1, 2]


def test_writers_at_once_lose_no_batch(spark, tmp_path):
    path, failed = str(tmp_path / "h"), []

    def save(i: int) -> None:
        try:
            store.Store(spark, path, merge_every=100).save(*batch(spark, f"a{i}", f"rule{i}"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=save, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = store.Store(spark, path)
    assert not failed and rules_of(s) == {f"rule{i}" for i in range(8)}
    assert len({n for n, _ in s._batches()}) == 8


def test_merging_waits_for_a_batch_under_way(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "h"), merge_every=100)
    for i in range(2):
        s.save(*batch(spark, f"a{i}", f"rule{i}"))
    slow = s._claim()
    for i in range(2, 4):
        s.save(*batch(spark, f"a{i}", f"rule{i}"))
    old = s.read("findings")  # planned, not run
    s.compact()
    assert {r.rule_id for r in old.collect()} == {"rule0", "rule1", "rule2", "rule3"}
    s._write(f"batch-{slow:08d}", slow, *(lambda r, f: (r.withColumn("id", store.record_id()), f))(*batch(spark, "late", "rule9")))
    assert rules_of(s) == {"rule0", "rule1", "rule2", "rule3", "rule9"}
    s.compact()
    s.compact()
    assert rules_of(s) == {"rule0", "rule1", "rule2", "rule3", "rule9"} and len(s._batches()) == 1


def test_a_claim_past_its_time(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "h"), claim_hours=-1)
    with pytest.raises(TimeoutError):
        s.save(*batch(spark, "a", "rule"))
    assert s.read("records").count() == 0 and s._under_way() == set()


def test_export_in_parts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "h"))
    for i in range(3):
        s.save(*batch(spark, f"a{i}", f"rule{i}"))
    rows = store.export(s.read("findings"), s.read("records"))
    report.write_export(rows, str(tmp_path / "all.json"))
    assert json.loads((tmp_path / "all.json").read_text()) == json.loads(report.export_json(rows).first().json)
    report.write_export(rows.limit(0), str(tmp_path / "none.json"))
    assert (tmp_path / "none.json").read_text() == "null\n"


def test_task_options(spark):
    rows = spark.createDataFrame([(3, "g"), (None, None)], "n long, g string").select(tasks.packed(concurrency=F.col("n"), group=F.col("g"), skip_pom=F.lit(True)).alias("config"))
    first, second = (r.config for r in rows.collect())
    assert json.loads(first) == Config(concurrency=3, group="g", skip_pom=True).snapshot()
    assert Config.from_snapshot(json.loads(first)) == Config(concurrency=3, group="g", skip_pom=True)
    made = json.dumps(Config(qps=1.5, auth_token="x").snapshot() | {"auth_token": "x", "unknown": 1})
    got = spark.createDataFrame([(first,), (second,), (made,), ("{",), (None,)], "config string").select(tasks.unpacked(F.col("config")).alias("c")).collect()
    assert (got[0].c.concurrency, got[0].c.group, got[0].c.skip_pom, got[1].c.concurrency) == (3, "g", True, None)
    assert got[2].c.qps == 1.5 and "auth_token" not in got[2].c.asDict() and got[3].c.concurrency is None and got[4].c is None
    with pytest.raises(ValueError):
        tasks.packed(auth_token=F.lit("x"))


def test_expired_records_stay_deleted(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "h"), merge_every=100)
    for i, days in enumerate((0, 10, 20)):
        rec, found = batch(spark, f"a{i}", f"rule{i}")
        s.save(rec.withColumn("scan_time", F.lit(NOW).cast("timestamp") - F.make_interval(days=F.lit(days))), found)
    s.expire(NOW, 15)
    again = store.Store(spark, str(tmp_path / "h"))
    assert rules_of(again) == {"rule0", "rule1"} and again.read("records").count() == 2
    again.compact()
    assert rules_of(again) == {"rule0", "rule1"} and again.read("records").count() == 2
    again.expire(NOW, 5)
    again.save(*batch(spark, "a2", "rule9"))  # a later scan brings a record back
    assert rules_of(again) == {"rule0", "rule9"}
    again.expire(NOW, 5)
    assert rules_of(again) == {"rule0", "rule9"}


def test_attempts_run_out(spark, tmp_path):
    path = str(tmp_path / "attempts")
    assert state.exhausted(state.attempts(spark, path)).count() == 0
    for i in range(4):
        rows = [("a", "failed", "e"), ("b", "failed" if i < 3 else "complete", None), ("c", "complete", None), ("d", "failed" if i > 1 else "complete", "x"), ("a", "complete", None)] + [("e", "failed", "e")] * (i == 0)
        state.add_attempts(spark.createDataFrame(rows, "gav_path string, status string, error string"), "r", NOW, path)
    assert [tuple(r) for r in state.exhausted(state.attempts(spark, path)).collect()] == [("a", 4)]
    assert state.exhausted(state.attempts(spark, path), most=0).count() == 0


def test_archives_of_one_split_are_dealt(spark, tmp_path, monkeypatch):
    sizes = [1, 19, 20, 21, 50]
    spark.createDataFrame([(i, sizes[i % 5]) for i in range(1000)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made, expand = [], archive.expand
    monkeypatch.setattr(queries, "DEALT", 100, raising=False)
    monkeypatch.setattr(archive, "expand", lambda files, *args: made.append(files) or expand(files, *args))
    found = queries.archive_guards(spark, str(tmp_path))
    held = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 1000 and len(held) > 8 and max(held) < 200
    assert {tuple(r) for r in found.collect()} == {(i, min(sizes[i % 5], 20) + 1, sizes[i % 5] > 20, 1) for i in range(1000)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
