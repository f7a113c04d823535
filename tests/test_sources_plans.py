import datetime
import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.config import Config
from siltstone.operators import rules
from siltstone.plans import report, scan, state, store, tasks
from siltstone.sources import http
from siltstone.streaming.incremental import scan_stream

NOW = datetime.datetime(2024, 5, 1, 12, 0, 0)
TREE = {
    "org/a/lib/1.0/lib-1.0.jar": "jar", "org/a/lib/1.0/lib-1.0.pom": "pom", "org/a/lib/1.0/lib-1.0-sources.jar": "jar",
    "org/a/lib/2.0/lib-2.0.jar": "jar", "org/b/x/1/x-1.war": "jar", "top.xml": "pom",
}


def jar(text="db.password=S3cretP@ssw0rd\n"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("conf/app.properties", text)
    return out.getvalue()


def body(path):
    return jar() if TREE[path] == "jar" else b"<project/>"


@pytest.fixture
def mirror(tmp_path):
    root = tmp_path / "mirror"
    for p in TREE:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(body(p))
    return root


class Repo(BaseHTTPRequestHandler):
    failures: dict = {}
    seen: list = []

    def do_GET(self):
        path = self.path.strip("/")
        Repo.seen.append((path, self.headers.get("Authorization")))
        if Repo.failures.get(path, 0) > 0:
            Repo.failures[path] -= 1
            self.send_response(503)
            self.end_headers()
            return
        if path in TREE:
            data = body(path)
        else:
            under = [p[len(path) :].strip("/") for p in TREE if not path or p.startswith(path + "/")]
            if not under:
                self.send_response(404)
                self.end_headers()
                return
            kids = sorted({u.split("/")[0] + ("/" if "/" in u else "") for u in under})
            data = ('<a href="../">../</a>' + "".join(f'<a href="{k}">{k}</a>' for k in kids)).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def repo():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Repo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_walk(spark, repo):
    files, failed = http.walk(spark, repo, include_sources=True)
    assert {r.path for r in files.collect()} == set(TREE) and failed.count() == 0
    files, _ = http.walk(spark, repo, group="org.a", skip_pom=True)
    assert {r.path for r in files.collect()} == {"org/a/lib/1.0/lib-1.0.jar", "org/a/lib/2.0/lib-2.0.jar"}
    with pytest.raises(OSError):
        http.walk(spark, repo + "/none", http.Options(retries=0))


def test_download_and_scan(spark, repo):
    files, _ = http.walk(spark, repo)
    got = http.fetch_all(files, http.Options(max_bytes=10_000), 2)
    result = scan.scan_files(got.where("error is null"), rules.CORE)
    assert {r.rule_id for r in result.findings.collect()} == {"hardcoded-password"} and result.findings.count() == 3
    small = http.fetch_all(files, http.Options(max_bytes=5), 2).collect()
    assert all(r.content is None and r.error for r in small)


def test_cursor_walk_stops_and_goes_on(repo):
    walk = http.CursorWalk(repo, http.Options())
    rows = walk.files()
    first = [next(rows)[0] for _ in range(2)]
    cursor = json.loads(json.dumps(walk.stack))
    rest = [p for p, _ in http.CursorWalk(repo, http.Options(), cursor).files()]
    assert first + rest == sorted(TREE, key=lambda p: p.split("/"))
    Repo.failures["org/b"] = 10
    walk = http.CursorWalk(repo, http.Options(retries=0))
    assert len(list(walk.files())) == 5 and walk.failed == ["org/b"]
    Repo.failures.clear()


def test_data_source_batch_and_stream(spark, repo, tmp_path):
    http.register(spark)
    rows = spark.read.format("repository").load(repo).collect()
    assert {r.path for r in rows} == set(TREE)
    stream = spark.readStream.format("repository").option("maxFilesPerTrigger", "2").load(repo)
    q = stream.writeStream.format("memory").queryName("repo_files").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.path for r in spark.table("repo_files").collect()) == sorted(TREE)


def test_http_helpers(repo):
    assert [http.is_retryable(http.HttpError(s, "u")) for s in (500, 503, 429, 404, 401)] == [True, True, True, False, False]
    assert http.is_retryable(ValueError()) and not http.is_retryable(http.TooLarge())
    assert [http.backoff_seconds(n, jitter=lambda: 0) for n in (0, 1, 4, 9)] == [1, 2, 16, 30] and http.backoff_seconds(0, jitter=lambda: 0.99) < 1.5
    assert http.backoff_seconds(3, http.HttpError(429, "u", "7")) == 7 and http.retry_after_seconds("900") == 300 and http.retry_after_seconds(" \t") is None and http.retry_after_seconds("x") is None
    assert http.retry_after_seconds("Thu, 01 Jan 1970 00:01:40 GMT", now=40) == 60
    waits, now = [], [0.0]
    bucket = http.Bucket(2, lambda: now[0], lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert waits == [0.5, 0.5]
    options = http.Options(header="X-Key: 1", token="t", user="u", password="p")
    assert options.headers()["X-Key"] == "1" and options.headers()["Authorization"].startswith("Basic ") and "p'" not in repr(options) and "t'" not in repr(options)
    Repo.failures["top.xml"] = 2
    naps = []
    assert http.fetch_with_retries(repo + "/top.xml", http.Options(), sleep=naps.append) == b"<project/>" and len(naps) == 2
    with pytest.raises(http.HttpError):
        http.fetch_with_retries(repo + "/nothing", http.Options(), sleep=naps.append)
    assert len(naps) == 2


def test_scan_repository_and_history(spark, mirror, tmp_path):
    config = Config(repo_url=str(mirror), rules_level="all")
    result = scan.scan_repository(spark, config)
    total = result.summary.first()
    assert (total.total_discovered, total.total_scanned, total.total_failed, total.total_findings) == (4, 4, 0, 3)
    assert total.by_severity == {"CRITICAL": 3} and total.by_rule == {"hardcoded-password": 3}
    s = store.Store(spark, str(tmp_path / "history"))
    for _ in range(2):  # the second time changes nothing
        s.save(*scan.history_rows(result, config.repo_url, NOW))
        assert s.read("records").count() == 3 and s.read("findings").count() == 3
    rec = {r.artifact_id + r.version: r for r in s.read("records").collect()}
    assert rec["lib1.0"].findings_count == 1 and rec["lib1.0"].rule_matches == ["hardcoded-password"]
    got = store.export(s.read("findings"), s.read("records"))
    assert len(json.loads(report.export_json(got).first().json)) == 3 and report.export_json(got.limit(0)).first().json is None
    stat = store.stats(s.read("records"), s.read("findings")).first()
    assert (stat.total_scanned, stat.total_complete, stat.total_findings, stat.critical) == (3, 3, 3, 3)
    done = spark.createDataFrame([("org/a/lib/1.0",)], "gav_path string")
    assert scan.scan_repository(spark, config, done).results.count() == 2
    one = scan.scan_repository(spark, Config(repo_url=str(mirror), one_file_per_gav=True, include_sources=True))
    assert {r.file_name for r in one.results.collect()} == {"lib-1.0-sources.jar", "lib-2.0.jar", "x-1.war"}


def test_store_log_and_compaction(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "h"), merge_every=3)
    record = "group_id string, artifact_id string, version string, repo_url string, status string, findings_count long, scan_time timestamp, duration_ms long, error string, rule_matches array<string>, file_hash string"
    assert s.read("records").count() == 0 and s.read("findings").count() == 0
    for n in range(6):  # two records by turns, each time with other findings
        rec = spark.createDataFrame([("g", f"a{n % 2}", "1", "r", "complete", 1, NOW, None, None, ["x"], None)], record)
        ids = rec.withColumn("record_id", store.record_id())
        found = ids.selectExpr(f"{n} as id", "record_id", f"'rule{n}' as rule_id", "'' as rule_name", "'LOW' as severity", "'f' as file_path", "1 as line_number", "'' as line_content", "'' as match")
        s.save(rec, found)
        if n == 3:
            s.save(rec, found)  # replayed
        want = {"rule0"} if n == 0 else {f"rule{n}", f"rule{n - 1}"}
        assert {r.rule_id for r in s.read("findings").collect()} == want and s.read("records").count() == len(want)
    assert len(s._batches()) <= 4 and any(name.startswith("base") for _, name in s._batches())


def test_failures_are_rows(spark, tmp_path):
    (tmp_path / "g/a/1").mkdir(parents=True)
    (tmp_path / "g/a/1/bad.jar").write_bytes(b"?")
    (tmp_path / "g/a/1/long.xml").write_text("x" * (1 << 20))
    result = scan.scan_repository(spark, Config(repo_url=str(tmp_path)))
    assert {r.file_name: r.status for r in result.results.collect()} == {"bad.jar": "failed", "long.xml": "failed"}
    assert result.summary.first().total_failed == 2


def test_stream_scans_each_file_once(spark, mirror, tmp_path):
    s, seen = store.Store(spark, str(tmp_path / "h")), []
    config = Config(repo_url=str(mirror), checkpoint_interval=2)
    run = lambda: scan_stream(spark, config, s, str(tmp_path / "cp"), lambda n, r: seen.append(r.results.count())).awaitTermination()
    run()
    assert s.read("records").count() == 3 and s.read("findings").count() == 3 and sum(seen) == 4
    (mirror / "org/b/x/2").mkdir()
    (mirror / "org/b/x/2/x-2.jar").write_bytes(jar())
    run()
    assert s.read("records").count() == 4 and sum(seen) == 5


def test_retention_and_orphans(spark):
    recs = spark.createDataFrame([(1, NOW - datetime.timedelta(days=10)), (2, NOW)], "id long, scan_time timestamp")
    found = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "record_id long, rule_id string")
    kept, left = store.delete_older(recs, found, NOW, 5)
    assert kept.count() == 1 and left.count() == 2
    kept, left = store.delete_older(recs, found, NOW, 5, cascade=False)
    assert left.count() == 3 and [r.rule_id for r in store.orphans(left, kept).collect()] == ["a"]


def test_upsert_last_wins(spark):
    row = lambda v, day, status: ("g", "a", v, "r", status, NOW + datetime.timedelta(days=day))
    schema = "group_id string, artifact_id string, version string, repo_url string, status string, scan_time timestamp"
    old = spark.createDataFrame([row("1", 0, "old"), row("2", 0, "old")], schema)
    new = spark.createDataFrame([row("1", 1, "a"), row("1", 2, "b"), row("3", 0, "c")], schema)
    assert {r.version: r.status for r in store.upsert(old, new).collect()} == {"1": "b", "2": "old", "3": "c"}


def test_tasks(spark):
    minute = datetime.timedelta(minutes=1)
    rows = [(1, "never", "active", 600, None), (2, "past", "active", 600, NOW - minute), (3, "future", "active", 600, NOW + minute), (4, "paused", "paused", 600, None), (5, "once", "active", 0, None)]
    frame = spark.createDataFrame([(i, t, "r", "", "{}", n, s, "", NOW - i * minute, None, w, "", 0) for i, t, s, n, w in rows], tasks.SCHEMA)
    assert [r.task_id for r in tasks.due(frame, NOW).collect()] == ["never", "once", "past"]
    after = {r.task_id: r for r in tasks.after_run(frame, NOW, "completed").collect()}
    assert after["past"].next_run_at == NOW + 10 * minute and after["past"].scan_count == 1 and after["once"].status == "completed" and after["once"].next_run_at is None and after["paused"].status == "active"
    assert {r.task_id: r.status for r in tasks.after_run(frame, NOW, "x", preserve_paused=True).collect()}["paused"] == "paused"
    assert [r.task_id for r in tasks.listed(frame).collect()] == ["never", "past", "future", "paused", "once"] and tasks.listed(frame, "paused").count() == 1
    assert tasks.with_status(frame, "past", "paused").where("status = 'paused'").count() == 2 and tasks.without(frame, "past").count() == 4


def test_state_file(tmp_path):
    path = str(tmp_path / "s.json")
    with pytest.raises(FileNotFoundError):
        state.load(path)
    s = state.new_state(Config(group="g", auth_pass="secret"), "id")
    state.save(s, path)
    state.save(s | {"total_scanned": 5}, path)
    assert state.load(path)["total_scanned"] == 5 and "secret" not in open(path).read()
    open(path, "w").write("{")
    assert state.load(path)["total_scanned"] == 0
    state.save(s, path)  # the damaged file must not become the backup
    open(path, "w").write("{")
    assert state.load(path)["scan_id"] == "id"
    open(path + ".bak", "w").write("{")
    with pytest.raises(state.StateError):
        state.load(path)
    state.save(s | {"version": 9}, path)
    with pytest.raises(state.StateError):
        state.load(path)
    state.check_drift(s, Config(group="g"))
    state.check_drift({"config_snapshot": {}}, Config())
    for other in ({"group": "h"}, {"group": "g", "rules_level": "all"}, {"group": "g", "skip_pom": True}, {"group": "g", "rules_file": "x"}, {"group": "g", "max_file_size": "1MB"}, {"group": "g", "repo_url": "http://x"}):
        with pytest.raises(state.StateError):
            state.check_drift(s, Config(**other))


def test_state_sets(spark):
    rows = spark.createDataFrame([("a/b/c", 1), ("a/b/c", 2), ("a/d", 3), ("ab/x", 4)], "gav_path string, n int")
    dirs = spark.createDataFrame([("a/b",), ("ab/x",)], "gav_path string")
    assert sorted(r.n for r in state.revisit(rows, dirs).collect()) == [1, 2, 4]
    assert sorted(r.n for r in state.not_in(rows, dirs).collect()) == [1, 2, 3]
    failed = spark.createDataFrame([("a", "e", NOW, 2), ("b", "e", NOW, 3)], "gav_path string, error string, failed_at timestamp, retries int")
    assert [r.gav_path for r in state.retryable(failed, 3).collect()] == ["a"] and state.retryable(failed, 0).count() == 2
    again = spark.createDataFrame([("a", "new", NOW + datetime.timedelta(1))], "gav_path string, error string, failed_at timestamp")
    assert {r.gav_path: (r.error, r.retries) for r in state.mark_failed(failed, again).collect()} == {"a": ("new", 3), "b": ("e", 3)}
    files = spark.createDataFrame([("old", 1, 300 << 20), ("mid", 2, 200 << 20), ("new", 3, 400 << 20)], "path string, mtime int, length long")
    assert {r.path for r in state.evict(files, 500).collect()} == {"old", "mid"} and state.evict(files, 1000).count() == 0


def test_reports(spark, mirror, tmp_path):
    result = scan.scan_repository(spark, Config(repo_url=str(mirror)))
    total, out = result.summary.first(), io.StringIO()
    report.print_report(result.findings, total, out)
    assert "\033[1;31mCRITICAL\033[0m [hardcoded-password] Hardcoded Password" in out.getvalue() and "  Findings:   3\n" in out.getvalue()
    text = report.document("id", "r", 4, "", total, report.details(result.findings).collect(), NOW, NOW)
    report.write_document(text, str(tmp_path / "r.json"))
    doc = json.loads((tmp_path / "r.json").read_text())
    assert doc["summary"]["by_rule"] == {"hardcoded-password": 3} and doc["findings"][0]["match"].startswith("password=") and "group_filter" not in doc["config"]
    report.write_rows(result.findings, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 3
