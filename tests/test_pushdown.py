import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone.sources import http

TREE = [f"{g}/a{i}/{v}/a{i}-{v}.{e}" for g in ("org/one", "org/two", "com/x") for i in range(4) for v in ("1.0", "2.0") for e in ("jar", "pom")] + ["top.xml", "org/readme.txt"]


class Counted(BaseHTTPRequestHandler):
    seen: list = []
    broken: set = set()

    def do_GET(self):
        path = self.path.strip("/")
        Counted.seen.append(path)
        under = [p[len(path) :].strip("/") for p in TREE if not path or p.startswith(path + "/")]
        if not under or path in Counted.broken:
            self.send_response(404)
            self.end_headers()
            return
        kids = sorted({u.split("/")[0] + ("/" if "/" in u else "") for u in under})
        data = "".join(f'<a href="{k}">{k}</a>' for k in kids).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def repo():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Counted)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def load(spark, repo, **options):
    http.register(spark)
    Counted.seen.clear()
    return spark.read.format("repository").options(retries="0", **options).load(repo)


@pytest.mark.parametrize(
    "condition",
    ["path like 'org/one/%'", "path like 'org/one/a2/2%' and path like '%.jar'", "path = 'com/x/a1/1.0/a1-1.0.pom'", "startswith(path, 'org/') and startswith(path, 'org/two/a')", "path like 'net/%'", "path like 'org/one/%' and path like 'com/%'", "endswith(path, '.xml')", "path like '%two%'"],
)
@pytest.mark.parametrize("splits", ["1", "5", "1000"])
def test_filters(spark, repo, condition, splits):
    rows = load(spark, repo, splits=splits).where(condition)
    want = spark.createDataFrame([(p,) for p in TREE], "path string").where(condition)
    assert sorted(r.path for r in rows.collect()) == sorted(r.path for r in want.collect())


def test_nothing_outside_the_prefix_is_asked_for(spark, repo):
    rows = load(spark, repo, splits="4").where(F.col("path").startswith("org/one/a2/")).collect()
    assert len(rows) == 4 and Counted.seen and all(p.startswith("org/one/a2") for p in Counted.seen)
    rows = load(spark, repo).where(F.col("path").startswith("org/o")).collect()
    assert len(rows) == 16 and all(p == "org" or p.startswith("org/o") for p in Counted.seen)


def test_partitions_lie_below_the_top(spark, repo):
    frame = load(spark, repo, splits="10")
    paths = frame.groupBy(F.spark_partition_id()).agg(F.collect_set(F.regexp_extract("path", "^[^/]+/[^/]+/[^/]+", 0)).alias("dirs")).collect()
    assert len(paths) >= 12 and max(len(r.dirs) for r in paths) == 1


def test_failures_are_rows_or_an_error(spark, repo):
    Counted.broken = {"org/two", "com/x/a1/1.0"}
    try:
        rows = load(spark, repo, failures="rows").collect()
        assert sorted(r.path for r in rows if r.error) == sorted(Counted.broken) and sum(not r.error for r in rows) == len(TREE) - 18
        assert load(spark, repo, failures="rows").where("path like 'org/one/%' and error is null").count() == 16
        with pytest.raises(Exception, match="can't list"):
            load(spark, repo, splits="2").collect()
    finally:
        Counted.broken = set()
