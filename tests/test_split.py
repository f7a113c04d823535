import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import archive, split
from siltstone.operators.archive import Limits


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def text(rng, n):
    return "".join(rng.choices("abcdefghij \n", k=n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(6)
    root = tmp_path_factory.mktemp("large jars")
    inner = zipped([(f"in/{i}.txt", text(rng, 50)) for i in range(9)] + [("in/x.bin", b"\0" * 50), ("in/deep.zip", zipped([("d.txt", "deep")]))])
    many = [(f"d{i}/f{i}.properties", text(rng, 400_000)) for i in range(60)]
    files = {
        "many.jar": zipped(many[:30] + [("lib/inner.jar", inner), ("dir/", ""), ("pic.png", b"\0\1")] + many[30:]),
        "stored.zip": zipped([("a.txt", "A"), ("b.txt", ""), ("b.bin.txt", b"\0\0\0"), ("é.txt", "é".encode("latin-1"))], zipfile.ZIP_STORED),
        "bomb.zip": zipped([("a.txt", "x"), ("bomb.txt", "0" * 3_000_000), ("b.txt", "y")]),
        "nested.war": zipped([("a.txt", "1"), ("one.jar", inner), ("two.jar", inner), ("bad.jar", b"no zip"), ("z.txt", "2")]),
        "broken.jar": b"PK\3\4 nothing",
        "empty.zip": zipped([]),
    }
    damaged = bytearray(zipped([("good.txt", "fine"), ("bad.txt", "wrong" * 9), ("last.txt", "end")], zipfile.ZIP_STORED))
    damaged[damaged.index(b"wrongwrong")] ^= 1
    files["crc.jar"] = bytes(damaged)
    for name, data in files.items():
        (root / name).write_bytes(data)
    return root


def listed(spark, folder):
    return spark.read.format("binaryFile").load(f"file://{folder}")


LIMITS = [Limits(), Limits(entries=7), Limits(entries=12), Limits(entries=40), Limits(total_bytes=1_000_000), Limits(total_bytes=120), Limits(ratio=1), Limits(depth=1), Limits(sniffed=2)]


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_equals_expand(spark, folder, limits):
    files = listed(spark, folder)
    rows = lambda frame: sorted(tuple(r) for r in frame.select("container_path", "entry_ord", "file_path", "text").where("text is not null").collect())
    want, got = archive.expand(files, limits), split.expand_split(files.select("path"), limits)
    a, b = rows(want), rows(got)
    nested_over = limits.total_bytes < 1000  # behind a nested archive that goes over, nothing is taken here
    assert set(b) <= set(a) if nested_over else a == b
    assert len(b) > 5
    errors = lambda frame: {r.container_path: r.error for r in frame.where("text is null").collect()}
    e, f = errors(want), errors(got)
    assert set(e) == set(f)
    if limits == Limits():
        assert e == f


def test_markers_and_carried_columns(spark, folder):
    files = listed(spark, folder).withColumn("gav", F.element_at(F.split("path", "/"), -1))
    rows = lambda frame: sorted(((r.container_path, r.entry_ord, r.gav, r.error or "") for r in frame.collect() if r.text is None))
    got = rows(split.expand_split(files, carried=["gav"], markers=True))
    assert got == rows(archive.expand(files, carried=["gav"], markers=True)) and len(got) == 7


def test_one_container_is_many_tasks(spark, folder):
    """Sixty entries of 400 KB each go to several tasks, none of which gets more than half of them."""
    files = listed(spark, folder).where(F.col("path").endswith("many.jar")).select("path")
    units = split.admitted(split.directory(files, Limits()), Limits()).where("opened and over is null")
    tasks = split.dealt(units).groupBy(F.spark_partition_id()).count().collect()
    n = sum(r["count"] for r in tasks)
    assert n == 61 and len(tasks) >= 3 and max(r["count"] for r in tasks) <= 45


def test_no_files(spark):
    assert split.expand_split(spark.createDataFrame([], "path string")).count() == 0


def test_scan_splits_large_containers(spark, folder):
    from siltstone.operators import rules
    from siltstone.plans import scan

    rule = rules.Rule(id="ab", severity="LOW", enabled=True, patterns=("abcd",))
    files = listed(spark, folder)
    rows = lambda result: (sorted(map(str, result.findings.collect())), sorted(map(str, result.results.collect())))
    whole = rows(scan.scan_files(files.drop("length"), [rule]))
    assert rows(scan.scan_files(files, [rule], large=200)) == whole and len(whole[0]) > 100
