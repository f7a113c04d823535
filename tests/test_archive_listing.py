import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import archive, listing
from siltstone.operators.archive import Limits, expand_bytes


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries, gz=False):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if gz else "w") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def names(name, data, limits=Limits()):
    return [n for n, _ in expand_bytes(name, data, limits)[0]]


def test_zip_nested_and_filters():
    inner = zipped([("c.yml", b"k: v"), ("d.class", b"x")])
    outer = zipped([("a/", b""), ("a/b.properties", b"p=1"), ("x.png", b"1"), ("WEB-INF/lib/inner.jar", inner), ("bin.json", b"a\0b"), ("Dockerfile", b"FROM x"), ("t.tar", tarred([("e.txt", b"1")]))])
    assert names("x.WAR", outer) == ["a/b.properties", "c.yml", "Dockerfile"]
    assert names("empty.jar", zipped([])) == []
    assert expand_bytes("bad.jar", b"not a zip") == ([], "BadZipFile: File is not a zip file")


def test_bomb_guards():
    bomb = zipped([("a.txt", b"0" * 200_000), ("b.txt", b"fine")])
    assert names("x.jar", bomb) == ["b.txt"]
    many = zipped([(f"{i}.txt", b"x") for i in range(10)], zipfile.ZIP_STORED)
    assert len(names("x.jar", many, Limits(entries=4))) == 4
    big = zipped([("a.txt", b"x" * 60), ("b.txt", b"x" * 30), ("c.txt", b"x" * 30), ("d.txt", b"x")], zipfile.ZIP_STORED)
    assert names("x.jar", big, Limits(total_bytes=100)) == ["a.txt", "b.txt"]
    assert names("x.jar", big, Limits(total_bytes=50)) == ["b.txt"]
    tar = tarred([("d", None), ("a.txt", b"x" * 60), ("b.txt", b"x" * 30), ("c.txt", b"x")])
    assert names("x.tar", tar, Limits(total_bytes=50)) == ["b.txt", "c.txt"] and names("x.tar", tar, Limits(entries=1)) == ["a.txt"]


def test_depth():
    data = zipped([("deep.txt", b"here")])
    for i in range(7):
        data = zipped([(f"n{i}.jar", data), (f"at{i}.txt", b"x")])
    # five nested levels are entered; the sixth is not, and a jar itself is no text
    assert names("x.jar", data) == [f"at{i}.txt" for i in (1, 2, 3, 4, 5, 6)] and names("x.jar", data, Limits(depth=1)) == ["at5.txt", "at6.txt"]


def test_tar_gz_and_damage():
    tar = tarred([("a.txt", b"one"), ("n.jar", zipped([("b.txt", b"2")])), ("c.sh", b"three")], gz=True)
    assert names("x.tgz", tar) == ["a.txt", "c.sh"] == names("x.tar.gz", tar)
    cut = tarred([("a.txt", b"one"), ("b.txt", b"2" * 2000)])[:1600]
    found, error = expand_bytes("x.tar", cut)
    assert [n for n, _ in found] == ["a.txt"] and error
    assert expand_bytes("x.gz", gzip.compress(b"no tar"))[0] == []


def test_plain_files_pass():
    assert expand_bytes("/m/a.pom", b"\0<x>")[0] == [("a.pom", b"\0<x>")]


def test_binary_sniff(spark):
    cases = [b"", b"abc", b"a\0", b"\x01" * 4 + b"a" * 6, b"\x01" * 3 + b"a" * 7, b"\t\n\r" * 5, b"x" * 1024 + b"\0"]
    want = [False, False, True, True, False, False, False]
    assert [archive.looks_binary(c) for c in cases] == want
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    assert [r.b for r in frame.select("i", archive.looks_binary_column(F.col("c")).alias("b")).orderBy("i").collect()] == want


def test_scannable(spark):
    cases = {"Dockerfile": True, "a/Jenkinsfile": True, "LICENSE": True, ".npmrc": True, "settings.xml.bak": True, "A.class": False, "x.png": False, "run": False, "a.XML": True}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.s for r in frame.select("p", archive.is_scannable(F.col("p")).alias("s")).collect()} == cases
    assert {k: archive._wanted(k) for k in cases} == cases


def test_expand_with_errors(spark):
    frame = spark.createDataFrame([("/r/a.jar", bytearray(zipped([("a.txt", b"x\xff")]))), ("/r/b.jar", bytearray(b"?"))], "path string, content binary")
    rows = {r.container_path: r for r in archive.expand(frame).collect()}
    assert rows["/r/a.jar"].text == "x�" and rows["/r/b.jar"].text is None and "BadZip" in rows["/r/b.jar"].error


def test_small_containers_leave_together(spark, monkeypatch):
    data = [(f"/r/{i}.jar", bytearray(b"?" if i == 7 else zipped([("a.txt", b"%d" % i), ("b.txt", b"")]))) for i in range(20)]
    frame = spark.createDataFrame(data, "path string, content binary").coalesce(1)
    given = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: given.append((self, f)))
    archive.expand(frame)
    batches = lambda: list(given[0][1](given[0][0].toArrow().to_batches()))
    want = [(p, n, f"{'ab'[n]}.txt", [p[3:-4], ""][n], None) for p, _ in data for n in range(2)]
    want[14:16] = [("/r/7.jar", 0, None, None, "BadZipFile: File is not a zip file")]
    (whole,) = batches()
    assert [tuple(r.values()) for r in whole.to_pylist()] == want
    monkeypatch.setattr(archive, "ROWS", 4)
    cut = batches()
    assert len(cut) == 10 and [tuple(r.values()) for b in cut for r in b.to_pylist()] == want


LISTING = """<a href="../">../</a> <a href="1.0/">1.0/</a> <a href="a-1.0.jar" title="x">a-1.0.jar</a>
<a  href="a%2Bb.pom">a+b.pom</a> <a href="/">/</a> <a class="x" href="no.jar">no</a> <a href="..">Parent Directory</a>"""


def test_listing(spark):
    frame = spark.createDataFrame([("http://r/x", LISTING)], "url string, html string")
    rows = listing.parse_listings(frame).orderBy("entry_ord").collect()
    assert [(r.name, r.is_dir, r.entry_url) for r in rows] == [("1.0", True, "http://r/x/1.0/"), ("a-1.0.jar", False, "http://r/x/a-1.0.jar"), ("a%2Bb.pom", False, "http://r/x/a%2Bb.pom"), ("..", False, "http://r/x/..")]
    assert listing.parse_listings(frame, strict=True).count() == 3


def test_artifacts(spark):
    paths = ["org/a/lib/1/lib-1.jar", "org/a/lib/1/lib-1.pom", "org/a/lib/1/lib-1-sources.jar", "org/a/lib/maven-metadata.xml", "x/y.jar", "org/a/lib/1/lib-1.JAR", "org/ab/c/2/c.war"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = {r.path: r for r in listing.artifacts(frame).collect()}
    assert set(rows) == {paths[0], paths[1], paths[3], paths[6]}
    assert (rows[paths[0]].group_id, rows[paths[0]].artifact_id, rows[paths[0]].version, rows[paths[0]].gav_path) == ("org.a", "lib", "1", "org/a/lib/1")
    assert rows[paths[3]].is_metadata and not rows[paths[0]].is_metadata
    assert {r.path for r in listing.artifacts(frame, include_sources=True, skip_pom=True).collect()} == {paths[0], paths[2], paths[6]}
    assert {r.path for r in listing.artifacts(frame, exclude="*/c/*").collect()} == set(rows) - {paths[6]}
    assert {r.path for r in listing.under_group(frame, "org.a").collect()} == {p for p in paths if p.startswith("org/a/")}
    first = listing.first_per_key(listing.artifacts(frame, include_sources=True))
    assert {r.file_name for r in first.collect()} == {"lib-1-sources.jar", "maven-metadata.xml", "c.war"}
