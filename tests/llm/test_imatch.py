import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm import common, imatch, queries

from .edge import edge_docs, empty, with_clashes


def edited(rows):
    """{(doc_id, text): sha of the edited text} of rows in the contract's order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return out


def test_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op8_imatch(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(edited(docs))
    by_text, texts = {}, dict(docs)
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    mean = lambda xs: sum(xs) / len(xs)
    assert mean([r.near_edited for r in rows]) > 0.2 > 0.05 > mean([r.near_next for r in rows])


def test_lexicon_band(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = Counter()
    texts = [r.text or "" for r in docs.collect()]
    for t in texts:
        words.update(set(re.findall(r"[^\W_]+", t.lower())))
    low, high = max(2.0, len(texts) * 2.718281828459045**-7.6), max(2.0, len(texts) * 2.718281828459045**-2.3)
    want = [w for w, c in words.items() if low <= c <= high]
    hashes = {r.h for r in spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w").alias("h")).collect()}
    assert {r.h for r in imatch.lexicon(docs, 2.3, 7.6).collect()} == hashes


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    lex = spark.range(3000).select(F.xxhash64("id").alias("h"))
    row, bits = imatch.bloom(lex)
    array = row.first().bits
    assert len(array) * 64 == bits
    tests = spark.range(20000).select("id", *[p.alias(f"p{i}") for i, p in enumerate(imatch.probes(F.xxhash64("id"), bits))]).collect()
    passed = {r.id for r in tests if all(array[p >> 6] >> (p & 63) & 1 for p in (r.p0, r.p1))}
    assert passed >= set(range(3000)) and len(passed) - 3000 < 0.01 * 17000


def test_bucket_search(spark):
    edges = sorted({(i * 7919) % 100_003 for i in range(1500)})
    rows = spark.range(0, 100_010, 37).select("id", common.bucket(F.col("id"), edges).alias("b")).collect()
    import bisect

    assert all(r.b == bisect.bisect_left(edges, r.id) for r in rows)


def test_next_across_buckets(spark):
    docs = [(i * i % 1009, f"text {i}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = imatch.with_next(frame, rows_each=10, least=20).collect()
    order = sorted(docs, key=lambda r: (-r[0], r[1]))
    want = sorted((d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order))
    assert sorted((r.doc_id, r.text, r.next_text) for r in rows) == want


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    rows = imatch.fingerprints(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(map(str, edited(texts))) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in rows)
    assert imatch.fingerprints(empty(spark)).count() == 0
    one = imatch.fingerprints(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op8_imatch(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
