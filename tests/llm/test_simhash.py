import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm import common, queries, simhash
from siltstone.llm.components import connected_components

from .edge import edge_docs, empty, with_clashes


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    """{key: smallest key reachable} of {key: fingerprint}."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: slow_print(t) for k, t in docs.items()}
    want = slow_groups(prints)
    rows = queries.op9_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_links_are_complete_for_any_grid(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_prints = set(base) | {0, (1 << 64) - 1}
    for p in base:
        for flips in (1, 2, 3, 4):
            all_prints.add(p ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in all_prints]
    want = {frozenset((a[0], b[0])) for a, b in combinations(signed, 2) if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2}
    frame = spark.createDataFrame(signed, "fp long")
    for segments in (2, 4, 8, 16):
        rows = simhash.links(frame, segments=segments).collect()
        found = [frozenset((r.a, r.b)) for r in rows]
        assert set(found) == want and len(found) == len(want)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    rows = simhash.groups(docs).collect()
    assert len(rows) == docs.count()
    zero = {r.doc_id for r in rows if r.fp == 0}
    assert zero == {1, 2, 3} and {r.component_id for r in rows if r.fp == 0} == {1}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9]
    assert simhash.groups(empty(spark)).count() == 0 and simhash.deduplicated(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(None, 3), (5, 5)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(root) and all(find(r.node) == r.component for r in found)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, most_rounds=2).count()
    assert {r.component for r in connected_components(edges).collect()} == {0}


def large_prints(spark):
    """A table of 210,000 fingerprints, which files of under 10 MB hold."""
    return common.materialize(spark.range(210_000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("first")), "prints")


def test_probes_are_not_broadcast(spark):
    found = simhash.links(large_prints(spark).select("fp"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_known_small_tables_may_be_broadcast(spark):
    prints = large_prints(spark)
    plan = lambda rows: prints.join(common.apart(prints.withColumnRenamed("first", "b"), rows), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(30_000) and "SortMergeJoin" in plan(210_000)
