import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import common, jaccard

from .edge import edge_docs, empty, with_clashes


def slow_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(docs):
    """Smallest ids of the components of {doc_id: text} by brute-force Jaccard of five words."""
    sets, root = {k: slow_set(t) for k, t in docs.items()}, {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = 0
    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) / len(x | y) >= 0.8:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
            pairs += x != y
    return {k for k in docs if find(k) == k}, pairs


def near_copies():
    """Texts with 0 to 12 words replaced, so that similarities lie on either side of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for n, copies in [(150, 12)] * 8 + [(160, 60), (6, 4), (3, 2)]:
        base = [word() for _ in range(n)]
        docs.append(" ".join(base))
        for _ in range(copies):
            text = list(base)
            for i in rng.sample(range(n), rng.randrange(min(n, 7))):
                text[i] = word()
            docs.append(" ".join(text))
    rng.shuffle(docs)
    return dict(enumerate(docs))


def test_stage_against_brute_force(spark):
    docs = near_copies()
    want, pairs = slow_kept(docs)
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.dedup_stage(spark, frame, "").collect()
    assert pairs > 100 and len(want) < len(docs) - 80
    assert {r.doc_id for r in found} == want and len(found) == len(want)


def test_stage_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, pairs = slow_kept({r.doc_id: r.text for r in docs.collect()})
    assert pairs and {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()} == want


def test_tiles_give_the_same_components(spark):
    rng = np.random.default_rng(1)
    base = rng.choice(1 << 40, 100, False).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(100) < 0.93], rng.choice(1 << 40, rng.integers(5), False).astype(np.uint64)]) for _ in range(50)]
    frame = spark.createDataFrame([(0, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "component long, first long, raw binary")
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    want = {p for p in combinations(range(50), 2) if near(*p)}
    found = {tuple(sorted(map(int, p))) for p in jaccard.linked(sets, None, 0.8)}
    assert found == want
    assert {tuple(sorted(map(int, p))) for p in jaccard.linked(sets[:20], sets[20:], 0.8)} == {(a, b) for a, b in want if a < 20 <= b}
    edges = {tuple(sorted((r.a, r.b))) for r in jaccard.links(frame, 0.8, tile=16).collect()}
    comps = lambda pairs: sorted(sorted(g) for g in groups(pairs, 50))
    assert edges <= want and comps(edges) == comps(want)


def groups(pairs, n):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    return [[i for i in range(n) if root[i] == r] for r in set(root)]


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9]
    assert jaccard.deduplicated(empty(spark)).count() == 0


def test_classes_of_large_tables_are_not_broadcast(spark):
    rows = spark.range(210_000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("first"))
    found = jaccard.alike(common.materialize(rows, "classes"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
