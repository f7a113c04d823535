import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import pii, quality, queries

from .edge import edge_docs, empty, with_clashes
from .test_jaccard import slow_kept
from .test_pii_quality import slow_base
from .test_tokens_packing import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """The input of each stage and the output of the last, as written and read again."""
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs.collect())
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs.collect()]


def test_quality_stage(staged, spark, sf_dir):
    before, after = staged[0], staged[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert set(after) <= set(before)
    kept = {r.doc_id for r in after}
    scored = {r.doc_id: r.predicted for r in queries.op3_quality(spark, sf_dir).collect()}
    assert kept == {d for d, p in scored.items() if p}
    good = [d for d, q in labels.items() if q == 1 and d in scored]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_dedup_stage(staged):
    before, after = staged[1], staged[2]
    kept, _ = slow_kept({r.doc_id: r.text for r in before})  # five words, Jaccard of 0.8 or more
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)


def test_pii_stage(staged, spark):
    before, after = {r.doc_id: r for r in staged[2]}, {r.doc_id: r for r in staged[3]}
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in before.values()], "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(docs).collect()}
    assert before.keys() == after.keys()
    for d, r in before.items():
        text, at, parts = r.text, 0, []
        for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in spans[d]), key=lambda x: (x[1], -x[2], pii.KINDS.index(x[0]))):
            if s >= at:
                parts += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        want = "".join(parts) + text[at:]
        assert after[d].text == want and after[d].n_chars == len(want) and not slow_base(after[d].text)
        assert after[d].lang == r.lang and after[d].source == r.source


def test_mix_stage(staged):
    before, after = staged[3], Counter(staged[4])
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    by_source = defaultdict(list)
    for r in before:
        by_source[r.source].append(r)
    sizes = {s: sum(map(size, rows)) for s, rows in by_source.items()}
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    low, high = 0.0, max(3 * sizes[s] / weight[s] for s in sizes)
    for _ in range(200):  # the level at which the capped shares use up all words
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    for s, rows in by_source.items():
        each = min(3 * sizes[s], low * weight[s]) / sizes[s]
        ordered = sorted(rows, key=lambda r: (size(r), r.doc_id))
        count = lambda i, u: min(3, math.floor((i + 1) * each + u) - math.floor(i * each + u))
        shift = int(hashlib.md5(f"{s}/mix".encode()).hexdigest()[:12], 16) / 2**48
        for i, r in enumerate(ordered):
            assert after[r] == count(i, shift) or min(abs(x * each + shift - round(x * each + shift)) for x in (i, i + 1)) < 1e-6


def test_pack_stage(staged):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(queries.tokenizer_path())
    docs = [(r.doc_id, r.text) for r in staged[4]]
    check_packing(docs, lambda t: inner.encode(t or "", add_special_tokens=False).ids, staged[5], 2048)


def test_run_equals_the_stages(staged, spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    count = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert count(rows) == count(staged[5]) and sum(r.length for r in rows) == sum(r.length for r in staged[5])


def test_stages_take_odd_tables(spark, sf_dir):
    for docs in (with_clashes(edge_docs(spark)), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == COLUMNS
            assert docs.isEmpty() == (out.count() == 0) or name == "quality"


def test_score_of_stage_is_the_operators(spark, sf_dir):
    x = np.array([quality.features("A text. Of some words, and more.")])
    model = quality.fit(np.array([[0.0] * quality.FEATURES, x[0]]), np.array([0, 1]))
    assert quality.score(x, model)[0] > 0.3
