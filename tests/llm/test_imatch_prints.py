"""Fingerprints and likenesses against plain Python."""

import math
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm import imatch

from .test_imatch import edited


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_terms(text):
    return {signed(xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\W_]+", text.lower())}


def slow_lexicon(texts, low, high):
    df = Counter(h for t in texts for h in slow_terms(t))
    a, b = max(2.0, len(texts) * math.exp(-high)), max(2.0, len(texts) * math.exp(-low))
    return {h for h, n in df.items() if a <= n <= b}


def slow_print(text, lexicon):
    every = slow_terms(text)
    kept = sorted(every & lexicon)
    if len(kept) < imatch.FEW:
        kept = sorted(every)
    out = []
    for width, at, subsets in imatch.LEVELS:
        for k in range(subsets):
            own = [h for h in kept if ((h % (1 << 64)) >> at) % (1 << width) == k]
            seed = 42
            for h in own:
                seed = xxh64_intdigest(struct.pack("<q", h), seed)
            out.append(signed(seed) % ((1 << 24) - 1) + 1 if own else 0)
    return out


def slow_likeness(a, b):
    if a == b:
        return 1.0
    parts, at = [], 0
    for _, _, subsets in imatch.LEVELS:
        parts.append([(x, y) for x, y in zip(a[at : at + subsets], b[at : at + subsets], strict=True) if x or y])
        at += subsets
    parts.append([(x, y) for x, y in zip(a, b, strict=True) if x or y])
    parts = [p for p in parts if p]
    large = [p for p in parts if len(p) >= imatch.LEAST] or parts
    return max((sum(x == y for x, y in p) / len(p) for p in large), default=0.0)


def test_prints_and_likeness_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10**9, ""), (10**9 + 1, "!!! ..."), (10**9 + 2, "one two"), (10**9 + 3, "one two")]
    rows = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    lexicon = slow_lexicon([t for _, t in docs], 2.3, 7.6)
    prints = {d: slow_print(t, lexicon) for d, t in docs}
    hexed = lambda p: "".join(f"{x:06x}" for x in p)
    order = sorted(docs, key=lambda x: -x[0])
    for i, (d, t) in enumerate(order):
        following, half = order[(i + 1) % len(order)], len(t) // 2
        changed = slow_print(t[: len(t) - half] + following[1][:half], lexicon)
        r = rows[d]
        assert r.fingerprint == hexed(prints[d]) and r.edited_fingerprint == hexed(changed), d
        assert r.near_edited == pytest.approx(slow_likeness(prints[d], changed)) and r.near_next == pytest.approx(slow_likeness(prints[d], prints[following[0]]))
    assert len(edited(docs)) == len(rows)


def test_lookup_is_exact(spark):
    lex = spark.range(3000).select(F.xxhash64("id").alias("h"))
    row, bits, buckets = imatch.lookup(lex)
    table = row.first().lex.table
    assert len(table) == buckets
    asked = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), imatch.place(F.xxhash64("id"), buckets).alias("at")).collect()
    assert {r.id for r in asked if r.h in table[r.at]} == set(range(3000))
    empty, _, one = imatch.lookup(lex.limit(0))
    assert one == 1 and empty.first().lex.table == [[]]
