"""Added spans against plain Python, and texts that are full of matches."""

import random
import re
import time

import numpy as np
import pytest

from siltstone.llm import boosting, common, pii

from .test_pii_quality import luhn, slow_base


def slow_features(kind, m, before, after):
    d = re.sub("[^0-9]", "", m)
    tail = re.search("([A-Za-z]+)$", m)
    tail = tail[1] if tail else ""
    parts = [p for p in re.split("[^0-9]+", m) if p]
    return [
        *[float(k == kind) for k in pii.KINDS], len(d), len(m), len(re.findall("[A-Za-z]", m)), m.count("."), m.count("-"), m.count(" "), bool(re.search(r"[\[\](){}<>]", m)), luhn(d),
        all(int(p) <= 255 for p in parts), len(tail), tail in ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"),
        bool(re.search(pii.CONTEXT[kind], before)), bool(re.search(pii.AGAINST, before)), bool(re.search("[A-Za-z0-9_/=-]$", before)), bool(re.search("^[A-Za-z0-9_/=-]", after)),
        bool(re.search("^(19|20)[0-9]{2}[^0-9]", m)), len(set(d)) or 1, bool(re.search(r"(?i)[a-z0-9]\x20at\x20", m)) and not re.search("(?i)dot", m),
    ]


def slow_spans(text, forest, limits):
    base, made = slow_base(text), []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.PROPOSALS[kind], text):
            s, e = m.span()
            if not any(b[1] < e and s < b[2] for b in base):
                p = boosting.predict(forest, np.array([slow_features(kind, m[0], text[max(0, s - 24) : s], text[e : e + 4])], np.float64))[0]
                if p >= limits[kind]:
                    made.append((-p, s, k, e, kind))
    kept = [c for c in made if not any(d < c and d[1] < c[3] and c[1] < d[3] for d in made)]
    return sorted(base + [(c[4], c[1], c[3]) for c in kept], key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))


def test_spans_against_brute_force(spark):
    r = random.Random(5)
    words = ["a", "mail", "order ", " tel ", "card ", "10.1.2.3", "10[.]1[.]2[.]3", "300.1.1.1", "(555) 123-4567", "555-123-4567", "0049 170 12345", "+49 170 1234567", "x(at)y[dot]com", "ab at cd dot org",
             "a.b@c.de", "q_w [at] er (dot) com", "4111 1111 1111 1111", "4111.1111.1111.1111", "3782 822463 10005", " ", " ", ", ", "\n", "é", "\U0001f600", "1", ".", "-"]
    texts = {i: "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randint(0, 30))) for i in range(600)}
    texts |= {1000 + i: t for i, t, *_ in pii.snippets(300, seed=3)}
    forest, limits = pii.model(spark)
    rows = pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == len(texts) and sum(len(x.spans) > 0 for x in rows) > 300
    for x in rows:
        assert x.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in slow_spans(texts[x.doc_id], forest, limits)), texts[x.doc_id]


def slow_redacted(text, spans):
    at, out = 0, ""
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], pii.KINDS.index(x[0]))):
        if s >= at:
            out += text[at:s] + f"[{k.upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_many_matches_in_one_text(spark):
    units = ["10.1.1.1 ", "é (555) 123-4567\n", "x 10.0.0.1@b.com \U0001f600 "]
    many = 100_000
    forest, limits = pii.model(spark)
    docs = spark.createDataFrame([(i, u * n) for i, u in enumerate(units) for n in (300, many)], "doc_id long, text string")
    start = time.time()
    rows = {(x.doc_id, len(x.spans) > 20_000): x.spans for x in pii.report(docs).collect()}
    texts = {(x.doc_id, len(x.text) > 20_000): x.text for x in pii.redacted(docs).collect()}
    assert time.time() - start < 240  # quadratic work would take hours
    for i, unit in enumerate(units):
        want = slow_spans(unit * 300, forest, limits)
        assert texts[i, False] == slow_redacted(unit * 300, want)
        got = [x.split(":") for x in rows.get((i, True), "").split(",") if x]
        assert abs(len(got) - len(want) // 300 * many) <= 2 * len(want) // 300 + 2
        assert texts[i, True] == slow_redacted(unit * many, [(k, int(s), int(e)) for k, s, e in got])


def test_running_totals(spark):
    from pyspark.sql import functions as F

    r = random.Random(0)
    rows = [(n, [r.randint(0, 9) for _ in range(n)]) for n in (0, 1, 127, 128, 129, 255, 256, 257, 1000)]
    frame = spark.createDataFrame(rows, "n int, v array<int>")
    for op, plain in ((lambda a, v: a + v, lambda a, v: a + v), (lambda a, v: F.greatest(a, v), max)):
        for x in frame.select("v", common.running(F.col("v"), op).alias("t")).collect():
            want = [0]
            for v in x.v:
                want.append(plain(want[-1], v))
            assert x.t == want


def test_cut_reaches_the_precision():
    p, y = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.5]), np.array([1, 1, 0, 1, 1, 0])
    assert pii.cut(p, y, 1.0) == pytest.approx(0.85) and pii.cut(p, y, 0.75) == pytest.approx(0.55)
    assert pii.cut(p, np.zeros(6), 0.5) == 2.0 and pii.cut(p[:0], y[:0]) == 2.0 and pii.cut(p, np.ones(6), 1.0) == 0.5
