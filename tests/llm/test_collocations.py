import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import collocations

from .edge import edge_docs, empty, with_clashes


def slow(docs, least, top=2000, inside=80):
    """Rows of the contract for (lang, text), by counting every phrase."""
    f = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                f[lang if lang is not None else "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        lost = {q[i : i + m] for q, c in often.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if 100 * c >= inside * often[q[i : i + m]]}
        rows = []
        for p, a in often.items():
            if p not in lost:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"Ümlaut{i}" for i in range(vocabulary)]
    text = lambda: "".join(rng.choice(words[: rng.choice([3, vocabulary])]) + rng.choice([" "] * 9 + ["\t", ". ", ",", "\n", " \r\n "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(docs)]


@pytest.mark.parametrize("places", [7, 100, 1 << 21])
def test_against_counting(spark, places):
    docs = corpus(places, 150, 12) + [("en", "a b c d e " * 400), ("en", "x" * 3000), (None, None)]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = [tuple(r) for r in collocations.mine(frame, least=5, places=places).collect()]
    want = slow(docs, 5)
    assert len(want) > 100 and sorted(got) == want


def test_top_of_a_language(spark):
    docs = corpus(1, 200, 9)
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame(docs, "lang string, text string"), least=3, top=10).collect()]
    assert sorted(got) == slow(docs, 3, top=10)


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    """A table in which every bit is set lets all pairs through; the sums still decide."""
    docs = corpus(2, 100, 10)
    monkeypatch.setattr(collocations, "bit_table", lambda pairs: np.full(16, -1, np.int64).view(np.uint64))
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame(docs, "lang string, text string"), least=4).collect()]
    assert sorted(got) == slow(docs, 4)


def test_many_languages_in_a_task(spark):
    docs = [(f"l{i % 150}", "one two three. one two") for i in range(600)]
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame(docs, "lang string, text string").coalesce(1), least=8).collect()]
    assert sorted(got) == slow(docs, 8) and len(got) == 150


def test_bitmaps_are_the_places():
    places = np.array([1, 2, 0, 2, 2] + [0] * 40 + [1], np.int32)
    word, block, mask = collocations.bitmaps(places)
    at = {(int(w), int(b) * collocations.WIDTH + i) for w, b, m in zip(word, block, mask, strict=True) for i in range(16) if int(m) >> i & 1}
    assert at == {(int(w), i) for i, w in enumerate(places) if w}
    for values in (block, np.zeros(0, np.int32)):
        assert (collocations.unsqueezed(collocations.squeezed(values), values.dtype) == values).all()
    for values in (mask, np.arange(1, 1 << 16, dtype=np.uint16), np.zeros(0, np.uint16)):
        assert (collocations.unsqueezed_masks(collocations.squeezed_masks(values)) == values).all()


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    got = [tuple(r) for r in collocations.mine(docs, least=2).collect()]
    assert sorted(got) == slow([(r.lang, r.text) for r in docs.collect()], 2)
    assert collocations.mine(empty(spark)).count() == 0
