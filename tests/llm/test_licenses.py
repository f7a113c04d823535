import random
import re

import pytest

from siltstone.llm import common, licenses, queries

from .edge import edge_docs, empty, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_base(text):
    """(places, labels) of the phrases, one word after the other."""
    words = words_of(text)
    found = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return sorted(i for i, _ in found), sorted({label for _, label in found})


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_labels(text, likeness=0.93):
    """Labels of the notices that some stretch of the text is like, of all stretches that could be; of two at one place the liker."""
    words, best = words_of(text), []
    for label, notice in licenses.NOTICES:
        want, found = words_of(notice), []
        for start in range(len(words)):
            if len(set(want) & set(words[start : start + len(want)])) < len(set(want)) * 0.7:
                continue
            for n in range(int(len(want) * 0.8), int(len(want) * 1.25) + 1):
                n = min(n, len(words) - start)
                like = 2 * slow_common(want, words[start : start + n]) / (len(want) + n)
                if like >= likeness:
                    found.append((like, -start, start, start + n, label))
        best += [max(found)] if found else []
    beats = lambda x, y: x[0] > y[0] and 2 * (min(x[3], y[3]) - max(x[2], y[2])) >= max(x[3] - x[2], y[3] - y[2])
    return {y[4]: y[0] for y in best if not any(beats(x, y) for x in best)}


def check(row, text):
    at, labels = slow_base(text)
    assert row.n_words == len(words_of(text)) and row.n_base == len(at)
    assert (row.first_word, row.last_word) == ((at[0], at[-1]) if at else (None, None))
    assert row.base_labels == ",".join(labels)
    assert set(labels) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1
    assert (row.score == 0) == (row.labels == "")
    return set(filter(None, row.labels.split(",")))


def test_given_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_licenses(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    seen = 0
    for r in rows:
        got = check(r, texts[r.doc_id])
        wanted = slow_labels(texts[r.doc_id])
        assert set(wanted) <= got and got - set(slow_base(texts[r.doc_id])[1]) <= set(wanted)
        seen += bool(got)
    assert seen >= 3


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[i : i + (kind > 0)] = ["zq%d" % rng.randrange(99)] if kind < 2 else []
    return words


def test_edited_notices(spark):
    """Notices with words changed, put in and left out, between other words, against every stretch tried by brute force."""
    rng = random.Random(4)
    filler = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = []
    for _, notice in licenses.NOTICES:
        want = words_of(notice)
        for edits in (0, len(want) // 30, len(want) // 12, len(want) // 3):
            docs.append(" ".join(filler(rng.randrange(20)) + edited(rng, want, edits) + filler(rng.randrange(20))))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    caught = missed = 0
    for r in rows:
        got, wanted = check(r, docs[r.doc_id]), slow_labels(docs[r.doc_id])
        assert got - set(slow_base(docs[r.doc_id])[1]) <= set(wanted)  # nothing that no stretch is like
        caught += len(got & set(wanted))
        missed += len(set(wanted) - got)
    assert caught > 30 and missed == 0


def test_copies_on_end_and_hot_text(spark):
    lines = ["Licensed under CC BY-NC 4.0."] * 3000 + ["Released under the MIT License!"] * 2
    text = "\n".join(lines)
    rows = licenses.scan(spark.createDataFrame([(1, text), (1, text), (2, "mit license " * 300_000)], "doc_id long, text string")).collect()
    one, again, two = sorted(rows, key=lambda r: r.doc_id)
    assert one == again and one.n_base == 3002 and one.labels == "cc-by,cc-by-nc-4.0,mit" and one.score == 1
    assert (two.n_base, two.first_word, two.last_word, two.n_words) == (300_000, 0, 599_998, 600_000)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    for r, d in zip(sorted(rows, key=str), sorted(docs.collect(), key=lambda d: str(d.doc_id)), strict=True):
        assert r.n_base == 0 and r.labels == "" and r.score == 0
    assert sorted(r.n_words for r in rows) == sorted(len(words_of(d.text)) for d in docs.collect())
    assert licenses.scan(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", "gnu", "a b c gnu general public license", "GNU/General-Public.License cc_by CC BY mit-license mit licenses"])
def test_runs_across_slices(spark, monkeypatch, text):
    """Slices of a few bytes give the same hits as whole texts."""
    whole = list(licenses.runs(iter([batch(text)]), [2, 4]))
    monkeypatch.setattr(common, "byte_chunks", spaced)
    parts = list(licenses.runs(iter([batch(text)]), [2, 4]))
    rows = lambda found: sorted((r["place"], r["hash"], r["n_words"] or -1) for b in found for r in b.to_pylist())
    n = len(words_of(text))
    assert rows(whole) == rows(parts) and len(rows(parts)) == 1 + max(0, n - 1) + max(0, n - 3)


def spaced(raw):
    """One word a slice."""
    at = 0
    for i in range(1, len(raw)):
        if raw[i : i + 1] == b" ":
            yield raw[at:i]
            at = i
    yield raw[at:]


def batch(text):
    import pyarrow as pa

    return pa.record_batch({"row": pa.array([5]), "doc_id": pa.array([1]), "text_hash": pa.array([9]), "text": pa.array([text])})
