import hashlib
import random
import re
import zlib

import numpy as np

from siltstone.llm import boosting, pii, quality, queries

from .edge import edge_docs, empty, with_clashes

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def check_rows(texts, rows):
    for r in rows:
        base = slow_base(texts[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id][:200], said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in pii.KINDS]
        every = [x.split(":") for x in r.spans.split(",") if x]
        every = [(k, int(s), int(e)) for k, s, e in every]
        assert set(base) <= set(every)
        assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))


def test_base_spans(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_rows(texts, rows)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0


def test_base_spans_of_hard_texts(spark):
    r = random.Random(2)
    alphabet = ["a", "b.", "@", ".", "-", "_", "1", "22", "255", "256", " ", "+", "(", ")", "\u0001", "é", "\U0001f600", "4111111111111111", "\n", "0000"]
    texts = {i: "".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for i in range(1500)}
    texts[9000], texts[9001], texts[9002], texts[9003] = "a" * 200_000, "1" * 100_000, "a." * 50_000 + "@" + "b." * 50_000, "1 " * 50_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_rows(texts, pii.report(docs).collect())


def test_added_spans(spark):
    texts = {
        1: "write to someone(at)example[dot]com now",
        2: "the host 10[.]20[.]30[.]40 is down",
        3: "call (555) 123-4567 today",
        4: "look at things.Then order 555-123-4567 of 2020-10-11",
        5: "they met at noon and the version 123 456 7890 was out",
        6: "visa card 3782.8224.6310.005 and mail a@b.com",
    }
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[1].spans == "email:9:35" and rows[2].spans == "ip:9:26" and rows[3].spans == "phone:5:19"
    assert rows[4].spans == "" and rows[5].spans == ""
    assert "email:38:45" in rows[6].spans


def test_forest_matches_its_column(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x, y, rounds=30)
    p = boosting.predict(model, x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.9
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").select("i", boosting.as_column(model, F.col("x")).alias("p"))
    assert all(abs(r.p - p[r.i]) < 1e-9 for r in found.collect())


def test_selection_holds_on_other_snippets(spark):
    made = pii.snippets(800, seed=99)
    found = pii.report(spark.createDataFrame([(i, t) for i, t, *_ in made], "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in found}
    good = [i for i, _, _, _, k in made if k >= 0]
    bad = [i for i, _, _, _, k in made if k < 0]
    assert sum(bool(spans[i]) for i in good) / len(good) > 0.8
    # without a base span nothing should be said about the others
    assert sum(bool(spans[i]) and not slow_base(made[i][1]) for i in bad) / len(bad) < 0.1


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail é a.b@c.de, call +1 (555) 123-4567.", 0), (2, None, 0), (3, "", 0), (4, "x 10.0.0.1@b.com", 0)], "doc_id long, text string, pii int")
    rows = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert rows[1].text == "mail é [EMAIL], call [PHONE]." and rows[2].text is None and rows[3].text == ""
    assert rows[4].text == "x [EMAIL]" and pii.redacted(docs).columns == docs.columns


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op5_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_pii_edges(spark):
    docs = with_clashes(edge_docs(spark))
    assert pii.report(docs).count() == docs.count() and pii.report(empty(spark)).count() == 0
    assert pii.redacted(docs).columns == docs.columns


def test_quality_held_out(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in held) >= 0.9 * len(held)


def test_quality_edges(spark, sf_dir):
    docs = with_clashes(edge_docs(spark))
    labels = spark.createDataFrame([(7, 1), (1, 0), (None, 1), (999, 0), (4, None)], "doc_id long, quality int")
    assert quality.scores(docs, labels).count() == docs.count()
    assert {r.score for r in quality.scores(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.scores(empty(spark), labels).count() == 0 and quality.accepted(empty(spark), labels).count() == 0
    assert quality.scores(docs, labels.limit(0)).count() == docs.count()
