import random
import re
from collections import Counter, defaultdict

from siltstone.llm import divergence

from .edge import edge_docs, empty, with_clashes


def slow(docs, least_docs=10, top=10):
    """Rows of the contract for (lang, source, text), over every pair and term."""
    n, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    rate = lambda c, total, v: 1 + 10**9 * (c + 2) // (total + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {x for x, _ in n}:
        kept = {t for t, c in held[lang].items() if c >= least_docs}
        groups = {s: c for (x, s), c in n.items() if x == lang}
        every = sum(groups.values(), Counter())
        of = lambda c: {t: rate(c[t], sum(c[k] for k in kept), len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: of(c) for s, c in groups.items()}, of(every)
        for s, c in groups.items():
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode()) for t in kept if c[t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


def corpus(seed, docs):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeÄéЖ" for b in "xyzw"]
    return [
        (rng.choice(["en", "de", None]), f"s{rng.randrange(5)}" if rng.random() < 0.6 else "hot", rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(40))))
        for _ in range(docs)
    ]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_against_every_pair_and_term(spark):
    docs = corpus(3, 400) + [("fr", "a", "un deux"), ("fr", "b", None), ("xx", "only", "word")]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    got = rows(divergence.audit(frame))
    assert got == slow(docs) and len(got) > 150
    assert ("fr", "a", "pair", "b", 0, 1) in got  # no kept terms
    assert rows(divergence.audit(frame, least_docs=2, top_terms=3)) == slow(docs, 2, 3)


def test_table_of_a_task_is_emptied(spark, monkeypatch):
    docs = corpus(5, 300)
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    inner = divergence.count_terms
    monkeypatch.setattr(divergence, "count_terms", lambda batches: inner(batches, most=20))
    assert rows(divergence.audit(frame)) == slow(docs)


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000
    row = spark.range(1).selectExpr(f"{big}L as n", f"{big + 7}L as total", "3L as v").select(divergence.rate("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (big + 7 + 6)


def test_edges(spark):
    docs = with_clashes(edge_docs(spark))
    assert rows(divergence.audit(docs, least_docs=1)) == slow([(r.lang, r.source, r.text) for r in docs.collect()], 1)
    assert divergence.audit(empty(spark)).count() == 0
