"""Scores of the query against an independent fit: the same pairs, accelerated gradient descent, plain Python around it."""

import struct
import zlib

import numpy as np
from xxhash import xxh64_intdigest

from siltstone.llm import quality, queries


def slow_fit(x, good, ridge=1e-2, seed=7):
    z = np.concatenate([x, x * x], axis=1)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((z - mean) / scale, -8, 8)
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    rng = np.random.default_rng(seed)
    pairs = min(quality.FIT_PAIRS, 40 * max(len(better), len(worse)))
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    steep = np.linalg.eigvalsh(d.T @ d / pairs).max() / 4 + ridge
    rate = (np.sqrt(steep) - np.sqrt(ridge)) / (np.sqrt(steep) + np.sqrt(ridge))
    w = v = np.zeros(d.shape[1])
    for _ in range(8000):
        new = v - (ridge * v - (d / (1 + np.exp(d @ v))[:, None]).mean(axis=0)) / steep
        w, v = new, new + rate * (new - w)
        if np.abs(v - new).max() < 1e-9:
            break
    s = np.sort(z @ w)
    return mean, scale, w, (s[len(worse) - 1] + s[len(worse)]) / 2


def test_scores_against_an_independent_fit(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    order = lambda d: (h := xxh64_intdigest(struct.pack("<q", d), 42)) - (h >> 63 << 64)
    known = sorted((d for d in texts if d in labels and zlib.crc32(str(d).encode()) % 5), key=order)
    assert len(known) > 50
    x = np.array([quality.features(texts[d]) for d in known])
    mean, scale, w, cut = slow_fit(x, np.array([labels[d] for d in known]))
    rows = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for d, text in texts.items():
        f = np.array(quality.features(text))
        s = float(np.clip((np.concatenate([f, f * f]) - mean) / scale, -8, 8) @ w) - cut
        want = 1 / (1 + np.exp(-(s + np.log(0.3 / 0.7))))
        assert abs(rows[d].score - want) < 2e-3 and (rows[d].predicted == int(want >= 0.3) or abs(want - 0.3) < 2e-3)


def made_rows(spark, n, bad):
    """(feature table, labels, vectors and labels of the rows that aren't held out) of n vectors; the first ``bad`` are bad."""
    rng = np.random.default_rng(3)
    x = rng.random((n, quality.FEATURES)).round(6)
    x[:bad, 3] += 0.4
    rows = spark.createDataFrame([(i, 0, 0, v) for i, v in enumerate(x.tolist())], "doc_id long, key long, nth long, x array<double>")
    labels = spark.createDataFrame([(i, int(i >= bad)) for i in range(n)], "doc_id long, quality int")
    known = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    return rows, labels, x[known], np.array([int(i >= bad) for i in known])


def test_every_labelled_row_counts(spark):
    rows, labels, x, good = made_rows(spark, 27_000, 4_000)
    assert len(x) > 21_000
    model = quality.train(rows, labels)
    z = np.concatenate([x, x * x], axis=1)
    assert np.allclose(model["mean"], z.mean(axis=0), rtol=1e-12, atol=0) and np.allclose(model["scale"], z.std(axis=0), rtol=1e-9)
    s = np.sort(np.clip((z - model["mean"]) / model["scale"], -8, 8) @ model["w"])
    k = int((good == 0).sum())
    assert abs(model["cut"] - (s[k - 1] + s[k]) / 2) < 1e-9


def test_groups_hold_every_row_and_both_kinds(spark):
    rows, labels, x, good = made_rows(spark, 1000, 5)
    known = rows.join(labels, "doc_id").where(~quality.is_held_out())
    dealt = quality.grouped(known, len(x), int(good.sum()), 50).collect()
    groups = {r.g for r in dealt}
    bad = int((good == 0).sum())
    assert len(groups) > 10 and sum(r.quality for r in dealt) == good.sum()
    assert all(sum(r.g == g and r.quality == 0 for r in dealt) == bad for g in groups)
    model = quality.train(rows, labels, group=50)
    dealt_x = [(np.array([r.x for r in dealt if r.g == g]), np.array([r.quality for r in dealt if r.g == g]), g) for g in sorted(groups)]
    parts = [quality.pair_sums(quality.scaled(v, model["mean"], model["scale"]), y, model["w"], 7 + g) for v, y, g in dealt_x]
    pairs = sum(p[0] for p in parts)
    assert pairs == 40 * good.sum() and np.abs(sum(p[1] for p in parts) / pairs + 1e-2 * model["w"]).max() < 1e-6


def test_rank(spark):
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=300).tolist(), *[0.25] * 200, 1e300, -1e-300]
    frame = spark.createDataFrame([(v,) for v in values], "s double")
    for rank in (0, 1, 200, 260, 350, 500, 501):
        assert quality.at_rank(frame, len(values), rank, most_rows=10) == sorted(values)[rank]


def test_more_labels_than_are_broadcast(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    monkeypatch.setattr(quality, "few", lambda labels: False)
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == want and want
