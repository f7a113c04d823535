import zlib
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import mixing, packing, queries, token_blocks

from .edge import edge_docs, empty, with_clashes


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: inner.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("percentile", [0.5, 0.9, 1.0])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 255, 49408, 2**32 - 1):
            ids = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
            ids[:: 17] = rng.integers(0, 3)
            data, start = token_blocks.encode_blocks(ids, percentile)
            assert (token_blocks.decode_blocks(data, start, n) == ids).all()


def check_index(docs, ids_of, found):
    rows = sorted(((d, t) for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for d, t in rows:
        ids = [*ids_of(t), 2]
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_token_index(spark, sf_dir, ids_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_index(docs, ids_of, queries.op4_token_blocks(spark, sf_dir))


def test_token_index_edges(spark, ids_of):
    docs = edge_docs(spark)
    check_index(docs.select("doc_id", "text").collect(), ids_of, token_blocks.token_index(with_clashes(docs), queries.tokenizer_path(), segment_ids=100))
    assert token_blocks.token_index(empty(spark), queries.tokenizer_path()).count() == 0


def check_packing(docs, ids_of, rows, size):
    streams = defaultdict(list)
    for d, t in docs:
        streams[d].append([*ids_of(t), 1])
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for d, texts in streams.items():
        # repeated ids: each row's pieces have the crc of one of the texts at that place
        assert sum(r.length for r in pieces[d]) == sum(map(len, texts))
        for r in pieces[d]:
            assert any(len(t) == r.doc_tokens and crc(t[r.start : r.start + r.length]) == r.ids_crc32 for t in texts)
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at and r.length > 0
                at += r.length
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or (at < size and at & (at - 1) == 0)


def test_packing(spark, sf_dir, ids_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_packing(docs, ids_of, queries.op6_packing(spark, sf_dir).collect(), 2048)


def test_packing_edges(spark, ids_of):
    docs = edge_docs(spark).repartition(5)
    rows = packing.pack_documents(with_clashes(docs), queries.tokenizer_path(), size=64, open_windows=2, fan_in=2).collect()
    check_packing(docs.select("doc_id", "text").collect(), ids_of, rows, 64)
    assert packing.pack_documents(empty(spark), queries.tokenizer_path()).count() == 0


def test_mixing_follows_targets(spark, sf_dir):
    rows = queries.op10_mixing(spark, sf_dir).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = docs[r.doc_id].source
        taken[s] += r.taken
        goal[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert abs(sum(goal.values()) - sum(r["size"] for r in rows)) < 1e-3
    assert all(abs(taken[s] - goal[s]) <= 2 * largest[s] for s in goal)


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, None: 50, "e": 2000}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: 1 + i % 3 for i, k in enumerate(names)}
    goal, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:  # share, cap, share the excess again
        total, over = sum(weight[k] for k in free), 0.0
        for k in sorted(free, key=str):
            goal[k] += left * weight[k] / total
        for k in list(free):
            if goal[k] > 3 * sizes[k]:
                over += goal[k] - 3 * sizes[k]
                goal[k] = 3.0 * sizes[k]
                free.discard(k)
        left = over
    assert all(abs(found[k] - goal[k]) < 1e-6 for k in names)


def test_mixing_edges(spark):
    docs = with_clashes(edge_docs(spark))
    assert mixing.mix(docs).count() == docs.count()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    again = mixing.mixed_documents(docs)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(empty(spark)).count() == 0
