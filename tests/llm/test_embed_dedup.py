import numpy as np

from siltstone.llm import embed_dedup, queries


def slow(rows, threshold=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and i is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.sqrt(x[1] @ x[1]) / np.sqrt(y[1] @ y[1]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = dict(enumerate(range(len(good))))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, bs in links.items():
        for b in bs:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(good):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(links[k]), least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(good))


def test_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op7_embed_dedup(spark, sf_dir).collect())) == slow(rows)


def test_dense_groups_and_borderline_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):  # groups denser than the window, and pairs close to the threshold
        base = rng.normal(size=16)
        for _ in range(60 if c < 3 else 3):
            rows.append((base + rng.normal(size=16) * (0.12 if c < 3 else 0.3)).tolist())
    rows += [rng.normal(size=16).tolist() for _ in range(300)] + [rows[0]] * 30
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, embed_dedup.near_duplicates(frame, window=8, at_once=3).collect()))
    assert found == slow(rows)


def test_tiles(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 8)).astype("<f4")
    frame = spark.createDataFrame([(7, i, 1 + i % 3, bytearray(v.tobytes())) for i, v in enumerate(x)], "component long, rep long, copies long, raw binary")
    u = embed_dedup.unit([v.tobytes() for v in x], "<f4")
    hits = u @ u.T >= 0.2
    np.fill_diagonal(hits, False)
    want = dict(enumerate((hits @ (1 + np.arange(90) % 3)).tolist()))
    assert {r.rep: r.links for r in embed_dedup.link_counts(frame, "<f4", 0.2, tile=16).collect()} == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0], 1), (12, [1e300, 0.0], 1), (12, [1e300, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in odd], "vec_id long, embedding array<double>, label long, key string")
    found = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(frame).collect()}
    assert found == {(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, False)} | {(i, 0, i, True) for i in range(3, 12)}
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


def dense_label(n=3000, d=32, mean=0.85, seed=9):
    """Vectors of one label around a common direction, with planted pairs close to the threshold."""
    rng = np.random.default_rng(seed)
    away = lambda k: (x := rng.normal(size=(k, d - 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    turn = lambda a: np.c_[np.full(len(a), mean**0.5), (1 - mean) ** 0.5 * a]
    first = away(100)
    near = first + 0.85 * away(100)
    x = np.r_[turn(away(n)), turn(first), turn(near / np.linalg.norm(near, axis=1, keepdims=True))].astype("<f4")
    return x[rng.permutation(len(x))]


def check_dense(spark, x, **options):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = u @ u.T >= 0.93
    np.fill_diagonal(hits, False)
    root = np.arange(len(x))
    for a, b in zip(*np.nonzero(hits), strict=True):
        if root[a] != root[b]:
            root[root == max(root[a], root[b])] = min(root[a], root[b])
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(frame, **options).collect()}
    assert hits.sum() >= 100
    assert found == {i: (int(n), int(root[i])) for i, n in enumerate(hits.sum(axis=1))}


def test_dense_label(spark):
    check_dense(spark, dense_label())


def test_cells_of_a_label_too_large_to_compare_whole(spark):
    x = np.r_[dense_label(n=1200, mean=0.3), dense_label(n=1200, mean=0.0, seed=10)]
    classes = spark.createDataFrame([(i, "1", bytearray(v.tobytes())) for i, v in enumerate(x)], "rep long, label string, raw binary")
    chosen = embed_dedup.plan(classes, "<f4", 0, 0.93, 1e-5).collect()
    assert len(chosen) == 1 and chosen[0].passes == embed_dedup.passes_for(chosen[0].k, 0.93, 1e-5)
    for k in (2, 5):  # cells of several tiles and small ones
        dealt = classes.selectExpr("*", f"{k} k", f"{embed_dedup.passes_for(k, 0.93, 1e-5)} passes")
        found = embed_dedup.cell_edges(dealt, "<f4", 0, embed_dedup.passes_for(k, 0.93, 1e-5), 0.93, chunk=200)
        pairs = {tuple(sorted((r.a, r.b))) for r in found.collect()}
        u = embed_dedup.unit([v.tobytes() for v in x], "<f4")
        hits = np.argwhere(np.triu(u @ u.T >= 0.93, 1))
        want = set(map(tuple, hits.tolist()))
        assert pairs <= want and len(embed_dedup.forest(np.array(sorted(pairs)), len(x))) == len(embed_dedup.forest(hits, len(x)))
