import math

import numpy as np

from meshloom.llm import topk


def brute(rows, k=5, every=50):
    vs = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in vs:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, p)), j) for j, p in vs if j != i and len(p) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force_over_many_norms(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 1.6 ** rng.integers(-4, 9)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [rows[0], rows[50]]
    rows += [(2000, None), (None, [1.0] * 8), (2050, [float("nan")] * 8), (2100, [None] * 8), (2150, [1.0, 2.0]), (2151, [0.5, 1.0]), (2200, []), (2201, []), (2250, [0.0] * 8)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, bucket string").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, query_block=7).collect())
    assert got == brute(rows)
    assert topk.top_k(table.limit(0)).count() == 0


def test_very_long_vectors_are_multiplied_as_integers(spark):
    rows = [(0, [1e30, 1.0]), (50, [3.0, -2.0]), (1, [-1e30, 5.0]), (2, [1e30, 7.0]), (3, [2.0, 2.0]), (4, [1e308, 1e308]), (100, [0.0, 3e9]), (5, [1e9, 3e9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    big = {i: [int(math.floor(256 * x)) if abs(x) < 1e300 else int(1.7976931348623157e308) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        score = {i: max(-most + 1, min(most, sum(a * b for a, b in zip(big[q], v)))) for i, v in big.items() if i != q}
        want += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(score.items(), key=lambda t: (-t[1], t[0]))[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table).collect()) == sorted(want)


def test_pruning_saves_products():
    """Clustered vectors of several lengths: most pairs are never multiplied, and nothing is lost."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 32))
    p = (400 * (centre[rng.integers(20, size=8000)] + 0.1 * rng.normal(size=(8000, 32))) * 1.5 ** rng.integers(-6, 1, 8000)[:, None]).astype(np.int64)
    order = np.argsort(-(p**2).sum(1), kind="stable")
    p, ids = p[order], np.arange(8000)
    q = (400 * (centre[rng.integers(20, size=200)] + 0.1 * rng.normal(size=(200, 32)))).astype(np.int64)
    s = topk.Searcher(np.arange(10_000, 10_200), q, 5)
    for i in range(0, 8000, 500):
        s.block(ids[i : i + 500], p[i : i + 500])
    full = q @ p.T
    for r in range(200):
        assert s.who[r].tolist() == np.lexsort((ids, -full[r]))[:5].tolist()
    assert s.products < 0.2 * full.size, s.products / full.size


def test_blocks_keep_results():
    rng = np.random.default_rng(0)
    q, p = rng.integers(-256, 256, (30, 16)), rng.integers(-256, 256, (5000, 16))
    p[2500:] //= 20
    ids = np.arange(5000)
    s = topk.Searcher(np.arange(10_000, 10_030), q, 5)
    for i in range(0, 5000, 500):
        s.block(ids[i : i + 500], p[i : i + 500])
    full = q @ p.T
    for r in range(30):
        order = np.lexsort((ids, -full[r]))[:5]
        assert s.who[r].tolist() == order.tolist()
