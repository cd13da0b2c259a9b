import math

import numpy as np
import pytest
from pyspark import cloudpickle

from meshloom.llm import negatives

MOST = (1 << 63) - 1


def brute(rows, every=100, k=5, m=10, low=30, high=90):
    top = 1.7976931348623157e308
    whole = lambda x: math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(top, x))
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    vs = {(i, y, tuple(whole(x) for x in v)) for i, v, y in rows if i is not None and y is not None and ok(v)}
    out = []
    for i, y, q in vs:
        if i % every:
            continue
        scored = sorted((-max(-MOST + 1, min(MOST, sum(a * b for a, b in zip(q, p)))), j, z) for j, z, p in vs if j != i and len(p) == len(q))
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            fit = [(t, n) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:m]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, y) for i, v, y in rows], "vec_id long, embedding array<double>, label int").repartition(5)


@pytest.mark.parametrize("first,part,lists", [(4, 1024, 1024), (1, 7, 5)])
def test_matches_brute_force(spark, first, part, lists, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST", first)
    monkeypatch.setattr(negatives, "PART", part)
    cloudpickle.register_pickle_by_value(negatives)  # workers see the settings
    rng = np.random.default_rng(part)
    centre = rng.normal(size=(12, 6))
    rows = [(i, (centre[i % 12] * 1.4 ** rng.integers(-3, 4) + 0.3 * rng.normal(size=6)).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [rows[0], rows[100]]  # equal vectors, repeated rows
    rows += [(3000 + i, [1.0] * 6, i % 2) for i in range(300)]  # a hot list, all scores tied
    rows += [(5000, None, 1), (None, [1.0] * 6, 1), (5100, [1.0] * 6, None), (5200, [float("nan")] * 6, 1), (5300, [None] * 6, 1), (5400, [0.0] * 6, 1), (5500, [1.0, 2.0], 1), (5501, [2.0, 2.0], 1), (5502, [1.5, 0.5], 0), (5600, [], 1), (5601, [], 0)]
    try:
        assert got(negatives.mined(table_of(spark, rows), lists=lists)) == brute(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(negatives)


def test_long_vectors_and_empty_tables(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [3e20, -2.0], 0), (2, [1e20, 5.0], 1), (3, [1.0, 2.0], 1), (100, [4e8, 3e9], 1), (4, [1e9, 3e9], 1), (5, [5e8, 1e9], 0), (200, [1e308, 1.0], 0), (6, [2.0, 1.0], 0), (7, [1.0, 0.25], 2)]
    table = table_of(spark, rows)
    assert got(negatives.mined(table)) == brute(rows)
    assert negatives.mined(table.limit(0)).count() == 0


def test_bounds_hold_and_skip_lists():
    rng = np.random.default_rng(4)
    centre = 300 * rng.normal(size=(16, 24))
    x = np.floor(centre[rng.integers(16, size=4000)] + 20 * rng.normal(size=(4000, 24)))
    c = negatives.centroids(x, 16)
    own = negatives.nearest(x, c)
    radius = np.array([np.sqrt(((x[own == j] - c[j]) ** 2).sum(1)).max(initial=0) for j in range(16)])
    middle, lower, upper = negatives.score_bounds(x[:50], c, radius)
    scores = negatives.products(x[:50], x)
    assert (scores <= upper[:, own]).all() and (scores >= lower[:, own]).all()
    least = -np.partition(-scores, 4, axis=1)[:, 4]
    every, none = np.full(50, MOST), np.full(50, -MOST)
    need = negatives.needed(middle, lower, upper, none, every, least, False)
    assert need.mean() < 0.5  # most lists lie strictly below the fifth score
    for i in range(50):
        assert need[i, own[scores[i] >= least[i]]].all()
    near = np.full(50, 10)
    assert negatives.needed(middle, lower, upper, -near, near, none, False).mean() < 1  # lists outside a window are skipped


def test_no_table_is_broadcast(spark, monkeypatch):
    """Before, lists of vectors whose file is small were collected on the driver: a file tells little of what it unpacks to."""
    plans = []
    write = negatives.Scratch.write

    def seen(self, name, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, name, df)

    monkeypatch.setattr(negatives.Scratch, "write", seen)
    rows = [(i, [math.sin(i), math.cos(i)], i % 3) for i in range(300)]
    out = negatives.mined(table_of(spark, rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert got(out) == brute(rows) and len(plans) > 8
    assert not any("Broadcast" in p for p in plans)
