import numpy as np
import pytest

from meshloom.operators import krylov, substructure
from meshloom.operators.tables import Tables


def banded(seed, n, width, gaps=()):
    """A positive definite matrix with a contrast of 1e6 whose links are ``width`` apart at most, without the rows ``gaps``."""
    rng = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for d in (1, width - 1, width):
        v = -(10.0 ** rng.uniform(-3, 3, n - d))
        a += np.diag(v, d) + np.diag(v, -d)
    a += np.diag(-a.sum(1) + rng.uniform(0.01, 1, n))
    kept = np.setdiff1d(np.arange(n), gaps)
    return a[np.ix_(kept, kept)], rng.normal(size=(len(kept), 3)), kept


def frames(spark, a, kept, b, case=None):
    i, j = np.nonzero(a)
    of = lambda r: r if case is None else (case, *r)
    k = [of((int(kept[p]), int(kept[q]), float(a[p, q]))) for p, q in zip(i, j)]
    f = [(c if case is None else case, int(kept[p]), float(b[p, c])) for c in range(b.shape[1]) for p in range(len(kept))]
    head = "" if case is None else "case_id long, "
    return spark.createDataFrame(k, head + "row long, col long, v double"), spark.createDataFrame(f, "case_id long, row long, v double")


@pytest.mark.parametrize("n, per", [(16, 32), (100, 32), (256, 2), (300, 2), (304, 3), (330, 2)])
def test_strips_of_a_shared_matrix_with_many_loads(spark, monkeypatch, n, per):
    monkeypatch.setattr(substructure, "STRIP", per)
    a, b, kept = banded(n, n, 16, gaps=(3, 40, 63))
    u = substructure.solve(Tables(spark, "sub"), "x", *frames(spark, a, kept, b)).collect()
    want = np.linalg.solve(a, b)
    got = {(r.case_id, r.node_id): r.u for r in u}
    assert len(u) == len(got) == want.size
    assert all(abs(got[c, int(kept[p])] - want[p, c]) <= 1e-7 * abs(want).max() for p in range(len(kept)) for c in range(3))


@pytest.mark.parametrize("n", [9, 60, 150])
def test_each_case_its_own_matrix(spark, monkeypatch, n):
    monkeypatch.setattr(substructure, "STRIP", 2)
    systems = {c: banded(c, n, 8) for c in range(5)}
    tables = [frames(spark, a, kept, b[:, :1], c) for c, (a, b, kept) in systems.items()]
    k, f = tables[0]
    for p, q in tables[1:]:
        k, f = k.unionByName(p), f.unionByName(q)
    k = k.withColumn("case_id", k.case_id.cast("int"))  # as nations' numbers are
    f = f.withColumn("case_id", f.case_id.cast("int"))
    got = {}
    for r in substructure.solve(Tables(spark, "sub"), "x", k, f, 3).collect():
        got.setdefault(r.case_id, {})[r.node_id] = r.u
    for c, (a, b, _) in systems.items():
        want = np.linalg.solve(a, b[:, 0])
        assert np.allclose([got[c][i] for i in range(n)], want, rtol=1e-7, atol=1e-7 * abs(want).max())


def test_substructures_need_few_steps_where_the_diagonal_needs_many(spark):
    """Before, the steps of a badly conditioned system grew with its size: what made mesh_scale_cg run out of time."""
    a, b, kept = banded(7, 200, 16)
    k, f = frames(spark, a, kept, b[:, :1])
    out, report = krylov.solve_large(k, f.drop("case_id"), krylov.CgPolicy(relative=1e-9, most=50), krylov.exact(Tables(spark, "exact"), k))
    assert report["converged"] and report["iterations"] <= 3
    got = {r.node_id: r.u for r in out.collect()}
    want = np.linalg.solve(a, b[:, 0])
    assert all(abs(got[i] - want[i]) <= 1e-7 * abs(want).max() for i in range(200))


def grid(seed, rows, n, gaps=()):
    """The same on a mesh of rows of n nodes, linked to the eight around; the held ones ``gaps`` have no row."""
    rng = np.random.default_rng(seed)
    a = np.zeros((rows * n, rows * n))
    for r in range(rows):
        for c in range(n):
            for p, q in ((r, c + 1), (r + 1, c - 1), (r + 1, c), (r + 1, c + 1)):
                if p < rows and 0 <= q < n:
                    a[r * n + c, p * n + q] = a[p * n + q, r * n + c] = -(10.0 ** rng.uniform(-3, 3))
    a += np.diag(-a.sum(1) + rng.uniform(0.01, 1, len(a)))
    kept = np.setdiff1d(np.arange(len(a)), gaps)
    return a[np.ix_(kept, kept)], rng.normal(size=(len(kept), 3)), kept


@pytest.mark.parametrize("rows, n, gaps", [(13, 11, ()), (9, 17, (1, 20, 77)), (8, 8, range(8)), (5, 40, range(0, 200, 40)), (6, 12, range(0, 14))])
def test_wide_meshes_are_dissected_both_ways(spark, monkeypatch, rows, n, gaps):
    """Matrices are between the nodes around a region: before, each of many strips had one twice as wide as the mesh."""
    shift = 0 if 13 in gaps else 5  # the first row's first node must be known, or be numbered by the row's length
    monkeypatch.setattr(substructure, "LONG", 7)
    monkeypatch.setattr(substructure, "TILE", 4)
    a, b, kept = grid(n, rows, n, gaps)
    tables = Tables(spark, "sub")
    widest, write = [], Tables.write

    def seen(self, name, df):
        out = write(self, name, df)
        if "front" in name:
            widest.append(out.selectExpr("max(octet_length(ids)) / 8").first()[0])
        return out

    monkeypatch.setattr(Tables, "write", seen)
    u = substructure.solve(tables, "x", *frames(spark, a, kept + shift, b)).collect()
    want = np.linalg.solve(a, b)
    got = {(r.case_id, r.node_id): r.u for r in u}
    assert len(u) == len(got) == want.size
    assert all(abs(got[c, int(kept[p]) + shift] - want[p, c]) <= 1e-7 * abs(want).max() for p in range(len(kept)) for c in range(3))
    assert len(widest) > 2 and max(widest) < 2 * (rows + n)


def test_wide_meshes_of_each_case(spark, monkeypatch):
    monkeypatch.setattr(substructure, "LONG", 7)
    monkeypatch.setattr(substructure, "TILE", 4)
    monkeypatch.setattr(substructure, "SMALL", 1)
    systems = {c: grid(c, 10, 9) for c in range(3)}
    parts = [frames(spark, a, kept, b[:, :1], c) for c, (a, b, kept) in systems.items()]
    k, f = parts[0]
    for p, q in parts[1:]:
        k, f = k.unionByName(p), f.unionByName(q)
    got = {}
    for r in substructure.solve(Tables(spark, "sub"), "x", k, f, 3).collect():
        got.setdefault(r.case_id, {})[r.node_id] = r.u
    for c, (a, b, _) in systems.items():
        want = np.linalg.solve(a, b[:, 0])
        assert np.allclose([got[c][i] for i in range(90)], want, rtol=1e-7, atol=1e-7 * abs(want).max())
