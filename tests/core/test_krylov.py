import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import krylov
from meshloom.operators.solve import CgPolicy


def dense(seed, n, spread):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.4)
    return a @ a.T + np.diag(spread ** rng.random(n)), rng.normal(size=n)


def tables(spark, systems):
    k = [(c, i, j, float(a[i, j])) for c, (a, _) in systems.items() for i, j in zip(*np.nonzero(a))]
    f = [(c, i, float(b[i])) for c, (_, b) in systems.items() for i in range(len(b)) if b[i] != 0]
    schema = "case_id long, row long, col long, v double"
    return spark.createDataFrame([tuple(map(int, r[:3])) + r[3:] for r in k], schema), spark.createDataFrame([(int(c), int(i), v) for c, i, v in f], "case_id long, row long, v double")


def solution(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.case_id, {})[r.node_id] = r
    return out


def test_many_systems_of_their_own_are_solved_at_once(spark):
    systems = {c: dense(c, 3 + c % 9, 10.0 ** (c % 4)) for c in range(24)}
    systems[30] = (systems[3][0], np.zeros(len(systems[3][1])) + np.eye(len(systems[3][1]))[0])
    got = solution(krylov.conjugate_gradients(*tables(spark, systems)))
    assert set(got) == set(systems)
    for c, (a, b) in systems.items():
        want = np.linalg.solve(a, b)
        assert all(got[c][i].converged and abs(got[c][i].u - want[i]) <= 1e-8 * (1 + abs(want).max()) for i in range(len(b)))
    steps = {c: max(r.iterations for r in rows.values()) for c, rows in got.items()}
    assert len(set(steps.values())) > 3  # finished cases leave


def test_a_shared_matrix_a_start_and_no_load(spark):
    a, b = dense(5, 8, 100.0)
    k, f = tables(spark, {0: (a, b), 1: (a, -3 * b), 2: (a, b[::-1].copy())})
    shared = k.where("case_id = 0").drop("case_id")
    first = krylov.conjugate_gradients(shared, f)
    got = solution(first)
    for c, rhs in ((0, b), (1, -3 * b), (2, b[::-1])):
        assert np.allclose([got[c][i].u for i in range(8)], np.linalg.solve(a, rhs), atol=1e-8)
    again = krylov.conjugate_gradients(shared, f, start=first)
    assert all(r.iterations <= 2 for r in again.collect())
    # rows without a load, and a case whose load is zero
    zero = spark.createDataFrame([(7, 3, 0.0)], "case_id long, row long, v double")
    assert all(r.u == 0 and r.converged for r in krylov.conjugate_gradients(shared, zero).collect())


def test_systems_that_cannot_be_solved_give_nan_and_leave_the_others(spark):
    good = dense(1, 6, 10.0)
    singular = (np.array([[1.0, -1.0], [-1.0, 1.0]]), np.array([1.0, 1.0]))
    negative = (np.array([[-2.0, 0.0], [0.0, 1.0]]), np.array([1.0, 1.0]))
    got = solution(krylov.conjugate_gradients(*tables(spark, {0: good, 1: singular, 2: negative}), CgPolicy(relative=1e-11, most=8)))
    assert all(r.converged for r in got[0].values())
    for c in (1, 2):
        assert all(math.isnan(r.u) and not r.converged for r in got[c].values())
