import math

import numpy as np
import pytest

from meshloom.operators.gmres import gmres


def tables(spark, a, b):
    entries = [(int(i), int(j), float(a[i, j].real), float(a[i, j].imag)) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(entries, "row long, col long, re double, im double"), spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(b)], "row long, re double, im double")


def system(seed, n):
    rng = np.random.default_rng(seed)
    a = 0.3 * (rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))) * (rng.random((n, n)) < 0.4)
    return a + np.diag(2 + rng.random(n) + 1j * rng.normal(size=n)), rng.normal(size=n) + 1j * rng.normal(size=n)


@pytest.mark.parametrize("restart", [40, 6])
def test_complex_systems_are_solved_with_and_without_restarts(spark, restart):
    a, b = system(3, 10)
    x, report = gmres(*tables(spark, a, b), restart=restart)
    got = {r.node_id: complex(r.re, r.im) for r in x.collect()}
    assert report["converged"] and report["residual"] <= 1e-10
    assert np.allclose([got[i] for i in range(10)], np.linalg.solve(a, b), atol=1e-8)
    assert report["iterations"] <= 10 or restart == 6


def test_what_isnt_solved_is_nan_and_no_load_is_zero(spark):
    a = np.array([[1, 1], [1, 1]], complex)
    x, report = gmres(*tables(spark, a, np.array([1, 0], complex)))
    assert not report["converged"] and all(math.isnan(r.re) for r in x.collect())
    x, report = gmres(*tables(spark, a + np.eye(2), np.zeros(2, complex)))
    assert report["converged"] and report["iterations"] == 0 and all(r.re == r.im == 0 for r in x.collect())


def test_substructures_leave_a_step_or_two_and_no_definite_matrix_is_needed(spark):
    """Before, the inverse diagonal alone preconditioned, and steps grew with the mesh."""
    rng, n = np.random.default_rng(5), 90
    near = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) <= 5
    a = near * (rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n)))
    a += np.diag((12 + 1j) * np.where(np.arange(n) % 2, 1, -1))
    b = rng.normal(size=n) + 1j * rng.normal(size=n)
    x, report = gmres(*tables(spark, a, b), direct=True)
    got = {r.node_id: complex(r.re, r.im) for r in x.collect()}
    assert report["converged"] and report["iterations"] <= 2
    assert np.allclose([got[i] for i in range(n)], np.linalg.solve(a, b), atol=1e-8)
