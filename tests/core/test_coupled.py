import numpy as np
import pytest

from meshloom.operators import adjoint, coupled, mesh, physics
from meshloom.operators.tables import Tables


def test_state_and_gradient_agree_with_dense_solves_and_an_iteration_goes_on(spark):
    m = mesh.unit_square(spark, 2)
    rows = [(0, 2.0, 3e-3, 8.0, 0.5, 300.0), (1, 1.0, 1e-2, 0.0, 1.0, 290.0)]
    cases = spark.createDataFrame(rows, "case_id long, sigma double, alpha double, volts double, k double, t0 double")
    tables = Tables(spark, "test-coupled")
    with coupled.Coupled(cases, m, most=2, resume=tables) as cut:
        cut.solve()
        assert {r.case_id: r.converged for r in cut.progress.collect()} == {0: False, 1: True}
    with coupled.Coupled(cases, m, resume=Tables(spark, "", tables.root)) as problem:
        problem.solve()
        told = {r.case_id: r for r in problem.report().collect()}
        slopes = {r.case_id: r for r in problem.gradient().collect()}
    assert told[0].iterations > 2 and told[1].iterations == 1 and all(r.converged and r.charge < 1e-9 and r.heat < 1e-9 for r in told.values())
    dense = adjoint.Coupled.of(m, physics.side_nodes(m, "left", "right"))
    mean, none = np.full(dense.n, 1 / dense.n), np.zeros(dense.n)
    for i, sigma, alpha, volts, k, t0 in rows:
        p = {"sigma": sigma, "alpha": alpha, "k": k, "volts": volts, "t0": t0}
        assert told[i].rise_mean == pytest.approx(dense.functional(p, none, mean) - t0, abs=1e-7)
        for name, value in dense.gradient(p, none, mean).items():
            assert slopes[i][name] == pytest.approx(value, rel=1e-5, abs=1e-6)
    assert told[1].rise_max == 0 and told[1].power == 0


def test_a_batch_of_cases_has_the_gradients_of_each(spark):
    """Before, parameters were one case's numbers, and so were a worker's solves."""
    m = mesh.unit_square(spark, 2)
    dense = adjoint.Coupled.of(m, physics.side_nodes(m, "left", "right"))
    cases = [{"sigma": 2.0, "alpha": 3e-3, "k": 0.5, "volts": 8.0, "t0": 300.0}, {"sigma": 1.0, "alpha": 1e-2, "k": 1.0, "volts": 0.0, "t0": 290.0}]
    mean, some = np.full(dense.n, 1 / dense.n), np.arange(dense.n) / dense.n
    both = dense.gradient({n: np.array([c[n] for c in cases]) for n in dense.NAMES}, some, mean)
    for i, c in enumerate(cases):
        for name, value in dense.gradient(c, some, mean).items():
            assert both[name][i] == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_many_cases_in_one_file_are_dealt_to_tasks(spark, monkeypatch):
    """Before, a small file of cases was one task, however many they were; cases that fail don't touch their batch."""
    monkeypatch.setattr(physics.solve, "CASES", 16)
    m = mesh.unit_square(spark, 2)
    cases = spark.range(100, numPartitions=1).selectExpr("id AS case_id", "1.0D + id % 5 AS sigma", "0.003D AS alpha", "id / 10D AS volts", "CASE WHEN id = 7 THEN 0D ELSE 120D END AS k", "300.0D AS t0")
    found = physics.self_consistent(cases, m)
    assert found.rdd.getNumPartitions() == 7
    assert adjoint.coupled_gradients(cases.where("case_id <> 7"), m, physics.side_nodes(m, "left", "right")).rdd.getNumPartitions() == 7
    rows = {r.case_id: r for r in found.collect()}
    assert len(rows) == 100 and not rows[7].converged and np.isnan(rows[7].t_max)
    assert all(r.converged and r.heat < 1e-6 for i, r in rows.items() if i not in (0, 7)) and rows[0].t_max == 300
