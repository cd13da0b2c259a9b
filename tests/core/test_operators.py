import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import elements as el
from meshloom.functions import scalars as sc
from meshloom.operators import assembly as asm
from meshloom.operators import evidence, krylov, mesh, physics, solve, transfer
from meshloom.sources import materials


def one(df):
    return df.withColumn("case_id", F.lit(0).cast("long"))


def test_generated_meshes_are_valid(spark):
    square, box = mesh.unit_square(spark, 3), mesh.tet_box(spark, 2, 1, 2)
    mesh.validate(square)
    assert (square.nodes.count(), square.cells.count(), square.facets.count()) == (16, 18, 12)
    q = mesh.quality(box).first()
    assert q.cells == 24 and q.inverted == 0 and q.measure == pytest.approx(1)


@pytest.mark.parametrize("broken", ["repeat", "missing", "flat", "facet", "infinite"])
def test_broken_meshes_are_rejected(spark, broken):
    m = mesh.unit_square(spark, 2)
    if broken == "repeat":
        m.cells = m.cells.withColumn("nodes", F.when(F.col("cell_id") == 0, F.array(F.lit(0), F.lit(0), F.lit(1)).cast("array<long>")).otherwise(F.col("nodes")))
    if broken == "missing":
        m.nodes = m.nodes.where("node_id <> 4")
    if broken == "flat":
        m.nodes = m.nodes.withColumn("y", F.lit(0.0))
    if broken == "facet":
        m.facets = m.facets.where("facet_id <> 3")
    if broken == "infinite":
        m.nodes = m.nodes.withColumn("x", F.when(F.col("node_id") == 0, float("inf")).otherwise(F.col("x")))
    with pytest.raises(mesh.ContractError):
        mesh.validate(m)


def test_quadratic_heat_is_exact_at_the_nodes(spark):
    m = mesh.unit_square(spark, 8)
    g = mesh.geometry(m)
    fixed = m.nodes.where("x = 0 or x = 1").select("node_id", F.lit(0.0).alias("value"))
    k, f = asm.dirichlet(asm.stiffness(g, F.lit(1.0)), asm.load(g, F.lit(2.0)), fixed)
    out = solve.solve_cases(one(k), one(f)).join(m.nodes, "node_id").toPandas()
    assert out.converged.all() and abs(out.u - out.x * (1 - out.x)).max() < 1e-13


def test_table_solver_agrees_and_reports_its_residual(spark, tmp_path):
    m = mesh.unit_square(spark, 4)
    g = mesh.geometry(m)
    fixed = m.nodes.where("x = 0 or x = 1").select("node_id", F.lit(0.0).alias("value"))
    k, f = asm.dirichlet(asm.stiffness(g, F.lit(1.0)), asm.load(g, F.lit(2.0)), fixed)
    u, report = krylov.solve_large(k, f)
    out = u.join(m.nodes, "node_id").toPandas()
    assert report["converged"] and abs(out.u - out.x * (1 - out.x)).max() < 1e-9


def test_singular_systems_fail_closed(spark):
    k = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, -1.0), (0, 1, 0, -1.0), (0, 1, 1, 1.0)], "case_id long, row long, col long, v double")
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "case_id long, row long, v double")
    assert all(math.isnan(r.u) and not r.converged for r in solve.solve_cases(k, f).collect())


def test_tet4_robin_heat_has_the_published_error(spark):
    n = 2
    m = mesh.tet_box(spark, n, n, n)
    g = mesh.geometry(m)
    rim = mesh.boundary_facets(m).withColumn("facet_id", F.col("cell_id") * 4 + F.col("local"))
    top = rim.select("facet_id", F.explode("nodes").alias("node_id")).join(m.nodes, "node_id").groupBy("facet_id").agg(F.min("z").alias("z")).where("z = 1")
    rm, rf = asm.robin(asm.facet_measure(rim.join(top, "facet_id", "left_semi"), m.nodes), F.lit(6.0), F.lit(300.0))
    # volume heat 3 and the current's Joule heat 2 make 5
    k, f = asm.add(asm.stiffness(g, F.lit(4.0)), rm), asm.add(asm.load(g, F.lit(5.0)), rf)
    k, f = asm.dirichlet(k, f, m.nodes.where("z = 0").select("node_id", F.lit(300.0).alias("value")))
    out = solve.solve_cases(one(k), one(f)).join(m.nodes, "node_id").toPandas()
    s = 5 * (1 + 6 / 8) / 10
    rms = float(np.sqrt(((out.u - (300 + s * out.z - 5 * out.z**2 / 8)) ** 2).mean()))
    assert rms == pytest.approx(1.546857e-2, rel=1e-5)


def test_te10_has_the_published_error(spark):
    exact = math.sqrt((2 * math.pi * 1e14 / physics.LIGHT) ** 2 - (math.pi / 2e-6) ** 2)
    out = physics.port_modes(mesh.unit_square(spark, 4, 2e-6, 1e-6), 1e14).toPandas()
    assert abs(out.beta_re[0] / exact - 1) == pytest.approx(1.09077e-3, rel=1e-4)
    assert (out.beta_re[1:].abs() < 1).all() and (out.residual < 1e-8).all()


def test_joule_power_and_balance(spark):
    m = mesh.unit_square(spark, 4)
    phi = m.nodes.select("node_id", (2.0 * F.col("x")).alias("u"))
    out = physics.joule(m, phi, m.cells.select("cell_id", F.lit(3.0).alias("sigma"))).agg(F.sum(F.col("heat") * F.col("size"))).first()[0]
    assert out == pytest.approx(12)
    g = mesh.geometry(m)
    fixed = m.nodes.where("x = 0 or x = 1").select("node_id")
    u = m.nodes.select("node_id", (F.col("x") * (1 - F.col("x"))).alias("u"))
    assert physics.balance(asm.stiffness(g, F.lit(1.0)), asm.load(g, F.lit(2.0)), u, fixed).first().imbalance < 1e-12


def test_self_consistent_heating_cools_the_conductor(spark):
    cases = spark.createDataFrame([(1, 100.0, 3e-3, 1.0, 120.0, 300.0), (2, 100.0, 0.0, 1.0, 120.0, 300.0)], "case_id long, sigma double, alpha double, volts double, k double, t0 double")
    out = {r.case_id: r for r in physics.self_consistent(cases, mesh.unit_square(spark, 4)).collect()}
    assert out[1].converged and out[2].t_max == pytest.approx(300 + 100 / 240 * 0.25) and out[1].t_max < out[2].t_max


def test_points_outside_are_missing_and_shared_edges_take_the_first_cell(spark):
    m = mesh.unit_square(spark, 2)
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 2.0, 0.5), (2, 0.25, 0.25)], "point_id long, u double, v double")
    out = {r.point_id: r.cell_id for r in transfer.located(m, points).collect()}
    assert out == {0: 0, 2: 0}


def test_yee_grid_and_components(spark, tmp_path):
    axes = spark.createDataFrame([(a, i, float(i)) for a in "xyz" for i in range(3)], "axis string, idx int, coord double")
    out = transfer.yee_points(axes)
    assert out.count() == 6 * 8 and out.where("comp = 'Ex' and i = 0 and j = 0 and k = 0").first().x == 0.5
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 6), (8, 6)], "lo long, hi long")
    assert {r.node_id: r.root for r in mesh.components(spark, edges, str(tmp_path)).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 8: 5}


def test_scalar_laws(spark):
    df = spark.createDataFrame([(1.55,), (9.0,)], "x double")
    n = df.where("x < 2").select(sc.sellmeier(F.col("x"))).first()[0]
    assert n == pytest.approx(1.4440236217032607, abs=1e-15)
    with pytest.raises(Exception, match="validity range"):
        df.select(sc.sellmeier(F.col("x"))).collect()
    assert math.isnan(df.select(sc.table_value(F.col("x"), [0.0, 2.0], [0.0, 1.0], fail=False)).collect()[1][0])
    z = sc.Complex(F.lit(-4.0), F.lit(0.0)).sqrt()
    assert df.select(z.re, z.im).first() == (0.0, 2.0)
    w = (sc.Complex(F.lit(1.0), F.lit(2.0)) * sc.Complex(F.lit(3.0), F.lit(-1.0))).conj()
    assert df.select(w.re, w.im).first() == (5.0, -5.0)


def test_evidence(spark):
    rows = spark.createDataFrame([(p, o, float(p + o)) for p in range(3) for o in range(4)], "process int, ordinal int, value double")
    assert evidence.rollup(rows, 3).first() == (4, 3.5, 5.0, True)
    assert not evidence.rollup(rows.where("process < 2 or ordinal > 0"), 3).first().complete
    checks = spark.createDataFrame([("a", True, True), ("b", False, False)], "name string, required boolean, passed boolean")
    assert evidence.publishable(checks).first().publishable
    assert evidence.digest({"b": 1, "a": [1.5, "é"]}) == evidence.digest({"a": [1.5, "é"], "b": 1})
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            materials.Strict().decode(bad)


def test_element_identities(spark):
    g = mesh.geometry(mesh.tet_box(spark, 1, 1, 1))
    k = asm.stiffness(g, F.lit(1.0))
    d = asm.diagnostics(k).first()
    assert d.asymmetry < 1e-12 and d.row_sum < 1e-12
    assert asm.mass(g, F.lit(1.0)).agg(F.sum("v")).first()[0] == pytest.approx(1)
    assert g.select(F.max(el.mean_ratio(g))).first()[0] <= 1 + 1e-12
