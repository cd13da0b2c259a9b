import numpy as np
from pyspark.sql import functions as F

from meshloom.operators import mesh, project, substructure


def test_rule_is_exact_to_its_degree():
    for m in (1, 2, 3, 4):
        rule = np.array(project.triangle_rule(m))
        s, t, w = rule[:, 1], rule[:, 2], rule[:, 3] / 2
        for a in range(2 * m - 1):
            for b in range(2 * m - 1 - a):
                exact = float(np.prod([k / 1.0 for k in range(1, a + 1)]) * np.prod([k / 1.0 for k in range(1, b + 1)]) / np.prod([k / 1.0 for k in range(1, a + b + 3)]))
                assert abs((w * s**a * t**b).sum() - exact) < 1e-13


def test_projection_equals_dense_least_squares(spark):
    """A field that differs from cell to cell, and two cases of it."""
    g = mesh.geometry(mesh.unit_square(spark, 4)).cache()
    cases = spark.createDataFrame([(3, 1.0), (7, -2.0)], "case_id long, a double")
    points = project.quadrature_points(g, 4).crossJoin(cases).cache()
    field = {"p": F.col("a") * F.col("x") * F.col("x") * F.col("y"), "q": F.col("cell_id") * F.col("x") + F.col("a")}
    got = {(r.case_id, r.node_id): (r.p, r.q) for r in project.projected(g, points, field).collect()}
    n = g.selectExpr("max(greatest(n0, n1, n2))").first()[0] + 1
    rows = points.withColumns(field).select("case_id", "n0", "n1", "n2", "l0", "l1", "l2", "weight", "p", "q").toPandas()
    assert len(got) == 2 * n
    for case in (3, 7):
        part = rows[rows.case_id == case]
        hats = np.zeros((len(part), n))
        for k in range(3):
            hats[np.arange(len(part)), part[f"n{k}"]] += part[f"l{k}"]
        root = np.sqrt(part["weight"].to_numpy())[:, None]
        best, *_ = np.linalg.lstsq(root * hats, root * part[["p", "q"]].to_numpy(), rcond=None)
        assert np.allclose([got[case, i] for i in range(n)], best, atol=1e-9)


def test_wide_meshes_are_projected_by_tiles(spark, monkeypatch):
    """All loads of a shared matrix, on a mesh that is dissected both ways: before, strips had matrices twice as wide as the mesh."""
    monkeypatch.setattr(substructure, "LONG", 7)
    monkeypatch.setattr(substructure, "TILE", 4)
    used, tiles = [], substructure.tiles
    monkeypatch.setattr(substructure, "tiles", lambda *a: used.append(a[7]) or tiles(*a))
    m = mesh.unit_square(spark, 9)
    g = mesh.geometry(m)
    points = project.quadrature_points(g).crossJoin(spark.range(3).withColumnRenamed("id", "case_id"))
    fields = {"ex": F.col("case_id") + F.col("x"), "ey": 2.0 - F.col("case_id") * F.col("y")}
    rows = project.projected(g, points, fields).join(m.nodes, "node_id").collect()
    assert used == [6] and len(rows) == 300
    assert all(abs(r.ex - r.case_id - r.x) < 1e-9 and abs(r.ey - 2 + r.case_id * r.y) < 1e-9 for r in rows)
