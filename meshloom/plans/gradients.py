"""Registered queries of adjoint gradients, held against closed forms and central differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import adjoint, mesh, physics
from meshloom.plans.registry import SIZE_SQL, cell_k, cell_q, query, r9, sized, square_sql, table

SQUARE = 6


def ends_of(m, left: float, right: float):
    return m.nodes.where("x = 0 OR x = 1").select("node_id", F.when(F.col("x") == 0, left).otherwise(right).alias("value"))


@query("SELECT r.id % 3 AS case_id, r.id // 3 AS \"row\", round(CASE WHEN r.id // 3 = 0 THEN 1 / (2e0 + r.id % 3) ELSE 2 / 3e0 - 1 / (3 * (2e0 + r.id % 3)) END, 9) AS x, round(CASE WHEN r.id // 3 = 0 THEN (1 - 2 / 3e0) / (2e0 + r.id % 3) ELSE 2 / 3e0 END, 9) AS multiplier FROM range(6) r(id)")
def implicit_solve(spark, sf):
    """Two by two systems [[a, 0], [1, 3]] x = (1, 2) with cotangent (1, 2): states and multipliers."""
    c = spark.range(3).select(F.col("id").alias("case_id"))
    entry = lambda i, j, a, b, s: F.struct(F.lit(i).cast("long").alias("row"), F.lit(j).cast("long").alias("col"), a.alias("a"), F.lit(b).alias("b"), F.lit(s).alias("seed"))
    rows = c.select("case_id", F.inline(F.array(entry(0, 0, 2.0 + F.col("case_id"), 1.0, 1.0), entry(1, 0, F.lit(1.0), 0.0, 0.0), entry(1, 1, F.lit(3.0), 2.0, 2.0))))
    return adjoint.implicit_solve(rows).select("case_id", "row", F.round("x", 9).alias("x"), F.round("multiplier", 9).alias("multiplier"))


def mean_weight(m):
    n = m.nodes.count()
    return m.nodes.select("node_id", F.lit(1.0 / n).alias("w"))


@query("""SELECT 'k' AS parameter, round(-3 / 8e0 / 49 * sum(7 * x * (1 - x)), 9) AS gradient FROM (SELECT id / 6e0 AS x FROM range(7) t(id))
UNION ALL SELECT 'q', round(1 / 4e0 / 49 * sum(7 * x * (1 - x)), 9) FROM (SELECT id / 6e0 AS x FROM range(7) t(id)) UNION ALL SELECT 'left', 0.5 UNION ALL SELECT 'right', 0.5""")
def state_pullback(spark, sf):
    """d mean(T) by conductivity, source and both held ends; k = 2, q = 3."""
    m = mesh.unit_square(spark, SQUARE)
    s = adjoint.ScalarState(m, m.cells.select("cell_id", F.lit(2.0).alias("k"), F.lit(3.0).alias("q")), ends_of(m, 300.0, 310.0))
    cells, held = s.pullback(mean_weight(m))
    sides = held.join(m.nodes, "node_id").groupBy((F.col("x") == 0).alias("at")).agg(F.sum("d_value").alias("g"))
    one = cells.agg(F.sum("d_k").alias("k"), F.sum("d_q").alias("q")).select(F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("g")) for n in "kq"])))
    both = one.unionByName(sides.select(F.when(F.col("at"), "left").otherwise("right").alias("parameter"), "g"))
    # d_k sums over cells the derivative by each; the part of the ends' difference cancels in the mean
    return both.select("parameter", r9(F.col("g")).alias("gradient"))


@query(f"WITH {SIZE_SQL} SELECT 2 * n * n AS cells, 1.0 AS ratio FROM size")
def source_cotangent(spark, sf):
    """Derivatives by each cell's additive source on a mesh that grows with the parts: they predict the change that a step
    of the source makes, exactly, as the state is linear in it."""
    n = sized(spark, sf)
    m = mesh.unit_square(spark, n)
    coefficients = cell_k(spark, sf, 2 * n * n).join(cell_q(spark, sf, 2 * n * n), "cell_id")
    weight = mean_weight(m)
    extra = m.cells.select("cell_id", (1.0 + F.col("cell_id") % 5).alias("source"))
    a = adjoint.ScalarState(m, coefficients, ends_of(m, 300.0, 301.0))
    b = adjoint.ScalarState(m, coefficients, ends_of(m, 300.0, 301.0), extra)
    cells, _ = a.pullback(weight)
    told = cells.join(extra, "cell_id").agg(F.sum(F.col("d_q") * F.col("source")).alias("told"), F.count("*").alias("cells"))
    mean = lambda s, name: s.u.join(weight, "node_id").agg(F.sum(F.col("u") * F.col("w")).alias(name))
    one = told.crossJoin(mean(a, "before")).crossJoin(mean(b, "after"))
    return one.select("cells", F.round((F.col("after") - F.col("before")) / F.col("told"), 6).alias("ratio"))


@query("SELECT 'sigma' AS parameter, 0.25 AS gradient UNION ALL SELECT 'right', 3.0 UNION ALL SELECT 'left', -3.0")
def joule_pullback(spark, sf):
    """Power of sigma = 3 at 0.5 V across the unit square: V^2, 2 sigma V and its negative."""
    m = mesh.unit_square(spark, SQUARE)
    s = adjoint.CurrentState(m, m.cells.select("cell_id", F.lit(3.0).alias("k"), F.lit(0.0).alias("q")), ends_of(m, 0.0, 0.5))
    cells, held = s.pullback_joule(s.joule().select("cell_id", F.col("size").alias("w")))
    sides = held.join(m.nodes, "node_id").groupBy((F.col("x") == 0).alias("at")).agg(F.sum("d_value").alias("g"))
    out = cells.agg(F.sum("d_k").alias("g")).select(F.lit("sigma").alias("parameter"), "g").unionByName(sides.select(F.when(F.col("at"), "left").otherwise("right").alias("parameter"), "g"))
    return out.select("parameter", r9(F.col("g")).alias("gradient"))


@query("""WITH n AS (SELECT avg(x * (1 - x) / 2) AS m FROM (SELECT id / 6e0 AS x FROM range(7) t(id)))
SELECT 'sigma' AS parameter, round(0.25 / 4 * m, 9) AS gradient FROM n UNION ALL SELECT 'right', round(2 * 3 * 0.5 / 4 * m, 9) FROM n
UNION ALL SELECT 'k', round(-3 * 0.25 / 16 * m, 9) FROM n UNION ALL SELECT 'q', round(m / 4, 9) FROM n""")
def chained_pullback(spark, sf):
    """Mean temperature through Joule heat: by conductivity, voltage, thermal conductivity and source."""
    m = mesh.unit_square(spark, SQUARE)
    sigma = m.cells.select("cell_id", F.lit(3.0).alias("sigma"))
    thermal = m.cells.select("cell_id", F.lit(4.0).alias("k"), F.lit(0.0).alias("q"))
    e = adjoint.Electrothermal(m, sigma, ends_of(m, 0.0, 0.5), thermal, ends_of(m, 300.0, 300.0))
    d = e.pullback(mean_weight(m))
    one = d["sigma"].agg(F.sum("d_sigma").alias("g")).select(F.lit("sigma").alias("parameter"), "g")
    volts = d["potential"].join(m.nodes.where("x = 1"), "node_id").agg(F.sum("d_value").alias("g")).select(F.lit("right").alias("parameter"), "g")
    rest = d["thermal"].agg(F.sum("d_k").alias("k"), F.sum("d_q").alias("q")).select(F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("g")) for n in "kq"])))
    return one.unionByName(volts).unionByName(rest).select("parameter", r9(F.col("g")).alias("gradient"))


@query("SELECT s_suppkey AS case_id, p AS parameter, true AS agrees FROM supplier, (SELECT unnest(['sigma', 'alpha', 'k', 'volts', 't0']) AS p)")
def coupled_gradient(spark, sf):
    """The coupled problem of every supplier: the implicit adjoint agrees with central differences."""
    cases = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), (1.0 + F.col("s_nationkey")).alias("sigma"), F.lit(3e-3).alias("alpha"), F.lit(120.0).alias("k"), (1 + F.abs(F.col("s_acctbal")) / 1000).alias("volts"), F.lit(300.0).alias("t0"))
    m = mesh.unit_square(spark, 4)
    out = adjoint.coupled_gradients(cases, m, physics.side_nodes(m, "left", "right"))
    near = F.abs(F.col("gradient") - F.col("difference")) <= 2e-5 * F.abs("gradient") + 1e-6
    return out.select("case_id", "parameter", near.alias("agrees"))


@query("SELECT p_partkey AS cell_id, round(p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 * 3 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.25 * p_size * 7 ELSE 0 END, 9) AS value FROM part")
def affine_coefficients(spark, sf):
    """Coefficients that are affine in two parameters, a cell a part."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("value"))
    one = p.where("cell_id % 2 = 0").select("cell_id", F.lit("a").alias("name"), F.lit(0.5).alias("w"))
    two = p.where("cell_id % 3 = 0").select("cell_id", F.lit("b").alias("name"), (0.25 * F.col("value")).alias("w"))
    values = spark.createDataFrame([("a", 3.0), ("b", 7.0)], "name string, p double")
    return adjoint.affine_coefficients(p, one.unionByName(two), values).select("cell_id", F.round("value", 9).alias("value"))
