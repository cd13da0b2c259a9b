"""Further registered queries: contracts, set operations, transfers, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions import elements as el
from meshloom.functions import scalars as sc
from meshloom.operators import assembly as asm
from meshloom.operators import contracts, krylov, mesh, physics, transfer
from meshloom.plans.registry import EDGES_SQL, GK_SQL, N, STIFF_SQL, box_sql, dot, pair_sql, query, r9, square_sql, square_with_tables, table


@query(f"WITH {square_sql()} SELECT node_id FROM nodes WHERE x > 0 AND x < 1")
def free_nodes(spark, sf):
    m = mesh.unit_square(spark, N)
    return contracts.free_nodes(m, contracts.constraints(m, {"left": 300.0, "right": 301.0}))


@query(f"""WITH {square_sql()}, {EDGES_SQL}, rim AS (SELECT lo, hi, min(cell_id) AS cell_id FROM ce GROUP BY 1, 2 HAVING count(*) = 1)
SELECT lo, hi, rim.cell_id, CAST(list_position([n0, n1, n2], lo) - 1 AS INTEGER) AS at_lo, CAST(list_position([n0, n1, n2], hi) - 1 AS INTEGER) AS at_hi FROM rim JOIN cells USING (cell_id)""")
def facet_cell_map(spark, sf):
    m = mesh.unit_square(spark, N)
    rows = contracts.facet_cells(m).join(m.facets, "facet_id")
    swap = F.col("nodes")[0] > F.col("nodes")[1]
    at = lambda i, j: F.when(swap, F.col("positions")[j]).otherwise(F.col("positions")[i])
    return rows.select(F.array_min("nodes").alias("lo"), F.array_max("nodes").alias("hi"), "cell_id", at(0, 1).alias("at_lo"), at(1, 0).alias("at_hi"))


@query(f"SELECT r.id AS cell_id, CASE WHEN r.id % 2 = 0 THEN coalesce(h, 0.0) ELSE 0.0 END AS heat FROM range({2 * N * N}) r(id) LEFT JOIN (SELECT 2 * (s_suppkey % {N * N}) AS c, max(abs(s_nationkey) * 1e0) AS h FROM supplier GROUP BY 1) s ON s.c = r.id")
def parent_transfer(spark, sf):
    """Heat of a conductor's cells on their parents in the thermal mesh, zero on the others."""
    heat = table(spark, sf, "supplier").groupBy((2 * F.pmod("s_suppkey", F.lit(N * N))).alias("parent_cell_id")).agg(F.max(F.abs("s_nationkey").cast("double")).alias("heat"))
    return contracts.transferred(mesh.unit_square(spark, N).cells.select("cell_id"), heat)


@query(f"""WITH {square_sql()}, {EDGES_SQL}, r AS (SELECT unnest([lo, hi]) AS n, lo, hi FROM ce GROUP BY lo, hi HAVING count(*) = 1),
d AS (SELECT 0 AS kind, node_id AS a, node_id AS b FROM nodes WHERE node_id NOT IN (SELECT n FROM r) UNION ALL
  SELECT 1, lo, hi FROM (SELECT lo, hi FROM ce GROUP BY 1, 2 HAVING count(*) = 2))
SELECT kind, a AS lo, b AS hi, row_number() OVER (ORDER BY kind, a, b) - 1 AS dof FROM d""")
def mixed_dof_partition(spark, sf):
    """Free dofs of a closed guide: nodes first, then edges, numbered in order."""
    m = mesh.unit_square(spark, N)
    edges, ce = mesh.edge_map(m)
    rim = ce.groupBy("edge_id").count().where("count = 1").join(edges, "edge_id")
    nodes = m.nodes.select("node_id").join(rim.select(F.explode(F.array("lo", "hi")).alias("node_id")), "node_id", "left_anti").select(F.lit(0).alias("kind"), F.col("node_id").alias("lo"), F.col("node_id").alias("hi"))
    inner = edges.join(rim, "edge_id", "left_anti").select(F.lit(1).alias("kind"), "lo", "hi")
    return mesh.numbered(nodes.unionByName(inner), ["kind", "lo", "hi"], "dof").select("kind", "lo", "hi", "dof")


@query(f"""WITH {box_sql(2, 2, 2)}, f AS (SELECT cell_id, unnest([n0, n0, n0, n1]) AS a, unnest([n2, n1, n3, n2]) AS b, unnest([n1, n3, n2, n3]) AS c FROM cells),
k AS (SELECT list_sort([a, b, c]) AS key, min(cell_id) AS cell_id FROM f GROUP BY 1 HAVING count(*) = 1) SELECT key[1] AS a, key[2] AS b, key[3] AS c, cell_id FROM k""")
def tet_boundary(spark, sf):
    rows = mesh.boundary_facets(mesh.tet_box(spark, 2, 2, 2)).select(F.array_sort("nodes").alias("key"), "cell_id")
    return rows.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), F.col("key")[2].alias("c"), "cell_id")


@query(f"""WITH {box_sql(2, 2, 2)} SELECT cell_id, {", ".join("round(" + " + ".join(f"g{k}{a} * (2 * x{k} + 3 * y{k} * y{k} - z{k})" for k in range(4)) + f", 9) + 0.0 AS d{a}" for a in "xyz")} FROM g""")
def tet4_gradient(spark, sf):
    m = mesh.tet_box(spark, 2, 2, 2)
    field = m.nodes.withColumn("u", 2 * F.col("x") + 3 * F.col("y") * F.col("y") - F.col("z"))
    g = mesh.geometry(m, field, ["u"])
    return g.select("cell_id", *[r9(v).alias(f"d{a}") for a, v in el.gradient(g, "u").items()])


@query(f"""WITH {square_sql()} SELECT n AS "row", round(sum(v), 12) + 0.0 AS v FROM (SELECT unnest([n0, n1, n2]) AS n,
  unnest([{", ".join("area / 12.0 * (" + " + ".join(f"{1 + (i == j)} * (1 + x{j} + 2 * y{j})" for j in range(3)) + ")" for i in range(3))}]) AS v FROM g) GROUP BY 1""")
def nodal_source(spark, sf):
    """Consistent load M q of a source given at the nodes."""
    m = mesh.unit_square(spark, N)
    x = m.nodes.select("node_id", (1 + F.col("x") + 2 * F.col("y")).alias("u"))
    return asm.matvec(asm.mass(mesh.geometry(m), F.lit(1.0)), x).select("row", (F.round("v", 12) + 0.0).alias("v"))


@query(f"""{STIFF_SQL} SELECT "row", round(sum(abs(v)), 9) AS absolute, round(max(CASE WHEN "row" = col THEN v END), 9) AS diagonal FROM k1 GROUP BY 1""")
def row_norms(spark, sf):
    """Row sums of magnitudes for equilibration, and the Jacobi diagonal."""
    _, g = square_with_tables(spark, sf)
    k = asm.stiffness(g, F.col("k"))
    return k.groupBy("row").agg(F.round(F.sum(F.abs("v")), 9).alias("absolute"), F.round(F.max(F.when(F.col("row") == F.col("col"), F.col("v"))), 9).alias("diagonal"))


@query("SELECT round(sum(c_acctbal * (c_custkey % 10)), 4) AS dot, round(sqrt(sum(c_acctbal * c_acctbal)), 6) AS norm FROM customer")
def global_dot(spark, sf):
    return table(spark, sf, "customer").agg(F.round(F.sum(F.col("c_acctbal") * (F.col("c_custkey") % 10)), 4).alias("dot"), F.round(F.sqrt(F.sum(F.col("c_acctbal") * F.col("c_acctbal"))), 6).alias("norm"))


@query(f"""WITH {square_sql(4)}, f AS (SELECT id AS node_id, (id % 9) / 8e0 AS x, (id // 9) / 8e0 AS y FROM range(81) t(id)),
h AS (SELECT f.node_id, cell_id, n0, n1, n2, g0x * (f.x - x1) + g0y * (f.y - y1) AS w0, g1x * (f.x - x2) + g1y * (f.y - y2) AS w1, g2x * (f.x - x0) + g2y * (f.y - y0) AS w2 FROM f, g),
b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cell_id) AS k FROM h WHERE least(w0, w1, w2) >= -1e-12)
SELECT * FROM (SELECT node_id AS fine, unnest([n0, n1, n2]) AS coarse, round(unnest([w0, w1, w2]), 9) + 0.0 AS w FROM b WHERE k = 1) WHERE w <> 0""")
def prolongation(spark, sf):
    return transfer.prolongation(mesh.unit_square(spark, 8), mesh.unit_square(spark, 4)).select("fine", "coarse", r9(F.col("w")).alias("w"))


@query("""SELECT event_id, round(CASE WHEN value > 245 THEN sqrt(value) ELSE 0 END, 9) AS re, round(CASE WHEN value > 245 THEN 0 ELSE sqrt(value) END, 9) AS im FROM events""")
def propagation_branch(spark, sf):
    """beta = sqrt(-lambda) with positive real part, or zero real and positive imaginary part."""
    lam = F.when(F.col("value") > 245, -F.col("value")).otherwise(F.col("value"))
    root = sc.Complex(-lam, F.lit(0.0)).sqrt()
    return table(spark, sf, "events").select("event_id", r9(root.re).alias("re"), r9(root.im).alias("im"))


@query("""WITH e AS (SELECT user_id % 50 AS mode, event_id, value FROM events) SELECT mode, arg_max(event_id, (round(value, 6), -event_id)) AS anchor FROM e GROUP BY 1""")
def mode_anchor(spark, sf):
    """The largest entry of each mode, the first of equal ones."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("mode"), "event_id", F.round("value", 6).alias("v"))
    return rows.groupBy("mode").agg(F.min(F.struct((-F.col("v")).alias("v"), "event_id")).alias("m")).select("mode", F.col("m.event_id").alias("anchor"))


@query("SELECT p_partkey, lower(trim(p_brand)) AS id FROM part WHERE lower(trim(p_brand)) IN (SELECT min(lower(trim(p_brand))) FROM part UNION ALL SELECT max(lower(trim(p_brand))) FROM part)")
def material_lookup(spark, sf):
    """Lookup by trimmed, case-folded name, exact only."""
    parts = table(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_brand")).alias("id"))
    wanted = parts.agg(F.min("id").alias("a"), F.max("id").alias("b")).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return parts.join(wanted, "id").select("p_partkey", "id")


@query(f"""{GK_SQL} SELECT CASE WHEN x0 + x1 + x2 < 1.5 THEN 'heater' ELSE 'contact' END AS region, count(*) AS cells, round(sum(area), 9) AS measure, round(sum(area * q), 9) AS heat, round(min(k), 9) AS k_min FROM gk GROUP BY 1""")
def region_report(spark, sf):
    _, g = square_with_tables(spark, sf)
    region = F.when(F.col("x0") + F.col("x1") + F.col("x2") < 1.5, "heater").otherwise("contact")
    return g.groupBy(region.alias("region")).agg(F.count("*").alias("cells"), F.round(F.sum("area"), 9).alias("measure"), F.round(F.sum(F.col("area") * F.col("q")), 9).alias("heat"), F.round(F.min("k"), 9).alias("k_min"))


@query(f"""WITH {square_sql()}, n AS (SELECT id / 8e0 AS x FROM range(9) t(id))
SELECT node_id, round(x * 2 / 3e0 * CASE WHEN x <= 0.5 THEN 1 ELSE 0 END + CASE WHEN x > 0.5 THEN 1 / 3e0 + (x - 0.5) * 4 / 3e0 ELSE 0 END, 9) + 0.0 AS t FROM nodes""")
def interface_solve(spark, sf):
    """Heat through two layers, conductivity 2 and 1: piecewise linear, with one flux."""
    m = mesh.unit_square(spark, N)
    g = mesh.geometry(m)
    fixed = contracts.constraints(m, {"left": 0.0, "right": 1.0})
    k, f = asm.dirichlet(asm.stiffness(g, F.when(F.col("x0") + F.col("x1") + F.col("x2") < 1.5, 2.0).otherwise(1.0)), asm.load(g, F.lit(0.0)), fixed)
    return krylov.solved(k, f).select("node_id", r9(F.col("u")).alias("t"))


@query(f"""WITH {square_sql(4)}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce)),
wide AS (SELECT cell_id, {", ".join(f"max(edge_id) FILTER (local = {k}) AS e{k}, max(sign) FILTER (local = {k}) AS s{k}" for k in range(3))} FROM ce JOIN ids USING (lo, hi) GROUP BY 1),
gp AS (SELECT * FROM g JOIN wide USING (cell_id)), r AS ({" UNION ALL ".join(f'SELECT n{i} AS "row", e{j} AS col, s{j} * area / 3 * ({dot(i, e, "xy")} - {dot(i, s, "xy")}) AS v FROM gp' for i in range(3) for j, (s, e) in enumerate(el.TRIANGLE_EDGES))})
SELECT "row", col, round(sum(v), 9) + 0.0 AS v FROM r GROUP BY 1, 2""")
def edge_node_coupling(spark, sf):
    """The mixed block of the port pencil: hat gradients against edge functions."""
    g = physics.port_rows(mesh.unit_square(spark, 4))
    return asm.summed(g, el.edge_gradient(g, F.lit(1.0)), ["row", "col"]).select("row", "col", r9(F.col("v")).alias("v"))


@query(f"""WITH {square_sql()}, m AS ({pair_sql(lambda i, j: f"(1 + (x0 + x1 + x2) / 3) * area * {dot(i, j, 'xy')}", 3)}) SELECT "row", col, round(sum(v), 9) + 0.0 AS v FROM m GROUP BY 1, 2""")
def nodal_diffusion(spark, sf):
    """Stiffness with a coefficient given at the nodes: its exact mean on each cell."""
    m = mesh.unit_square(spark, N)
    g = mesh.geometry(m, m.nodes.withColumn("c", 1 + F.col("x")), ["c"])
    return asm.stiffness(g, (F.col("c0") + F.col("c1") + F.col("c2")) / 3).select("row", "col", r9(F.col("v")).alias("v"))
