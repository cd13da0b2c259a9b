"""Registered queries of solvers: mesh-scale and multilevel conjugate gradients, tetrahedral electrothermal problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import assembly as asm
from meshloom.operators import cases, contracts, coupled, gmres, krylov, mesh, multilevel, project, solve, tet4, transfer
from meshloom.operators.tables import Tables, only_marked_broadcasts
from meshloom.plans.registry import SIZE_SQL, query, r9, sized, sized_square_sql, square_sql, table


def levels(spark, n: int, depth: int):
    """Meshes of n, n / 2, ... intervals, the free nodes of each, and transfers between free nodes."""
    meshes = [mesh.unit_square(spark, n >> k) for k in range(depth)]
    free = [m.nodes.where("x > 0 AND x < 1 AND y > 0 AND y < 1").select("node_id") for m in meshes]
    ps = [multilevel.free_transfer(transfer.prolongation(a, b), fa, fb) for (a, fa), (b, fb) in zip(zip(meshes, free), zip(meshes[1:], free[1:]))]
    return meshes, free, ps


def interior_system(m, contrast: float = 1.0):
    """-div k grad u = 1 with u = 0 on the rim; k is ``contrast`` right of the middle."""
    g = mesh.geometry(m)
    k = asm.stiffness(g, F.when(F.col("x0") + F.col("x1") + F.col("x2") < 1.5, 1.0).otherwise(contrast))
    rim = m.nodes.where("x = 0 OR x = 1 OR y = 0 OR y = 1").select("node_id")
    f = asm.load(g, F.lit(1.0)).join(rim.select(F.col("node_id").alias("row")), "row", "left_anti")
    k = k.join(rim.select(F.col("node_id").alias("row")), "row", "left_anti").join(rim.select(F.col("node_id").alias("col")), "col", "left_anti")
    return k.select("row", "col", "v"), f


#: SQL of a square with a power of two of intervals, as many as the parts allow, and of its strips' conductivities.
DYADIC_SQL = f"""{SIZE_SQL}, dyadic AS (SELECT CAST(pow(2, floor(log2(n))) AS BIGINT) AS n FROM size)"""
STRIPS_SQL = "strips AS (SELECT p_partkey AS j, CAST(p_size AS DOUBLE) * p_size AS k FROM part, dyadic WHERE p_partkey < n)"


def dyadic(spark, sf) -> int:
    """The greatest power of two of intervals within ``sized``."""
    return 1 << (sized(spark, sf).bit_length() - 1)


def column_of(n: int, cell=None):
    """The column of intervals that a cell of ``unit_square`` lies in."""
    return F.floor((F.col("cell_id") if cell is None else cell) / 2).cast("long") % n


def held_apart(k, f, fixed):
    """K(row, col, v) and f(row, v) on the nodes that aren't fixed(node_id, value)."""
    ids = fixed.select(F.col("node_id").alias("row"))
    moved = k.join(fixed.withColumnRenamed("node_id", "col"), "col").groupBy("row").agg((-F.sum(F.col("v") * F.col("value"))).alias("v"))
    return asm.free_block(k, fixed), asm.add(f, moved).join(ids, "row", "left_anti")


@query(f"""WITH {DYADIC_SQL}, {STRIPS_SQL}, d AS (SELECT j, 1 / k / (SELECT sum(1 / k) FROM strips) AS d FROM strips),
u AS (SELECT j + 1 AS i, sum(d) OVER (ORDER BY j) AS t FROM d UNION ALL SELECT 0, 0.0)
SELECT node_id, round(t, 6) + 0.0 AS u FROM (SELECT n, unnest(range((n + 1) * (n + 1))) AS node_id FROM dyadic) JOIN u ON node_id % (n + 1) = i WHERE i > 0 AND i < n""")
def mesh_scale_cg(spark, sf):
    """Heat through strips whose conductivities are the squared sizes of parts (1 to 2500), from 0 left to 1 right: PCG over
    tables on a mesh that grows with the part table."""
    n = dyadic(spark, sf)
    m = mesh.unit_square(spark, n)
    strips = table(spark, sf, "part").where(F.col("p_partkey") < n).select(F.col("p_partkey").alias("j"), (F.col("p_size").cast("double") * F.col("p_size")).alias("k"))
    g = mesh.geometry(m).withColumn("j", column_of(n)).join(strips, "j")
    ends = m.nodes.where("x = 0 OR x = 1").select("node_id", F.col("x").alias("value"))
    k, f = held_apart(asm.stiffness(g, F.col("k")), asm.load(g, F.lit(0.0)), ends)
    return krylov.iterated(*(kept(spark, d, n) for n, d in zip("kf", (k, f)))).select("node_id", r9(F.round("u", 6)).alias("u"))


LAYERED = 4


@query(f"""WITH c AS (SELECT p_partkey AS case_id, p_size * (1 + (p_partkey + 3 * j) % 9) / 10e0 AS k, j, 2e0 * (1 + p_partkey % 7) AS q, 3e2 AS lo, 3e2 + p_retailprice / 97e0 AS hi FROM part, (SELECT unnest(range({LAYERED})) AS j)),
a AS (SELECT case_id, (max(hi - lo) + max(q) / {LAYERED**2}e0 * sum(j / k)) / sum(1 / k) AS a FROM c GROUP BY 1),
u AS (SELECT case_id, j + 1 AS i, lo + sum((a - j * q / {LAYERED**2}e0) / k) OVER (PARTITION BY case_id ORDER BY j) AS t FROM c JOIN a USING (case_id))
SELECT case_id, CAST(r * {LAYERED + 1} + i AS BIGINT) AS node_id, round(t, 6) AS t FROM u, (SELECT unnest(range({LAYERED + 1})) AS r) WHERE i < {LAYERED}""")
def layered_heat(spark, sf):
    """Heat with a source through each part's own strips of different conductivity: a part is a row, and batches of parts are
    stacked matrices that are factored at once."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), "p_size", (2.0 * (1 + F.col("p_partkey") % 7)).alias("q"), (300.0 + F.col("p_retailprice") / 97.0).alias("hi"))
    conductivity = lambda cell: F.col("p_size") * (1 + (F.col("case_id") + 3 * column_of(LAYERED, cell)) % 9) / 10.0
    held = lambda x, y: F.lit(300.0) if x == 0 else F.col("hi") if x == 1 else None
    return cases.heat(mesh.unit_square(spark, LAYERED), parts, conductivity, F.col("q"), held).select("case_id", "node_id", F.round("u", 6).alias("t"))


@query(f"""SELECT s_suppkey AS case_id, round((1 + s_nationkey) * {(LAYERED - 1) ** 2}e0 / {LAYERED**2}, 6) AS load, 0.0 AS off, 1.0 AS energy FROM supplier""")
def cell_heat(spark, sf):
    """Every supplier's square has a conductivity of its own in each cell (1 to 97) and is held all around: the load, the
    greatest |K u - f| against the greatest |f|, and u.K u against u.f, case by case."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), (1.0 + F.col("s_nationkey")).alias("q"))
    rim = lambda x, y: F.lit(0.0) if x in (0, 1) or y in (0, 1) else None
    rows = cases.heat(mesh.unit_square(spark, LAYERED), suppliers, lambda cell: (1 + (cell * 31 + F.col("case_id") * 17) % 97).cast("double"), F.col("q"), rim)
    out = rows.groupBy("case_id").agg(F.round(F.sum("f"), 6).alias("load"), (F.round(F.max(F.abs(F.col("ku") - F.col("f"))) / F.max(F.abs("f")), 6) + 0.0).alias("off"), F.round(F.sum(F.col("u") * F.col("ku")) / F.sum(F.col("u") * F.col("f")), 6).alias("energy"))
    return out.select("case_id", "load", "off", "energy")


def kept(spark, df, name):
    return Tables(spark, "kept").write(name, df)


@query(f"WITH {DYADIC_SQL} SELECT (n - 1) * (n - 1) AS nodes, round((n - 1) * (n - 1) / CAST(n * n AS DOUBLE), 6) AS load, 0.0 AS off, 1.0 AS energy FROM dyadic")
def table_cg(spark, sf):
    """A source in a square of contrast 50, PCG over tables with the inverse diagonal."""
    m = mesh.unit_square(spark, dyadic(spark, sf))
    k, f = (kept(spark, d, n) for n, d in zip("kf", interior_system(m, 50.0)))
    return agreement(k, f, krylov.iterated(k, f))


def agreement(k, f, u):
    """One row: unknowns, load, greatest |K u - f| against the greatest |f|, and u.K u against u.f."""
    ku = asm.matvec(k, u).withColumnRenamed("v", "ku")
    rows = f.join(ku, "row").join(u.withColumnRenamed("node_id", "row"), "row")
    off = F.max(F.abs(F.col("ku") - F.col("v"))) / F.max(F.abs("v"))
    return rows.agg(F.count("*").alias("nodes"), F.round(F.sum("v"), 6).alias("load"), (F.round(off, 6) + 0.0).alias("off"), F.round(F.sum(F.col("u") * F.col("ku")) / F.sum(F.col("u") * F.col("v")), 6).alias("energy"))


def multilevel_solution(spark, n: int, contrast: float):
    """K, f, u and the report of multilevel PCG on a square of n intervals, down to four."""
    depth = max(2, n.bit_length() - 2)
    # each step has joins on every level: broadcasts of their tables would add up on the driver
    with only_marked_broadcasts(spark):
        (m, *_), _, ps = levels(spark, n, depth)
        k, f = (kept(spark, d, name) for name, d in zip("kf", interior_system(m, contrast)))
        u, report = multilevel.solve(k, f, ps, cg=solve.CgPolicy(relative=1e-10, most=120))
    return k, f, u, solve.assert_converged(report)


@query(f"WITH {DYADIC_SQL} SELECT (n - 1) * (n - 1) AS nodes, round((n - 1) * (n - 1) / CAST(n * n AS DOUBLE), 6) AS load, 0.0 AS off, 1.0 AS energy FROM dyadic")
def multilevel_pcg(spark, sf):
    """The same with a contrast of 100, restriction, coarse solve and prolongation as joins, on levels down to 4 by 4."""
    k, f, u, _ = multilevel_solution(spark, dyadic(spark, sf), 100.0)
    return agreement(k, f, u)


@query("SELECT 225 AS nodes, round(225 / 256e0, 6) AS load, 0.0 AS off, 1.0 AS energy, true AS few, true AS sound FROM (SELECT count(*) FROM part)")
def table_multilevel(spark, sf):
    """Three levels on 16 by 16: fewer steps than unknowns in a row ask for, and an admitted coarse matrix."""
    k, f, u, report = multilevel_solution(spark, 16, 50.0)
    sound = report["asymmetry"] < 1e-10 and report["condition"] < 1e4 and report["diagonal"] > 1e-3
    return agreement(k, f, u).select("*", F.lit(report["iterations"] < 40).alias("few"), F.lit(sound).alias("sound"))


@query(f"""WITH {square_sql(4)}, f AS (SELECT id AS node_id, (id % 9) / 8e0 AS x, (id // 9) / 8e0 AS y FROM range(81) t(id)),
h AS (SELECT f.node_id, cell_id, f.x AS fx, f.y AS fy, n0, n1, n2, g0x * (f.x - x1) + g0y * (f.y - y1) AS w0, g1x * (f.x - x2) + g1y * (f.y - y2) AS w1, g2x * (f.x - x0) + g2y * (f.y - y0) AS w2 FROM f, g WHERE f.x > 0 AND f.x < 1 AND f.y > 0 AND f.y < 1),
b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cell_id) AS k FROM h WHERE least(w0, w1, w2) >= -1e-12),
p AS (SELECT fx, fy, unnest([n0, n1, n2]) AS coarse, unnest([w0, w1, w2]) AS w FROM b WHERE k = 1)
SELECT coarse AS node_id, round(sum(w * (fx + 2 * fy)), 9) AS r FROM p JOIN nodes ON coarse = node_id WHERE x > 0 AND x < 1 AND y > 0 AND y < 1 AND abs(w) > 1e-9 GROUP BY 1""")
def restriction(spark, sf):
    """P^T r between free nodes of nested squares."""
    (fine, _), (free, _), (p,) = levels(spark, 8, 2)
    r = fine.nodes.join(free, "node_id").select("node_id", (F.col("x") + 2 * F.col("y")).alias("r"))
    return multilevel.restrict(p, r).select("node_id", F.round("r", 9).alias("r"))


@query(f"WITH {SIZE_SQL}, d AS (SELECT CAST(greatest(4, pow(2, floor(log2(n)) - 1)) AS BIGINT) AS n FROM size) SELECT (n - 1) * (n - 1) AS nodes, round((n - 1) * (n - 1) / CAST(n * n AS DOUBLE), 6) AS load, 0.0 AS off, 1.0 AS work FROM d")
def shifted_gmres(spark, sf):
    """A lossy wave, (K - (20 - 5i) M) u = f with u = 0 on the rim, where M is the mass, on a mesh that grows with the part table:
    complex, indefinite, solved by GMRES over tables that substructures precondition. Unknowns, load, greatest |A u - f| against the greatest |f|, and u.A u
    against u.f."""
    m = mesh.unit_square(spark, max(4, dyadic(spark, sf) // 2))
    g = mesh.geometry(m)
    rim = m.nodes.where("x = 0 OR x = 1 OR y = 0 OR y = 1").select("node_id")
    stiff = asm.stiffness(g, F.lit(1.0)).select("row", "col", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    mass = asm.mass(g, F.lit(1.0)).select("row", "col", (-20.0 * F.col("v")).alias("re"), (5.0 * F.col("v")).alias("im"))
    a = stiff.unionByName(mass).groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    a = kept(spark, asm.free_block(a, rim).select("row", "col", "re", "im"), "a")
    f = kept(spark, asm.load(g, F.lit(1.0)).join(rim.withColumnRenamed("node_id", "row"), "row", "left_anti").select("row", F.col("v").alias("re"), F.lit(0.0).alias("im")), "f")
    u, report = gmres.gmres(a, f, 1e-9, direct=True)
    solve.assert_converged({**report, "backward_error": report["residual"]})
    u = u.select(F.col("node_id").alias("col"), F.col("re").alias("ur"), F.col("im").alias("ui"))
    au = a.join(u, "col").groupBy("row").agg(F.sum(F.col("re") * F.col("ur") - F.col("im") * F.col("ui")).alias("ar"), F.sum(F.col("re") * F.col("ui") + F.col("im") * F.col("ur")).alias("ai"))
    rows = f.join(au, "row").join(u.withColumnRenamed("col", "row"), "row")
    off = F.max(F.hypot(F.col("ar") - F.col("re"), F.col("ai") - F.col("im"))) / F.max(F.abs("re"))
    work = F.sum(F.col("ur") * F.col("ar") - F.col("ui") * F.col("ai")) / F.sum(F.col("ur") * F.col("re"))
    return rows.agg(F.count("*").alias("nodes"), F.round(F.sum("re"), 6).alias("load"), (F.round(off, 6) + 0.0).alias("off"), F.round(work, 6).alias("work"))


def nations(spark, sf):
    return table(spark, sf, "nation").selectExpr("n_nationkey AS case_id", "1.0 + n_nationkey AS sigma", "(1 + n_regionkey) / 1000D AS alpha", "2.0 + n_nationkey % 3 AS volts", "1.0 + n_nationkey % 4 AS k", "300.0 AS t0")


@query("SELECT n_nationkey AS case_id, 1.0 AS peak, 0.0 AS charge, 0.0 AS heat FROM nation")
def coupled_tables(spark, sf):
    """Joule heating with sigma(T) for every nation, over tables, on a mesh that grows with the part table: the peak against that
    of the continuous problem, theta + alpha theta^2 / 2 = sigma V^2 / (8 k), and the imbalances of currents and heat."""
    cases = nations(spark, sf)
    # a round's tables are small files of many rows, which would be broadcast through the driver
    with only_marked_broadcasts(spark), coupled.Coupled(cases, mesh.unit_square(spark, max(4, dyadic(spark, sf) // 4)), tolerance=1e-8) as problem:
        problem.solve()
        rows = kept(spark, problem.report(), "report").join(cases, "case_id")
    theta = (F.sqrt(1 + F.col("alpha") * F.col("sigma") * F.col("volts") * F.col("volts") / (4 * F.col("k"))) - 1) / F.col("alpha")
    return rows.select("case_id", F.round(F.col("rise_max") / theta, 1).alias("peak"), *[F.round(c, 6).alias(c) for c in ("charge", "heat")])


@query("SELECT n_nationkey AS case_id, 1.0 AS by_volts, 1.0 AS by_k, 1.0 AS by_alpha FROM nation")
def coupled_slopes(spark, sf):
    """Its gradients by the adjoint fixed point, for every nation. The rise is a function of alpha sigma V^2 / k over alpha, also
    on a mesh, from which follow V d_V = 2 sigma d_sigma, k d_k = - sigma d_sigma and alpha d_alpha = sigma d_sigma - mean rise: the
    ratios of both sides."""
    cases = nations(spark, sf)
    # a round's tables are small files of many rows, which would be broadcast through the driver
    with only_marked_broadcasts(spark), coupled.Coupled(cases, mesh.unit_square(spark, max(2, dyadic(spark, sf) // 8)), tolerance=1e-7) as problem:
        problem.solve()
        state = kept(spark, problem.report(), "report")
        slopes = kept(spark, problem.gradient().select("case_id", *[F.col(c).alias(f"d_{c}") for c in ("sigma", "alpha", "k", "volts")]), "slopes")
    one = F.col("sigma") * F.col("d_sigma")
    ratios = {"by_volts": F.col("volts") * F.col("d_volts") / (2 * one), "by_k": -F.col("k") * F.col("d_k") / one, "by_alpha": (F.col("alpha") * F.col("d_alpha") + F.col("rise_mean")) / one}
    return state.join(slopes, "case_id").join(cases, "case_id").select("case_id", *[F.round(c, 4).alias(n) for n, c in ratios.items()])


# --- tetrahedra -------------------------------------------------------------------------------------------------------


def bar(spark, n: int, embedded: bool = False) -> tet4.Plan:
    """Current along x at sigma 2 and 1 V; k 4, a source of 3, 300 K below, a Robin face above (h 6, 300 K)."""
    m = mesh.tet_box(spark, n, n, n)
    inside = m.cells
    if embedded:
        high = m.cells.select("cell_id", F.explode("nodes").alias("node_id")).join(m.nodes.where("y > 0.5"), "node_id", "left_semi").select("cell_id")
        inside = m.cells.join(high, "cell_id", "left_anti")
    conductor = inside.select("cell_id", F.col("cell_id").alias("parent_cell_id"), F.lit(2.0).alias("sigma"))
    thermal = m.cells.select("cell_id", F.lit(4.0).alias("k"), F.lit(3.0).alias("q"))
    used = inside.select(F.explode("nodes").alias("node_id")).distinct()
    potential = m.nodes.where("x = 0 OR x = 1").join(used, "node_id", "left_semi").select("node_id", F.col("x").alias("value"))
    temperature = m.nodes.where("z = 0").select("node_id", F.lit(300.0).alias("value"))
    robin = tet4.faces_at(m, "z", 1.0).select("facet_id", "nodes", F.lit(6.0).alias("h"), F.lit(300.0).alias("ambient"))
    return tet4.Plan(m, conductor, thermal, potential, temperature, robin)


def nodes_sql(n: int) -> str:
    return f"SELECT id AS node_id, (id // {(n + 1) ** 2}) / {float(n)} AS x, (id // {n + 1}) % {n + 1} / {float(n)} AS y, id % {n + 1} / {float(n)} AS z FROM range({(n + 1) ** 3}) t(id)"


@query(f"WITH nodes AS ({nodes_sql(3)}) SELECT node_id, round(x, 9) AS phi, true AS near FROM nodes")
def tet4_electrothermal(spark, sf):
    """Potential of every node, and whether the temperature is near 300 + s z - 5 z^2 / 8 (s = 5 (1 + 6 / 8) / 10)."""
    plan = tet4.prepare(bar(spark, 3))
    out = tet4.solve_plan(plan)
    both = out["potential"].withColumnRenamed("u", "phi").join(out["temperature"], "node_id").join(plan.mesh.nodes, "node_id")
    exact = 300 + 0.875 * F.col("z") - 5 * F.col("z") * F.col("z") / 8
    return both.select("node_id", r9(F.col("phi")).alias("phi"), (F.abs(F.col("u") - exact) < 0.03).alias("near"))


@query("SELECT 2.0 AS power, 5.0 AS source, true AS charge, true AS electrical, true AS transfer, true AS thermal, true AS ok")
def tet4_balances(spark, sf):
    """Charge, electrical energy, transferred heat and thermal balance of the bar."""
    out = tet4.admitted(tet4.solve_plan(tet4.prepare(bar(spark, 2)))["balances"])
    names = ("charge", "electrical", "transfer", "thermal")
    return out.select(r9(F.col("power")).alias("power"), r9(F.col("source")).alias("source"), *[(F.col(c) < 1e-10).alias(c) for c in names], "ok")


@query(f"WITH nodes AS ({nodes_sql(2)}) SELECT round(1.0, 9) AS power, 24 AS hot, true AS ok")
def tet4_embedded(spark, sf):
    """A conductor in the lower half: its heat goes to its parents only."""
    out = tet4.solve_plan(tet4.prepare(bar(spark, 2, embedded=True)))
    hot = out["heat"].agg(F.sum((F.col("heat") > 1e-9).cast("int")).cast("int").alias("hot"))
    return tet4.admitted(out["balances"]).crossJoin(hot).select(r9(F.col("power")).alias("power"), "hot", "ok")


@query(f"WITH nodes AS ({nodes_sql(2)}) SELECT node_id, round(CASE WHEN x = 0 THEN 0 WHEN x = 1 THEN 1 ELSE 7 * y END, 9) + 0.0 AS u FROM nodes")
def reconstructed_state(spark, sf):
    """Free and held values together are the field on all nodes."""
    m = mesh.tet_box(spark, 2, 2, 2)
    fixed = m.nodes.where("x = 0 OR x = 1").select("node_id", F.col("x").alias("value"))
    free = contracts.free_nodes(m, fixed).join(m.nodes, "node_id").select("node_id", (7 * F.col("y")).alias("u"))
    return tet4.reconstructed(m.nodes, free, fixed).select("node_id", r9(F.col("u")).alias("u"))


@query("SELECT r.id AS face, 1 AS nodes_out FROM range(0) r(id) UNION ALL SELECT count(*), 3 FROM (SELECT unnest(range(48)))")
def oriented_faces(spark, sf):
    """Faces of the box with outward order: their count, and how many corners each has."""
    m = mesh.tet_box(spark, 2, 2, 2)
    facets = mesh.boundary_facets(m).select((F.col("cell_id") * 4 + F.col("local")).alias("facet_id"), F.array_sort("nodes").alias("nodes"))
    out = tet4.oriented_boundary(m, facets)
    return out.agg(F.count("*").alias("face"), F.max(F.size("nodes")).cast("int").alias("nodes_out"))


@query(f"""WITH {sized_square_sql()} SELECT CAST(n_nationkey AS BIGINT) AS case_id, node_id, round((1 + n_nationkey) * x - n_regionkey * y, 6) + 0.0 AS ex, round(2 + n_regionkey * x + y / (1 + n_nationkey), 6) + 0.0 AS ey
FROM nodes, nation""")
def projected_fields(spark, sf):
    """Each nation's field, known at nine points of every cell, projected to nodes by the consistent mass matrix: all nations
    and both components in one iteration over tables, on a mesh that grows with the part table. A linear field comes back whole."""
    g = mesh.geometry(mesh.unit_square(spark, sized(spark, sf)))
    cases = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("case_id"), (1.0 + F.col("n_nationkey")).alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    points = project.quadrature_points(g).crossJoin(F.broadcast(cases))  # 25 nations
    fields = {"ex": F.col("a") * F.col("x") - F.col("b") * F.col("y"), "ey": 2.0 + F.col("b") * F.col("x") + F.col("y") / F.col("a")}
    u = project.projected(g, points, fields)
    return u.select("case_id", "node_id", (F.round("ex", 6) + 0.0).alias("ex"), (F.round("ey", 6) + 0.0).alias("ey"))
