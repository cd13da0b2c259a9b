"""Registered queries over the driver's tables, and the SQL that DuckDB runs for the same rows.

Meshes are generated; coefficients come from the tables: parts give conductivities and boundary values, suppliers
conductors and voltages, events sources. Results are rounded to nine digits, with negative zero made zero.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import elements as el
from meshloom.functions import scalars as sc
from meshloom.operators import assembly as asm
from meshloom.operators import evidence, krylov, mesh, physics, transfer

N = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(c):
    return F.round(c, 9) + 0.0


def cell_k(spark, sf, cells: int) -> DataFrame:
    """(cell_id, k): mean part size of the parts that fall to a cell, 1 where none does."""
    parts = table(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(cells)).alias("cell_id")).agg(F.sum("p_size").alias("s"), F.count("*").alias("n"))
    return spark.range(cells).withColumnRenamed("id", "cell_id").join(parts, "cell_id", "left").select("cell_id", F.coalesce(F.col("s") / F.col("n"), F.lit(1.0)).alias("k"))


def cell_q(spark, sf, cells: int) -> DataFrame:
    """(cell_id, q): events counted per cell."""
    seen = table(spark, sf, "events").groupBy(F.pmod("event_id", F.lit(cells)).alias("cell_id")).agg(F.count("*").alias("n"))
    return spark.range(cells).withColumnRenamed("id", "cell_id").join(seen, "cell_id", "left").select("cell_id", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("q"))


def sized(spark, sf) -> int:
    """Intervals a side of a square whose cells are about as many as the parts: meshes grow with the tables."""
    return max(4, int(math.floor(math.sqrt(table(spark, sf, "part").count() / 2))))


# --- SQL of the generated meshes -------------------------------------------------------------------------------------

GEOMETRY_SQL = """raw AS (SELECT c.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2,
  (b.x - a.x) * (d.y - a.y) - (d.x - a.x) * (b.y - a.y) AS det
  FROM cells c JOIN nodes a ON a.node_id = n0 JOIN nodes b ON b.node_id = n1 JOIN nodes d ON d.node_id = n2),
g AS (SELECT *, abs(det) / 2 AS area, (y1 - y2) / det AS g0x, (x2 - x1) / det AS g0y, (y2 - y0) / det AS g1x, (x0 - x2) / det AS g1y,
  (y0 - y1) / det AS g2x, (x1 - x0) / det AS g2y FROM raw)"""
SIZE_SQL = "size AS (SELECT greatest(4, CAST(floor(sqrt(count(*) / 2)) AS BIGINT)) AS n FROM part)"


def sized_square_sql() -> str:
    return f"""{SIZE_SQL},
nodes AS (SELECT id AS node_id, (id % (n + 1)) / CAST(n AS DOUBLE) AS x, (id // (n + 1)) / CAST(n AS DOUBLE) AS y FROM (SELECT n, unnest(range((n + 1) * (n + 1))) AS id FROM size)),
quads AS (SELECT id, n + 1 AS m, (id // n) * (n + 1) + id % n AS ll FROM (SELECT n, unnest(range(n * n)) AS id FROM size)),
cells AS (SELECT 2 * id AS cell_id, ll AS n0, ll + 1 AS n1, ll + m + 1 AS n2 FROM quads
  UNION ALL SELECT 2 * id + 1, ll, ll + m + 1, ll + m FROM quads),
{GEOMETRY_SQL}"""


def square_sql(n: int = N) -> str:
    m = n + 1
    return f"""nodes AS (SELECT id AS node_id, (id % {m}) / {float(n)} AS x, (id // {m}) / {float(n)} AS y FROM range({m * m}) t(id)),
quads AS (SELECT id, (id // {n}) * {m} + id % {n} AS ll FROM range({n * n}) t(id)),
cells AS (SELECT 2 * id AS cell_id, ll AS n0, ll + 1 AS n1, ll + {m + 1} AS n2 FROM quads
  UNION ALL SELECT 2 * id + 1, ll, ll + {m + 1}, ll + {m} FROM quads),
{GEOMETRY_SQL}"""


def box_sql(nx: int, ny: int, nz: int) -> str:
    sy, sx = nz + 1, (ny + 1) * (nz + 1)
    corner = [f"base + {(k & 1) * sx + (k >> 1 & 1) * sy + (k >> 2)}" for k in range(8)]
    tets = "\n  UNION ALL ".join(f"SELECT 6 * id + {k} AS cell_id, " + ", ".join(f"{corner[v]} AS n{i}" for i, v in enumerate(tet)) + " FROM vox" for k, tet in enumerate(mesh.VOXEL))
    e = {(k, a): f"(p{k}.{a} - p0.{a})" for k in (1, 2, 3) for a in "xyz"}
    cross = lambda p, q: {"x": f"({e[p, 'y']} * {e[q, 'z']} - {e[p, 'z']} * {e[q, 'y']})", "y": f"({e[p, 'z']} * {e[q, 'x']} - {e[p, 'x']} * {e[q, 'z']})", "z": f"({e[p, 'x']} * {e[q, 'y']} - {e[p, 'y']} * {e[q, 'x']})"}
    c = {1: cross(2, 3), 2: cross(3, 1), 3: cross(1, 2)}
    det = " + ".join(f"{e[1, a]} * {c[1][a]}" for a in "xyz")
    cof = ", ".join(f"{c[k][a]} AS c{k}{a}" for k in c for a in "xyz")
    xyz = ", ".join(f"p{k}.{a} AS {a}{k}" for k in range(4) for a in "xyz")
    grads = ", ".join([*(f"c{k}{a} / det AS g{k}{a}" for k in c for a in "xyz"), *(f"-(c1{a} + c2{a} + c3{a}) / det AS g0{a}" for a in "xyz")])
    joins = " ".join(f"JOIN nodes p{k} ON p{k}.node_id = n{k}" for k in range(4))
    return f"""nodes AS (SELECT id AS node_id, (id // {sx}) / {float(nx)} AS x, (id // {sy}) % {ny + 1} / {float(ny)} AS y, id % {sy} / {float(nz)} AS z FROM range({(nx + 1) * sx}) t(id)),
vox AS (SELECT id, (id // {ny * nz}) * {sx} + (id // {nz}) % {ny} * {sy} + id % {nz} AS base FROM range({nx * ny * nz}) t(id)),
cells AS ({tets}),
raw AS (SELECT cells.*, {xyz}, {cof}, {det} AS det FROM cells {joins}),
g AS (SELECT *, abs(det) / 6 AS volume, {grads} FROM raw)"""


def dot(i, j, axes):
    return "(" + " + ".join(f"g{i}{a} * g{j}{a}" for a in axes) + ")"


def pair_sql(value, n, source="g") -> str:
    return "\n  UNION ALL ".join(f'SELECT n{i} AS "row", n{j} AS col, {value(i, j)} AS v FROM {source}' for i in range(n) for j in range(n))


K_SQL = """ck AS (SELECT r.cell_id, coalesce(s / n, 1.0) AS k FROM cells r
  LEFT JOIN (SELECT p_partkey % (SELECT 2 * n * n FROM size) AS c, CAST(sum(p_size) AS DOUBLE) AS s, count(*) AS n FROM part GROUP BY 1) p ON p.c = r.cell_id)"""
Q_SQL = """cq AS (SELECT r.cell_id, coalesce(CAST(n AS DOUBLE), 0.0) AS q FROM cells r
  LEFT JOIN (SELECT event_id % (SELECT 2 * n * n FROM size) AS c, count(*) AS n FROM events GROUP BY 1) e ON e.c = r.cell_id)"""
GK_SQL = f"WITH {sized_square_sql()}, {K_SQL}, {Q_SQL}, gk AS (SELECT g.*, k, q FROM g JOIN ck USING (cell_id) JOIN cq USING (cell_id))"
STIFF_SQL = f"""{GK_SQL}, k1 AS (SELECT "row", col, sum(v) AS v FROM ({pair_sql(lambda i, j: f"k * area * {dot(i, j, 'xy')}", 3, "gk")}) GROUP BY 1, 2)"""
LOAD_SQL = "f1 AS (SELECT \"row\", sum(v) AS v FROM (" + " UNION ALL ".join(f'SELECT n{i} AS "row", q * area / 3 AS v FROM gk' for i in range(3)) + ") GROUP BY 1)"
#: Ends of the square held at 1 on the left and 2 on the right.
FIXED_SQL = f"held AS (SELECT node_id, CASE WHEN x = 0 THEN 1.0 ELSE 2.0 END AS value FROM nodes WHERE x = 0 OR x = 1)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def square_with_tables(spark, sf):
    n = sized(spark, sf)
    m = mesh.unit_square(spark, n)
    return m, mesh.geometry(m).join(cell_k(spark, sf, 2 * n * n), "cell_id").join(cell_q(spark, sf, 2 * n * n), "cell_id")


def held(m) -> DataFrame:
    return m.nodes.where("x = 0 OR x = 1").select("node_id", F.when(F.col("x") == 0, 1.0).otherwise(2.0).alias("value"))


# --- elements and assembly -------------------------------------------------------------------------------------------


@query(f"WITH {square_sql()} SELECT cell_id, round(area, 9) + 0.0 AS area, " + ", ".join(f"round(g{k}{a}, 9) + 0.0 AS g{k}{a}" for k in range(3) for a in "xy") + " FROM g")
def p1_geometry(spark, sf):
    g = mesh.geometry(mesh.unit_square(spark, N))
    return g.select("cell_id", *[r9(F.col(c)).alias(c) for c in ("area", *(f"g{k}{a}" for k in range(3) for a in "xy"))])


@query(f'{STIFF_SQL} SELECT "row", col, round(v, 9) + 0.0 AS v FROM k1')
def p1_stiffness(spark, sf):
    _, g = square_with_tables(spark, sf)
    return asm.stiffness(g, F.col("k")).select("row", "col", r9(F.col("v")).alias("v"))


@query(f'{GK_SQL}, {LOAD_SQL} SELECT "row", round(v, 9) + 0.0 AS v FROM f1')
def p1_load(spark, sf):
    _, g = square_with_tables(spark, sf)
    return asm.load(g, F.col("q")).select("row", r9(F.col("v")).alias("v"))


@query(f"""WITH {square_sql()}, m AS ({pair_sql(lambda i, j: f"area * {1 + (i == j)} / 12.0", 3)}) SELECT "row", col, round(sum(v), 12) + 0.0 AS v FROM m GROUP BY 1, 2""")
def p1_mass(spark, sf):
    g = mesh.geometry(mesh.unit_square(spark, N))
    return asm.mass(g, F.lit(1.0)).select("row", "col", (F.round("v", 12) + 0.0).alias("v"))


@query(f"""{STIFF_SQL}, {LOAD_SQL}, {FIXED_SQL},
rhs AS (SELECT "row", sum(v) AS v FROM (SELECT * FROM f1 UNION ALL SELECT "row", -v * value FROM k1 JOIN held ON col = node_id) GROUP BY 1)
SELECT "row", col, round(v, 9) + 0.0 AS v FROM k1 WHERE "row" NOT IN (SELECT node_id FROM held) AND col NOT IN (SELECT node_id FROM held)
UNION ALL SELECT node_id, node_id, 1.0 FROM held
UNION ALL SELECT "row", -1, round(v, 9) + 0.0 FROM rhs WHERE "row" NOT IN (SELECT node_id FROM held)
UNION ALL SELECT node_id, -1, value FROM held""")
def dirichlet_eliminate(spark, sf):
    m, g = square_with_tables(spark, sf)
    k, f = asm.dirichlet(asm.stiffness(g, F.col("k")), asm.load(g, F.col("q")), held(m))
    both = k.unionByName(f.select("row", F.lit(-1).cast("long").alias("col"), "v"))
    return both.select("row", "col", r9(F.col("v")).alias("v"))


@query(f"""{STIFF_SQL} SELECT "row", round(sum(v * (x * x + 2 * y)), 9) + 0.0 AS v FROM k1 JOIN nodes ON col = node_id GROUP BY 1""")
def matvec(spark, sf):
    m, g = square_with_tables(spark, sf)
    x = m.nodes.select("node_id", (F.col("x") * F.col("x") + 2 * F.col("y")).alias("u"))
    return asm.matvec(asm.stiffness(g, F.col("k")), x).select("row", r9(F.col("v")).alias("v"))


@query(f"""WITH {square_sql()}, e AS (SELECT node_id, x, y FROM nodes)
SELECT node_id AS "row", round(((CASE WHEN x IN (0, 1) THEN 1 ELSE 2 END) * (y = 1)::INT * 3.0 + (CASE WHEN y IN (0, 1) THEN 1 ELSE 2 END) * (x = 1)::INT * 5.0) / {2.0 * N}, 9) + 0.0 AS v
FROM e WHERE y = 1 OR x = 1""")
def facet_flux(spark, sf):
    m = mesh.unit_square(spark, N)
    tagged = m.tags.where("name IN ('top', 'right')").join(m.facets, F.col("entity_id") == F.col("facet_id")).select("facet_id", "nodes", "name")
    g = asm.facet_measure(tagged, m.nodes).join(tagged.select("facet_id", "name"), "facet_id")
    return asm.flux_load(g, F.when(F.col("name") == "top", 3.0).otherwise(5.0)).select("row", r9(F.col("v")).alias("v"))


@query(f"""{STIFF_SQL}, s AS (SELECT max(abs(a.v - coalesce(b.v, 0))) AS asymmetry, count(*) AS entries FROM k1 a LEFT JOIN k1 b ON a."row" = b.col AND a.col = b."row")
SELECT entries, round(asymmetry, 9) + 0.0 AS asymmetry, (SELECT round(min(v) / max(v), 9) FROM k1 WHERE "row" = col) AS least_diagonal,
(SELECT round(max(s), 9) + 0.0 FROM (SELECT abs(sum(v)) AS s FROM k1 GROUP BY "row")) AS row_sum FROM s""")
def matrix_diagnostics(spark, sf):
    _, g = square_with_tables(spark, sf)
    return asm.diagnostics(asm.stiffness(g, F.col("k"))).select("entries", *[r9(F.col(c)).alias(c) for c in ("asymmetry", "least_diagonal", "row_sum")])


@query(f"""WITH {box_sql(3, 2, 2)}, m AS ({pair_sql(lambda i, j: f"volume * {dot(i, j, 'xyz')}", 4)}) SELECT "row", col, round(sum(v), 9) + 0.0 AS v FROM m GROUP BY 1, 2""")
def tet4_stiffness(spark, sf):
    g = mesh.geometry(mesh.tet_box(spark, 3, 2, 2))
    return asm.stiffness(g, F.lit(1.0)).select("row", "col", r9(F.col("v")).alias("v"))


@query(f"""WITH {box_sql(3, 2, 2)}, m AS ({pair_sql(lambda i, j: f"volume * {1 + (i == j)} / 20.0", 4)}) SELECT "row", col, round(sum(v), 12) + 0.0 AS v FROM m GROUP BY 1, 2""")
def tet4_mass(spark, sf):
    g = mesh.geometry(mesh.tet_box(spark, 3, 2, 2))
    return asm.mass(g, F.lit(1.0)).select("row", "col", (F.round("v", 12) + 0.0).alias("v"))


TENSOR = {("x", "x"): 2.0, ("y", "y"): 3.0, ("z", "z"): 4.0, ("x", "y"): 0.5, ("y", "x"): 0.25}


@query("WITH " + box_sql(2, 2, 2) + ", m AS (" + pair_sql(lambda i, j: "volume * (" + " + ".join(f"g{i}{a} * {c} * g{j}{b}" for (a, b), c in TENSOR.items()) + ")", 4) + ') SELECT "row", col, round(sum(v), 9) + 0.0 AS v FROM m GROUP BY 1, 2')
def tet4_tensor(spark, sf):
    g = mesh.geometry(mesh.tet_box(spark, 2, 2, 2))
    c = {(a, b): F.lit(TENSOR.get((a, b), 0.0)) for a in "xyz" for b in "xyz"}
    return asm.summed(g, el.tensor_stiffness(g, c), ["row", "col"]).select("row", "col", r9(F.col("v")).alias("v"))


ROBIN_TOP = """top AS (SELECT cell_id, a.node_id AS n0, b.node_id AS n1, c.node_id AS n2,
  abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS size
  FROM (SELECT cell_id, unnest([n0, n0, n0, n1]) AS i, unnest([n1, n1, n2, n2]) AS j, unnest([n2, n3, n3, n3]) AS k FROM cells) f
  JOIN nodes a ON a.node_id = i JOIN nodes b ON b.node_id = j JOIN nodes c ON c.node_id = k WHERE a.z = 1 AND b.z = 1 AND c.z = 1)"""


@query("WITH " + box_sql(2, 2, 2) + f""", {ROBIN_TOP}, m AS ({pair_sql(lambda i, j: f"6.0 * size * {1 + (i == j)} / 12.0", 3, "top")}
  UNION ALL {" UNION ALL ".join(f'SELECT n{i}, -1, 6.0 * 300.0 * size / 3 FROM top' for i in range(3))})
SELECT "row", col, round(sum(v), 9) + 0.0 AS v FROM m GROUP BY 1, 2""")
def tet4_robin(spark, sf):
    m = mesh.tet_box(spark, 2, 2, 2)
    rim = mesh.boundary_facets(m).withColumn("facet_id", F.col("cell_id") * 4 + F.col("local"))
    top = rim.select("facet_id", F.explode("nodes").alias("node_id")).join(m.nodes, "node_id").groupBy("facet_id").agg(F.min("z").alias("z")).where("z = 1")
    matrix, load = asm.robin(asm.facet_measure(rim.join(top, "facet_id", "left_semi"), m.nodes), F.lit(6.0), F.lit(300.0))
    return matrix.unionByName(load.select("row", F.lit(-1).cast("long").alias("col"), "v")).select("row", "col", r9(F.col("v")).alias("v"))


@query("WITH fine AS (SELECT 1), " + square_sql(4) + """, k1 AS (SELECT "row", col, sum(v) AS v FROM (""" + pair_sql(lambda i, j: f"area * {dot(i, j, 'xy')}", 3) + """) GROUP BY 1, 2)
SELECT "row", col, round(v, 9) + 0.0 AS v FROM k1 WHERE round(v, 9) <> 0""")
def galerkin_coarse(spark, sf):
    """P^T K P of nested squares equals the coarse stiffness: hat functions of the coarse mesh lie in the fine space."""
    fine, coarse = mesh.unit_square(spark, 2 * 4), mesh.unit_square(spark, 4)
    k = asm.stiffness(mesh.geometry(fine), F.lit(1.0))
    return asm.galerkin(k, transfer.prolongation(fine, coarse)).select("row", "col", r9(F.col("v")).alias("v")).where("v <> 0")


# --- meshes ----------------------------------------------------------------------------------------------------------

EDGES_SQL = "e AS (SELECT cell_id, unnest([0, 1, 2]) AS local, unnest([n0, n1, n2]) AS a, unnest([n1, n2, n0]) AS b FROM cells), ce AS (SELECT cell_id, local, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN a < b THEN 1 ELSE -1 END AS sign FROM e)"


@query(f"WITH {sized_square_sql()}, {EDGES_SQL} SELECT lo, hi, min(cell_id) AS cell_id FROM ce GROUP BY lo, hi HAVING count(*) = 1")
def boundary_facets(spark, sf):
    return mesh.boundary_facets(mesh.unit_square(spark, sized(spark, sf))).select(F.array_min("nodes").alias("lo"), F.array_max("nodes").alias("hi"), "cell_id")


@query(f"WITH {sized_square_sql()}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce)) SELECT cell_id, CAST(local AS INTEGER) AS local, edge_id, sign FROM ce JOIN ids USING (lo, hi)")
def edge_map(spark, sf):
    return mesh.edge_map(mesh.unit_square(spark, sized(spark, sf)))[1]


OWNER_SQL = f"mid AS (SELECT cell_id, (x1 + x2 + x0) / 3 AS cx, (y1 + y2 + y0) / 3 AS cy FROM g), own AS (SELECT cell_id, CAST((row_number() OVER (ORDER BY cx, cy, cell_id) - 1) * 5 // (SELECT 2 * n * n FROM size) AS INTEGER) AS owner FROM mid)"


@query(f"WITH {sized_square_sql()}, {OWNER_SQL} SELECT cell_id, owner FROM own")
def cell_owners(spark, sf):
    return mesh.cell_owners(mesh.unit_square(spark, sized(spark, sf)), 5)


@query(f"""WITH {sized_square_sql()}, {OWNER_SQL}, seen AS (SELECT DISTINCT unnest([n0, n1, n2]) AS node_id, owner FROM cells JOIN own USING (cell_id)),
d AS (SELECT node_id, min(owner) AS owner FROM seen GROUP BY 1)
SELECT d.owner, count(DISTINCT d.node_id) AS owned, CAST(count(*) FILTER (seen.owner <> d.owner) AS BIGINT) AS sent FROM d JOIN seen USING (node_id) GROUP BY 1""")
def owned_ghost(spark, sf):
    m = mesh.unit_square(spark, sized(spark, sf))
    own, ghosts = mesh.dof_owners(m, mesh.cell_owners(m, 5))
    sent = ghosts.groupBy("owner").agg(F.count("*").alias("sent"))
    return own.groupBy("owner").agg(F.count("*").alias("owned")).join(sent, "owner", "left").select("owner", "owned", F.coalesce("sent", F.lit(0).cast("long")).alias("sent"))


EDGE2 = " + ".join(f"(x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2 + (z{a} - z{b}) ** 2" for a, b in el.TETRAHEDRON_EDGES)


@query("WITH " + box_sql(4, 3, 2) + f""", q AS (SELECT det, volume, 12.0 * pow(3.0 * volume, 2.0 / 3.0) / ({EDGE2}) AS ratio FROM g)
SELECT count(*) AS cells, round(sum(volume), 9) AS measure, round(min(ratio), 9) AS least, round(quantile_cont(ratio, 0.01), 9) AS p1, round(quantile_cont(ratio, 0.5), 9) AS median, CAST(sum(CASE WHEN det <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS inverted FROM q""")
def mesh_quality(spark, sf):
    out = mesh.quality(mesh.tet_box(spark, 4, 3, 2))
    return out.select("cells", *[r9(F.col(c)).alias(c) for c in ("measure", "least", "p1", "median")], "inverted")


@query(f"WITH {square_sql()}, t AS (SELECT unnest([n0, n1, n2]) AS node_id, CASE WHEN x0 + x1 + x2 < 1.5 THEN 'a' ELSE 'b' END AS region FROM g) SELECT node_id FROM t GROUP BY 1 HAVING count(DISTINCT region) = 2")
def interface_nodes(spark, sf):
    m = mesh.unit_square(spark, N)
    region = mesh.gathered(m.cells, m.nodes).select("cell_id", F.when(F.col("x0") + F.col("x1") + F.col("x2") < 1.5, "a").otherwise("b").alias("region"))
    return mesh.conforming_faces(m, region, "a", "b").select(F.explode("key").alias("node_id")).distinct()


# --- physics ---------------------------------------------------------------------------------------------------------

PART_CASES = "SELECT p_partkey AS case_id, CAST(p_size AS DOUBLE) AS k, 2e0 * (1 + p_partkey % 7) / 0.9e0 AS q, 3e2 AS lo, 3e2 + p_retailprice / 97e0 AS hi FROM part"


def part_cases(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_size").cast("double").alias("k"), (2.0 * (1 + F.col("p_partkey") % 7) / 0.9).alias("q"), F.lit(300.0).alias("left"), (300.0 + F.col("p_retailprice") / 97.0).alias("right"))


@query(f"""WITH c AS ({PART_CASES}), n AS (SELECT id / {float(N)} AS x FROM range({N + 1}) t(id)),
u AS (SELECT case_id, lo + (hi - lo) * x + q / (2 * k) * x * (1 - x) AS t FROM c, n)
SELECT case_id, round(max(t), 8) AS t_max, round(avg(t), 8) AS t_mean FROM u GROUP BY 1""")
def heat_solve(spark, sf):
    """Steady heat in the unit square for every part: two held ends, uniform source; peak and mean over the nodes."""
    u = physics.sweep(part_cases(spark, sf), physics.basis(mesh.unit_square(spark, N)))
    return u.groupBy("case_id").agg(F.round(F.max("u"), 8).alias("t_max"), F.round(F.avg("u"), 8).alias("t_mean"))


@query(f"""WITH c AS ({PART_CASES}) SELECT case_id, round(q, 6) AS load, round(-(q), 6) AS reaction FROM c""")
def energy_balance(spark, sf):
    """Heat put in equals heat taken out at the held ends, case by case, by the residual K u - f."""
    m = mesh.unit_square(spark, N)
    g = mesh.geometry(m)
    k, f, ends = asm.stiffness(g, F.lit(1.0)), asm.load(g, F.lit(1.0)), physics.side_nodes(m, "left", "right").select("node_id").distinct()
    rows = k.join(ends, k.row == ends.node_id, "left_semi").groupBy("col").agg(F.sum("v").alias("v"))  # sum of the held rows
    held_load = f.join(ends, f.row == ends.node_id, "left_semi").agg(F.sum("v").alias("held")).crossJoin(f.agg(F.sum("v").alias("whole")))
    u = physics.sweep(part_cases(spark, sf), physics.basis(m).join(rows, F.col("node_id") == F.col("col")).crossJoin(held_load))
    out = u.groupBy("case_id").agg(F.first(F.col("q") * F.col("whole")).alias("load"), (F.sum(F.col("k") * F.col("v") * F.col("u")) - F.first(F.col("q") * F.col("held"))).alias("reaction"))
    return out.select("case_id", F.round("load", 6).alias("load"), F.round("reaction", 6).alias("reaction"))


SUPPLIER = "SELECT s_suppkey AS case_id, 1.0 + s_nationkey AS sigma, s_acctbal / 1000 AS volts FROM supplier"


def conductors(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), (1.0 + F.col("s_nationkey")).alias("sigma"), (F.col("s_acctbal") / 1000).alias("volts"))


@query(f"WITH c AS ({SUPPLIER}) SELECT case_id, round(sigma * volts * volts, 6) AS power, round(-sigma * volts, 6) + 0.0 AS current, round(300 + sigma * volts * volts / 2 / 100 * 0.25, 6) AS t_max FROM c")
def electrothermal(spark, sf):
    """One-way Joule heating for every supplier: power, current and the peak of the heat it makes at k = 100."""
    m = mesh.unit_square(spark, N)
    unit = physics.basis(m)
    field = physics.joule(m, unit.select("node_id", F.col("u_right").alias("u")), m.cells.select("cell_id", F.lit(1.0).alias("sigma")))
    totals = field.agg(F.sum(F.col("size") * F.col("heat")).alias("p1"), F.sum(F.col("size") * F.col("jx")).alias("i1"))
    heat = field.select("cell_id", "heat").join(mesh.geometry(m), "cell_id")  # cell by cell onto the thermal mesh
    k, f = asm.stiffness(heat, F.lit(1.0)), asm.load(heat, F.col("heat"))
    ends = physics.side_nodes(m, "left", "right").select("node_id", F.lit(0.0).alias("value")).distinct()
    kk, ff = asm.dirichlet(k, f, ends)
    rise = krylov.solved(kk, ff).agg(F.max("u").alias("rise"))
    one = F.broadcast(totals.crossJoin(rise))
    s, v = F.col("sigma"), F.col("volts")
    return conductors(spark, sf).crossJoin(one).select("case_id", F.round(s * v * v * F.col("p1"), 6).alias("power"), (F.round(s * v * F.col("i1"), 6) + 0.0).alias("current"), F.round(300 + s * v * v * F.col("rise") / 100, 6).alias("t_max"))


@query("SELECT s_suppkey AS case_id, true AS converged, true AS charge, true AS heat, true AS near FROM supplier")
def self_consistent(spark, sf):
    """Joule heating whose conductivity falls with temperature, for every supplier: it converges, currents and heat balance,
    and the peak is near that of the continuous problem, theta + a theta^2 / 2 = s V^2 / (8 k)."""
    cases = conductors(spark, sf).select("case_id", "sigma", F.lit(3e-3).alias("alpha"), "volts", F.lit(120.0).alias("k"), F.lit(300.0).alias("t0"))
    out = physics.self_consistent(cases, mesh.unit_square(spark, N)).join(cases, "case_id")
    theta = (F.sqrt(1 + 2 * F.col("alpha") * F.col("sigma") * F.col("volts") * F.col("volts") / (8 * F.col("k"))) - 1) / F.col("alpha")
    near = F.abs(F.col("t_max") - F.col("t0") - theta) <= 0.02 * theta + 1e-6
    still = F.col("power") < 1e-12  # nothing flows: nothing to balance
    return out.select("case_id", "converged", (still | (F.col("charge") < 1e-9)).alias("charge"), (still | (F.col("heat") * F.col("power") < 1e-9 * F.col("power") + 1e-6)).alias("heat"), near.alias("near"))


@query(f"""WITH c AS ({PART_CASES}), n AS (SELECT id / {float(N)} AS x FROM range({N + 1}) t(id))
SELECT case_id, round(-q / (2 * k * k) * avg(x * (1 - x)), 12) + 0.0 AS d_k, round(avg(x * (1 - x)) / (2 * k), 12) AS d_q FROM c, n GROUP BY case_id, q, k""")
def adjoint_gradient(spark, sf):
    """d mean(T) / d k and / d q of every part by one transposed solve of the unit system (K is symmetric)."""
    m = mesh.unit_square(spark, N)
    g = mesh.geometry(m)
    k, f = asm.stiffness(g, F.lit(1.0)), asm.load(g, F.lit(1.0))
    ends = physics.side_nodes(m, "left", "right").select("node_id", F.lit(0.0).alias("value")).distinct()
    seeds = m.nodes.select(F.col("node_id").alias("row"), F.lit(1.0 / (N + 1) ** 2).alias("v"))
    kk, ff = asm.dirichlet(k, seeds, ends)
    lam = krylov.solved(kk, ff).select("node_id", F.col("u").alias("lam"))
    # k (K u) = q f on free rows: dJ/dk = -lam.K u / k = -q lam.f / k^2 and dJ/dq = lam.f / k
    weight = lam.join(f, lam.node_id == f.row).agg(F.sum(F.col("lam") * F.col("v")).alias("lf"))
    return part_cases(spark, sf).crossJoin(F.broadcast(weight)).select("case_id", (F.round(-F.col("q") * F.col("lf") / (F.col("k") * F.col("k")), 12) + 0.0).alias("d_k"), F.round(F.col("lf") / F.col("k"), 12).alias("d_q"))


# --- transfer and laws -----------------------------------------------------------------------------------------------


@query("SELECT event_id AS point_id, round(300 + 2 * ((event_id * 37 % 1000 + 0.5) / 1000.0) + 3 * ((event_id * 91 % 1000 + 0.25) / 1000.0), 6) AS value FROM events")
def point_location(spark, sf):
    """An affine field sampled at a point per event: located by binned range join, exact by the P1 weights."""
    m = mesh.unit_square(spark, N)
    points = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), ((F.col("event_id") * 37 % 1000 + 0.5) / 1000.0).alias("u"), ((F.col("event_id") * 91 % 1000 + 0.25) / 1000.0).alias("v"))
    field = m.nodes.select("node_id", (300 + 2 * F.col("x") + 3 * F.col("y")).alias("u"))
    return transfer.sampled(transfer.located(m, points), field).select("point_id", F.round("value", 6).alias("value"))


@query("""WITH t AS (SELECT event_id, 2 + 1e-2 * ((300 + value / 97e0) - 300) AS n FROM events)
SELECT event_id, round(n, 11) AS index, round(n * n, 11) AS permittivity, CASE WHEN (n * n - 3.5) / 1.5 BETWEEN 0 AND 1 THEN round((n * n - 3.5) / 1.5, 11) ELSE -1 END AS fraction FROM t""")
def thermo_optic(spark, sf):
    state = sc.thermo_optic(300 + F.col("value") / 97.0, 300.0, 2.0, 1e-2, 3.5, 5.0)
    out = table(spark, sf, "events").select("event_id", *[F.round(v, 11).alias(k) for k, v in state.items()])
    return out.withColumn("fraction", F.when(F.isnan("fraction"), -1.0).otherwise(F.col("fraction")))


TABLE_X, TABLE_Y = [0.0, 10.0, 25.0, 40.0, 50.0], [1.0, 3.0, 2.0, 8.0, 8.5]


@query("SELECT p_partkey, round(CASE " + " ".join(f"WHEN p_size BETWEEN {a} AND {b} THEN {p} + ({q} - {p}) * (p_size - {a}) / ({b} - {a})" for (a, b), (p, q) in zip(zip(TABLE_X, TABLE_X[1:]), zip(TABLE_Y, TABLE_Y[1:]))) + " END, 9) AS value FROM part")
def table_interp(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(sc.table_value(F.col("p_size").cast("double"), TABLE_X, TABLE_Y), 9).alias("value"))


@query("WITH w AS (SELECT p_partkey, 0.3 + p_size / 20.0 AS l FROM part) SELECT p_partkey, round(sqrt(1 + " + " + ".join(f"{b} * l * l / (l * l - {r * r})" for b, r in sc.SILICA) + "), 9) AS n FROM w")
def sellmeier(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(sc.sellmeier(0.3 + F.col("p_size") / 20.0), 9).alias("n"))


@query("SELECT event_id, round(value / (1 + 3e-3 * (CAST(user_id % 100 AS DOUBLE))), 9) AS sigma FROM events")
def resistivity_law(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(sc.conductivity(F.col("value"), F.lit(3e-3), 300.0 + F.col("user_id") % 100, F.lit(300.0)), 9).alias("sigma"))


@query("SELECT s_suppkey, round(0.015 / ((1 + abs(s_acctbal)) / 1e4), 9) AS volts, round(0.015 * 0.015 / ((1 + abs(s_acctbal)) / 1e4), 9) AS watts FROM supplier")
def calibration(spark, sf):
    """Unit-voltage power is the conductance G: the target current needs V = I / G and makes P = I V."""
    g, i = (1 + F.abs("s_acctbal")) / 1e4, 0.015
    return table(spark, sf, "supplier").select("s_suppkey", F.round(i / g, 9).alias("volts"), F.round(i * (i / g), 9).alias("watts"))


@query("""SELECT w AS width_um, d AS depth_um, 'adiabatic' AS lateral, CASE WHEN w = 20 AND d = 0.5 THEN 'baseline' WHEN w = 20 THEN 'substrate_depth' WHEN d = 0.5 THEN 'lateral_extent' ELSE 'depth_extent_interaction' END AS axis
FROM (VALUES (20.0), (40.0), (80.0)) a(w), (VALUES (0.5), (5.0), (50.0)) b(d) UNION ALL SELECT 40.0, 5.0, 'isothermal', 'sidewall_boundary'""")
def sensitivity_cross(spark, sf):
    """The ten cases: widths by depths around a baseline, and one with isothermal side walls."""
    w = spark.createDataFrame([(20.0,), (40.0,), (80.0,)], "width_um double")
    d = spark.createDataFrame([(0.5,), (5.0,), (50.0,)], "depth_um double")
    base_w, base_d = F.col("width_um") == 20.0, F.col("depth_um") == 0.5
    axis = F.when(base_w & base_d, "baseline").when(base_w, "substrate_depth").when(base_d, "lateral_extent").otherwise("depth_extent_interaction")
    cross = w.crossJoin(F.broadcast(d)).select("width_um", "depth_um", F.lit("adiabatic").alias("lateral"), axis.alias("axis"))
    return cross.unionByName(spark.createDataFrame([(40.0, 5.0, "isothermal", "sidewall_boundary")], cross.schema))


# --- port modes ------------------------------------------------------------------------------------------------------


def nedelec_sql() -> str:
    e = el.TRIANGLE_EDGES
    m = lambda a, b: f"area * {1 + (a == b)} / 12.0"
    parts = []
    for i, (a, b) in enumerate(e):
        for j, (c, d) in enumerate(e):
            mass = f"({m(a, c)} * {dot(b, d, 'xy')} - {m(a, d)} * {dot(b, c, 'xy')} - {m(b, c)} * {dot(a, d, 'xy')} + {m(b, d)} * {dot(a, c, 'xy')})"
            parts.append(f'SELECT e{i} AS "row", e{j} AS col, s{i} * s{j} * {mass} AS m, s{i} * s{j} / area AS c FROM gp')
    return f"""WITH {square_sql(4)}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce)),
wide AS (SELECT cell_id, {", ".join(f"max(edge_id) FILTER (local = {k}) AS e{k}, max(sign) FILTER (local = {k}) AS s{k}" for k in range(3))} FROM ce JOIN ids USING (lo, hi) GROUP BY 1),
gp AS (SELECT * FROM g JOIN wide USING (cell_id)), r AS ({" UNION ALL ".join(parts)})
SELECT "row", col, round(sum(m), 9) + 0.0 AS mass, round(sum(c), 9) + 0.0 AS curl FROM r GROUP BY 1, 2"""


@query(nedelec_sql())
def nedelec_gram(spark, sf):
    """Edge mass and curl-curl matrices of the lowest edge elements, with signs by global orientation."""
    g = physics.port_rows(mesh.unit_square(spark, 4))
    m = g.select(F.inline(el.nedelec_mass(g, F.lit(1.0)))).groupBy("row", "col").agg(F.sum("v").alias("mass"))
    c = g.select(F.inline(el.nedelec_curl(g, F.lit(1.0)))).groupBy("row", "col").agg(F.sum("v").alias("curl"))
    return m.join(c, ["row", "col"]).select("row", "col", r9(F.col("mass")).alias("mass"), r9(F.col("curl")).alias("curl"))


@query("SELECT r.id AS mode, r.id = 0 AS propagates, true AS near FROM range(4) r(id)")
def port_modes(spark, sf):
    """Modes of a closed rectangular guide of 2 by 1 micrometres at 100 THz: the first, TE10, propagates with an error below
    1.1e-3; TE20, TE01 and the fourth (TE11, TM11) decay, at rates within 15 % of the exact ones."""
    k2 = (2 * math.pi * 1e14 / physics.LIGHT) ** 2
    cut = [(math.pi / 2e-6) ** 2 * (m * m + 4 * n * n) for m, n in ((1, 0), (2, 0), (0, 1), (1, 1))]
    exact = F.element_at(F.array(*[F.lit(math.sqrt(abs(k2 - c))) for c in cut]), F.col("mode") + 1)
    out = physics.port_modes(mesh.unit_square(spark, 4, 2e-6, 1e-6), 1e14)
    first = F.col("mode") == 0
    near = F.when(first, F.abs(F.col("beta_re") / exact - 1) < 1.1e-3).otherwise(F.abs(F.col("beta_im") / exact - 1) < 0.15)
    return out.select(F.col("mode").cast("long").alias("mode"), (F.col("beta_re") > 1e-3 * F.abs("beta_im")).alias("propagates"), near.alias("near"))


@query("""WITH r AS (SELECT user_id % 4 AS process, event_type AS ordinal, max(value) AS v FROM events GROUP BY 1, 2),
o AS (SELECT ordinal, max(v) AS path, count(DISTINCT process) AS n FROM r GROUP BY 1)
SELECT count(*) AS ordinals, round(median(path), 6) AS median_path, round(max(path), 6) AS worst, bool_and(n = 4) AS complete FROM o""")
def evidence_rollup(spark, sf):
    """Per step the slowest of all processes, then the median over steps; incomplete process sets show."""
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("process"), F.col("event_type").alias("ordinal"), "value")
    return evidence.rollup(rows, 4).select("ordinals", F.round("median_path", 6).alias("median_path"), F.round("worst", 6).alias("worst"), "complete")


def queries():
    from meshloom.plans import apps, gradients, more, partitions, ports, solvers, sources  # noqa: F401  registers the rest

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)
