"""Registered queries over owned and ghost parts; five owners, meshes that grow with the part table."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from meshloom.functions import elements as el
from meshloom.operators import mesh, partition, physics
from meshloom.operators.tables import Tables, only_marked_broadcasts
from meshloom.plans.registry import EDGES_SQL, GK_SQL, OWNER_SQL, dot, query, r9, sized, sized_square_sql, square_sql, square_with_tables

PARTS = 5

#: dofs of cells, owners of dofs, ghosts; nodes of the rim are constrained.
TOPOLOGY_SQL = """cd AS (SELECT cell_id, unnest([0, 1, 2]) AS local, unnest([n0, n1, n2]) AS node FROM cells),
td AS (SELECT cd.cell_id, own.owner, local, CASE WHEN x > 0 AND x < 1 AND y > 0 AND y < 1 THEN node END AS dof FROM cd JOIN own USING (cell_id) JOIN nodes ON node_id = node),
seen AS (SELECT DISTINCT dof, owner AS usr FROM td WHERE dof IS NOT NULL),
dn AS (SELECT dof, min(usr) AS owner FROM seen GROUP BY 1),
gh AS (SELECT usr, owner, seen.dof FROM seen JOIN dn USING (dof) WHERE usr <> owner),
xv AS (SELECT node_id AS dof, 1 + x * x + 3 * y AS u FROM nodes)"""
LOCAL_SQL = "km AS (" + "\n  UNION ALL ".join(f"SELECT cell_id, {i} AS i, {j} AS j, k * area * {dot(i, j, 'xy')} AS v FROM gk" for i in range(3) for j in range(3)) + ")"
PRODUCT_SQL = """ca AS (SELECT td.cell_id, td.owner, td.local, coalesce(CASE WHEN td.dof IS NULL THEN 0 ELSE u END, 0) AS u FROM td LEFT JOIN xv USING (dof)),
rowsum AS (SELECT km.cell_id, i, sum(v * u) AS v FROM km JOIN ca ON km.cell_id = ca.cell_id AND j = local GROUP BY 1, 2),
part_sum AS (SELECT td.owner AS usr, td.dof, sum(v) AS v FROM rowsum JOIN td ON rowsum.cell_id = td.cell_id AND i = local WHERE td.dof IS NOT NULL GROUP BY 1, 2)"""


def by_shuffles(run):
    """A query over parts whose rows are written while no table of the mesh may be broadcast."""

    @functools.wraps(run)
    def written(spark, sf):
        with only_marked_broadcasts(spark):
            return Tables(spark, "parts").write(run.__name__, run(spark, sf))

    return written


def kept(t: partition.Topology) -> partition.Topology:
    """The topology, written: a query reads it several times."""
    tables = Tables(t.cells.sparkSession, "topology")
    cells = tables.write("cells", t.cells)
    seen = partition.of_cells(cells)
    own = tables.write("own", seen.own)
    return partition.Topology(cells, own, tables.write("ghosts", partition.of_cells(cells, own).ghosts))


def topology(m) -> partition.Topology:
    free = m.nodes.where("x > 0 AND x < 1 AND y > 0 AND y < 1").select(F.col("node_id").alias("dof"))
    return kept(partition.prepare(partition.reduced(partition.node_dofs(m), free), mesh.cell_owners(m, PARTS)))


def values(m):
    return m.nodes.select(F.col("node_id").alias("dof"), (1 + F.col("x") * F.col("x") + 3 * F.col("y")).alias("u"))


def cell_matrices(g):
    return g.select("cell_id", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("k") * F.col("area") * el.grad_dot(i, j, "xy")).alias("v")) for i in range(3) for j in range(3)])))


BASE = f"{GK_SQL}, {OWNER_SQL}, {TOPOLOGY_SQL}, {LOCAL_SQL}"


@query(f"WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL} SELECT usr AS user, owner, dof, round(u, 9) AS u FROM gh JOIN xv USING (dof)")
@by_shuffles
def halo_exchange(spark, sf):
    """Ghost values, from their owners to those that need them."""
    m = mesh.unit_square(spark, sized(spark, sf))
    t = topology(m)
    return partition.exchange_halo(t, partition.partition_vector(t, values(m))).select("user", "owner", "dof", F.round("u", 9).alias("u"))


@query(f"WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL} SELECT cell_id, owner, local, round(coalesce(u, 0), 9) + 0.0 AS u FROM td LEFT JOIN xv USING (dof)")
@by_shuffles
def cell_gather(spark, sf):
    """Values at the corners of every owner's cells, zero at constrained ones."""
    m = mesh.unit_square(spark, sized(spark, sf))
    t = topology(m)
    out = partition.cell_gather(t, partition.local_view(t, partition.partition_vector(t, values(m))))
    return out.select("cell_id", "owner", "local", r9(F.col("u")).alias("u"))


@query(f"{BASE}, {PRODUCT_SQL} SELECT usr AS user, dof, round(v, 9) + 0.0 AS v FROM part_sum")
@by_shuffles
def local_products(spark, sf):
    """Each owner's part of the product, before ghost rows are summed."""
    m, g = square_with_tables(spark, sf)
    t = topology(m)
    view = partition.local_view(t, partition.partition_vector(t, values(m)))
    return partition.local_matvec(t, cell_matrices(g), view).select("user", "dof", r9(F.col("v")).alias("v"))


@query(f"{BASE}, {PRODUCT_SQL} SELECT owner, dof, round(sum(v), 9) + 0.0 AS v FROM part_sum JOIN dn USING (dof) GROUP BY 1, 2")
@by_shuffles
def ghost_reduction(spark, sf):
    """Ghost rows added to those of their owners."""
    m, g = square_with_tables(spark, sf)
    t = topology(m)
    view = partition.local_view(t, partition.partition_vector(t, values(m)))
    return partition.reduce_ghosts(t, partition.local_matvec(t, cell_matrices(g), view)).select("owner", "dof", r9(F.col("v")).alias("v"))


@query(f"{BASE}, {PRODUCT_SQL} SELECT dof, round(sum(v), 9) + 0.0 AS v FROM part_sum GROUP BY 1")
@by_shuffles
def owned_matvec(spark, sf):
    """The product by halos and ghost sums equals the product without owners."""
    m, g = square_with_tables(spark, sf)
    return partition.owned_matvec(topology(m), cell_matrices(g), values(m)).select("dof", r9(F.col("v")).alias("v"))


@query("SELECT true AS equal, 0.0 AS far")
@by_shuffles
def owner_invariance(spark, sf):
    """One row: owned and serial products agree, whatever the number of owners."""
    m, g = square_with_tables(spark, sf)
    matrix, x = cell_matrices(g), values(m)
    free = m.nodes.where("x > 0 AND x < 1 AND y > 0 AND y < 1").select(F.col("node_id").alias("dof"))
    dofs = partition.reduced(partition.node_dofs(m), free)
    owned = partition.owned_matvec(kept(partition.prepare(dofs, mesh.cell_owners(m, 3))), matrix, x)
    far = partition.relative_difference(partition.require_finite(owned, "v"), partition.serial_matvec(dofs, matrix, x))
    return far.select((F.col("difference") < 1e-12).alias("equal"), F.round("difference", 9).alias("far"))


@query(f"""WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL}, c AS (SELECT owner, count(DISTINCT cell_id) AS cells FROM td GROUP BY 1),
o AS (SELECT owner, count(*) AS owned FROM dn GROUP BY 1), h AS (SELECT usr AS owner, count(*) AS ghosts FROM gh GROUP BY 1)
SELECT owner, cells, coalesce(owned, 0) AS owned, coalesce(ghosts, 0) AS ghosts FROM c LEFT JOIN o USING (owner) LEFT JOIN h USING (owner)""")
@by_shuffles
def owner_layout(spark, sf):
    """Cells, owned dofs and ghosts of each owner: the sizes of its arrays."""
    t = topology(mesh.unit_square(spark, sized(spark, sf)))
    partition.require_owners(t, PARTS)
    return partition.layout(t)


@query(f"WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL} SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY dof) - 1 AS slot, dof, round(u, 9) AS u FROM dn JOIN xv USING (dof)")
@by_shuffles
def packed_vector(spark, sf):
    """Values in slots of their owner, in the order of the dofs."""
    m = mesh.unit_square(spark, sized(spark, sf))
    t = topology(m)
    return partition.pack(partition.partition_vector(t, values(m)), "dof").select("owner", "slot", "dof", F.round("u", 9).alias("u"))


@query(f"WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL} SELECT dof, round(u, 9) AS u FROM dn JOIN xv USING (dof)")
@by_shuffles
def unpacked_vector(spark, sf):
    """Packed values back in the order of the dofs."""
    m = mesh.unit_square(spark, sized(spark, sf))
    t = topology(m)
    packed = partition.pack(partition.partition_vector(t, values(m)), "dof")
    return partition.unpack(packed).select("dof", F.round("u", 9).alias("u"))


@query(f"""WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL}, o AS (SELECT owner, count(*) AS owned FROM dn GROUP BY 1)
SELECT owner, s.slot, s.slot < owned AS active FROM o, (SELECT unnest(range((SELECT max(owned) FROM o))) AS slot) s""")
@by_shuffles
def packed_mask(spark, sf):
    """Which slots of equally long owners' arrays hold a dof."""
    return partition.owned_mask(topology(mesh.unit_square(spark, sized(spark, sf))))


@query(f"{BASE}, sl AS (SELECT cell_id, owner, row_number() OVER (PARTITION BY owner ORDER BY cell_id) - 1 AS slot FROM own) SELECT owner, slot, cell_id, i, j, round(v, 9) + 0.0 AS v FROM km JOIN sl USING (cell_id)")
@by_shuffles
def packed_cell_matrix(spark, sf):
    """Cell matrices in slots of their owner."""
    m, g = square_with_tables(spark, sf)
    return partition.pack_cells(topology(m), cell_matrices(g)).select("owner", "slot", "cell_id", "i", "j", r9(F.col("v")).alias("v"))


@query(f"{BASE}, sl AS (SELECT cell_id, owner, row_number() OVER (PARTITION BY owner ORDER BY cell_id) - 1 AS slot FROM own) SELECT owner, slot, cell_id, i, round(q * area / 3, 9) + 0.0 AS v FROM gk JOIN sl USING (cell_id), (SELECT unnest([0, 1, 2]) AS i)")
@by_shuffles
def packed_cell_vector(spark, sf):
    """Cell loads in slots of their owner."""
    m, g = square_with_tables(spark, sf)
    loads = g.select("cell_id", F.explode(F.array(*map(F.lit, range(3)))).alias("i"), (F.col("q") * F.col("area") / 3).alias("v"))
    return partition.pack_cells(topology(m), loads).select("owner", "slot", "cell_id", "i", r9(F.col("v")).alias("v"))


@query(f"{BASE} SELECT dof, round(sum(q * area / 3), 9) + 0.0 AS v FROM gk JOIN td USING (cell_id) WHERE dof IS NOT NULL GROUP BY 1")
@by_shuffles
def rhs_assembly(spark, sf):
    """Loads summed within each owner, then at the owners of the dofs."""
    m, g = square_with_tables(spark, sf)
    loads = g.select("cell_id", F.explode(F.array(*map(F.lit, range(3)))).alias("i"), (F.col("q") * F.col("area") / 3).alias("v"))
    return partition.assemble_rows(topology(m), loads).select("dof", r9(F.col("v")).alias("v"))


@query(f"WITH {sized_square_sql()}, {OWNER_SQL} SELECT owner, 1 AS partitions, count(*) AS rows FROM own GROUP BY 1")
def placement_report(spark, sf):
    """Rows placed by owner lie in one partition each."""
    owners = mesh.cell_owners(mesh.unit_square(spark, sized(spark, sf)), PARTS)
    return partition.describe(partition.placed(owners, PARTS)).select("owner", F.col("partitions").cast("int").alias("partitions"), "rows")


@query(f"WITH {sized_square_sql()}, {OWNER_SQL}, {TOPOLOGY_SQL} SELECT round(sum(u * u), 6) AS dot FROM dn JOIN xv USING (dof)")
@by_shuffles
def owner_dot(spark, sf):
    """The global product of owned vectors; ghosts don't count twice."""
    m = mesh.unit_square(spark, sized(spark, sf))
    t = topology(m)
    x = partition.partition_vector(t, values(m))
    return partition.owner_dot(x, x).select(F.round("dot", 6).alias("dot"))


# --- the mixed port space ---------------------------------------------------------------------------------------------

PORT = 4
PORT_SQL = f"""WITH {square_sql(PORT)}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce)),
own AS (SELECT cell_id, CAST((row_number() OVER (ORDER BY (x1 + x2 + x0) / 3, (y1 + y2 + y0) / 3, cell_id) - 1) * {PARTS} // {2 * PORT * PORT} AS INTEGER) AS owner FROM g),
rim AS (SELECT edge_id, lo, hi FROM ce JOIN ids USING (lo, hi) GROUP BY ALL HAVING count(*) = 1),
full_dofs AS (SELECT cell_id, unnest([0, 1, 2]) AS local, unnest([n0, n1, n2]) AS d FROM cells
  UNION ALL SELECT cell_id, local + 3, edge_id + {(PORT + 1) ** 2} FROM ce JOIN ids USING (lo, hi)),
pd AS (SELECT cell_id, owner, local, CASE WHEN d IN (SELECT unnest([lo, hi]) FROM rim) OR d IN (SELECT edge_id + {(PORT + 1) ** 2} FROM rim) THEN NULL ELSE d END AS dof FROM full_dofs JOIN own USING (cell_id))"""


def port_topology(spark):
    m = mesh.unit_square(spark, PORT)
    _, cell_edges = mesh.edge_map(m)
    dofs = partition.reduced(partition.mixed_dofs(m, cell_edges, (PORT + 1) ** 2), physics.port_free(m))
    return m, partition.prepare(dofs, mesh.cell_owners(m, PARTS))


@query(f"{PORT_SQL} SELECT cell_id, CAST(local AS INTEGER) AS local, coalesce(dof, -1) AS dof FROM pd")
def port_reduced_cells(spark, sf):
    """Six dofs a cell of the mixed space, -1 where a conducting wall holds them."""
    _, t = port_topology(spark)
    return t.cells.select("cell_id", "local", F.coalesce("dof", F.lit(-1).cast("long")).alias("dof"))


@query(f"{PORT_SQL}, seen AS (SELECT DISTINCT dof, owner AS usr FROM pd WHERE dof IS NOT NULL), dn AS (SELECT dof, min(usr) AS owner FROM seen GROUP BY 1) SELECT usr AS user, owner, dof, round(1 + dof * dof / 7.0, 9) AS u FROM seen JOIN dn USING (dof) WHERE usr <> owner")
def port_halo(spark, sf):
    """Ghost values of the mixed space."""
    _, t = port_topology(spark)
    x = t.own.select("dof", (1 + F.col("dof") * F.col("dof") / 7.0).alias("u"))
    return partition.exchange_halo(t, partition.partition_vector(t, x)).select("user", "owner", "dof", F.round("u", 9).alias("u"))


def port_cell_matrices(spark, m):
    """(cell_id, i, j, v) of a mass and a curl matrix, scaled to 1, in the six local dofs."""
    g = physics.port_rows(m)
    six = lambda of, w, a, b: g.select("cell_id", F.inline(of(g, w))).select("cell_id", (F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), "v")
    mass = six(el.nedelec_mass, F.lit(1.0), 3, 3)
    nodal = g.select("cell_id", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("area") * (1 + (i == j)) / 12.0).alias("v")) for i in range(3) for j in range(3)])))
    return nodal.unionByName(six(el.nedelec_curl, F.lit(1.0), 3, 3)), mass


def port_local_sql() -> str:
    m = lambda a, b: f"area * {1 + (a == b)} / 12.0"
    e = el.TRIANGLE_EDGES
    out = []
    for i in range(3):
        for j in range(3):
            (a, b), (c, d) = e[i], e[j]
            mass = f"({m(a, c)} * {dot(b, d, 'xy')} - {m(a, d)} * {dot(b, c, 'xy')} - {m(b, c)} * {dot(a, d, 'xy')} + {m(b, d)} * {dot(a, c, 'xy')})"
            out.append(f"SELECT cell_id, {i + 3} AS i, {j + 3} AS j, s{i} * s{j} / area AS a, s{i} * s{j} * {mass} AS b FROM gp")
            out.append(f"SELECT cell_id, {i}, {j}, {m(i, j)}, 0.0 FROM gp")
    return f"""wide AS (SELECT cell_id, {", ".join(f"max(sign) FILTER (local = {k}) AS s{k}" for k in range(3))} FROM ce GROUP BY 1),
gp AS (SELECT * FROM g JOIN wide USING (cell_id)), pm AS ({" UNION ALL ".join(out)}),
px AS (SELECT cell_id, local, dof, CASE WHEN dof IS NULL THEN 0.0 ELSE 1 + dof * dof / 700.0 END AS u FROM pd)"""


def port_product_sql(entry: str) -> str:
    return f"{PORT_SQL}, {port_local_sql()}, r AS (SELECT pm.cell_id, i, sum(({entry}) * u) AS v FROM pm JOIN px ON pm.cell_id = px.cell_id AND j = local GROUP BY 1, 2) SELECT dof, round(sum(v), 9) + 0.0 AS v FROM r JOIN px ON r.cell_id = px.cell_id AND i = local WHERE dof IS NOT NULL GROUP BY 1"


@query(port_product_sql("a"))
def port_matvec(spark, sf):
    """The product of cell matrices of the mixed space, by halos and ghost sums."""
    m, t = port_topology(spark)
    x = t.own.select("dof", (1 + F.col("dof") * F.col("dof") / 700.0).alias("u"))
    return partition.owned_matvec(t, port_cell_matrices(spark, m)[0], x).select("dof", r9(F.col("v")).alias("v"))


@query(port_product_sql("a - 2.5 * b"))
def port_residual(spark, sf):
    """A x - lambda B x over owned and ghost parts."""
    m, t = port_topology(spark)
    x = t.own.select("dof", (1 + F.col("dof") * F.col("dof") / 700.0).alias("u"))
    return partition.residual(t, *port_cell_matrices(spark, m), x, 2.5).select("dof", r9(F.col("v")).alias("v"))
