"""Meshes as tables: nodes(node_id, x, y[, z]), cells(cell_id, nodes array), facets(facet_id, nodes array)."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.functions import elements as el
from meshloom.operators.tables import Tables


class ContractError(ValueError):
    """A table breaks the contract of the data model."""


@dataclass
class Mesh:
    nodes: DataFrame
    cells: DataFrame
    facets: DataFrame | None = None
    tags: DataFrame | None = None  # (name, dim, entity_id)
    numbered_edges: DataFrame | None = None  # filled by edge_map

    @property
    def corners(self) -> int:
        return 4 if "z" in self.nodes.columns else 3


def unit_square(spark: SparkSession, n: int, width: float = 1.0, height: float = 1.0) -> Mesh:
    """2 n^2 triangles, (n+1)^2 nodes, 4n facets (bottom, right, top, left; counter-clockwise) and their tags."""
    m = n + 1
    i, j = F.col("id") % m, F.floor(F.col("id") / m)
    nodes = spark.range(m * m).select(F.col("id").alias("node_id"), (i / n * width).alias("x"), (j / n * height).alias("y"))
    ll = F.floor(F.col("id") / n) * m + F.col("id") % n
    both = F.array(F.array(ll, ll + 1, ll + m + 1), F.array(ll, ll + m + 1, ll + m))
    cells = spark.range(n * n).select("id", F.posexplode(both).alias("half", "nodes")).select((2 * F.col("id") + F.col("half")).cast("long").alias("cell_id"), "nodes")
    k, side = F.col("id") % n, F.floor(F.col("id") / n)
    start = F.when(side == 0, k).when(side == 1, k * m + n).when(side == 2, n * m + n - k).otherwise((n - k) * m)
    step = F.when(side == 0, 1).when(side == 1, m).when(side == 2, -1).otherwise(-m)
    facets = spark.range(4 * n).select(F.col("id").alias("facet_id"), F.array(start, start + step).alias("nodes"))
    named = F.element_at(F.array(*map(F.lit, ("bottom", "right", "top", "left"))), (F.floor(F.col("facet_id") / n) + 1).cast("int"))
    tags = facets.select(named.alias("name"), F.lit(1).alias("dim"), F.col("facet_id").alias("entity_id"))
    tags = tags.unionByName(cells.select(F.lit("domain").alias("name"), F.lit(2).alias("dim"), F.col("cell_id").alias("entity_id")))
    return Mesh(nodes, cells, facets, tags)


def voxel_paths() -> list[tuple[int, ...]]:
    """The tetrahedra of a voxel: one for each order of the three axes, its corners on the way from corner 0 to corner 7
    along these (bits 0, 1, 2 of a corner are x, y, z); odd orders swap two corners, so that all are positive."""
    out = []
    for order in itertools.permutations(range(3)):
        path = [0, 1 << order[0], 1 << order[0] | 1 << order[1], 7]
        odd = sum(a > b for a, b in itertools.combinations(order, 2)) % 2
        out.append(tuple(path[i] for i in ((0, 2, 1, 3) if odd else (0, 1, 2, 3))))
    return out


VOXEL = voxel_paths()


def tet_box(spark: SparkSession, nx: int, ny: int, nz: int) -> Mesh:
    """6 nx ny nz positively oriented tetrahedra in the unit cube."""
    sy, sx = nz + 1, (ny + 1) * (nz + 1)
    c = F.col("id")
    nodes = spark.range((nx + 1) * sx).select(c.alias("node_id"), (F.floor(c / sx) / nx).alias("x"), (F.floor(c / sy) % (ny + 1) / ny).alias("y"), (c % sy / nz).alias("z"))
    base = F.floor(c / (ny * nz)) * sx + F.floor(c / nz) % ny * sy + c % nz
    corner = [base + (k & 1) * sx + (k >> 1 & 1) * sy + (k >> 2) for k in range(8)]
    six = F.array(*[F.array(*[corner[v] for v in tet]) for tet in VOXEL])
    cells = spark.range(nx * ny * nz).select("id", F.posexplode(six).alias("k", "nodes")).select((6 * c + F.col("k")).cast("long").alias("cell_id"), "nodes")
    return Mesh(nodes, cells)


def gathered(cells: DataFrame, nodes: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One row per cell with its corners' ids and values side by side: a join per corner row, one regrouping."""
    axes = [a for a in ("x", "y", "z") if a in nodes.columns]
    wanted = [*axes, *extra]
    corners = len(axes) + 1
    rows = cells.select("cell_id", F.posexplode("nodes").alias("k", "node_id")).join(nodes.select("node_id", *wanted), "node_id")
    pick = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name)))
    return rows.groupBy("cell_id").agg(*[pick("node_id", k).alias(f"n{k}") for k in range(corners)], *[pick(a, k).alias(f"{a}{k}") for k in range(corners) for a in wanted])


def geometry(mesh: Mesh, nodes: DataFrame | None = None, extra: list[str] = ()) -> DataFrame:
    rows = gathered(mesh.cells, nodes if nodes is not None else mesh.nodes, extra)
    return el.tetrahedron(rows) if mesh.corners == 4 else el.triangle(rows)


def sides(mesh: Mesh) -> DataFrame:
    """(cell_id, local, nodes in local order, key sorted) of each cell's edges or faces."""
    local = el.TETRAHEDRON_FACES if mesh.corners == 4 else el.TRIANGLE_EDGES
    pick = F.array(*[F.array(*[F.col("nodes")[k] for k in side]) for side in local])
    rows = mesh.cells.select("cell_id", F.posexplode(pick).alias("local", "side"))
    return rows.select("cell_id", "local", F.col("side").alias("nodes"), F.array_sort("side").alias("key"))


def boundary_facets(mesh: Mesh) -> DataFrame:
    """(nodes, cell_id, local): sides that one cell has; more than two cells at a side fail."""
    groups = sides(mesh).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("cell_id", "local", "nodes")).alias("f"))
    checked = F.when(F.col("n") > 2, F.raise_error(F.lit("a side belongs to more than two cells")).cast("long")).otherwise(F.col("n"))
    return groups.where(checked == 1).select(F.col("f.nodes").alias("nodes"), F.col("f.cell_id").alias("cell_id"), F.col("f.local").alias("local"))


def edge_map(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """edges(edge_id, lo, hi) in lexicographic order, and cell_edges(cell_id, local, edge_id, sign)."""
    pick = F.array(*[F.struct(F.col("nodes")[a].alias("a"), F.col("nodes")[b].alias("b")) for a, b in (el.TETRAHEDRON_EDGES if mesh.corners == 4 else el.TRIANGLE_EDGES)])
    rows = mesh.cells.select("cell_id", F.posexplode(pick).alias("local", "e")).select("cell_id", "local", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"), F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1).alias("sign"))
    if mesh.numbered_edges is None:  # several queries of a mesh read them
        mesh.numbered_edges = numbered(rows.select("lo", "hi").distinct(), ["lo", "hi"], "edge_id")
    edges = mesh.numbered_edges
    return edges.select("edge_id", "lo", "hi"), rows.join(edges, ["lo", "hi"]).select("cell_id", "local", "edge_id", "sign")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows 0, 1, .. in a global order without one task seeing all rows: range partitions are written once, as
    their bounds are sampled and another evaluation might cut elsewhere; then each is counted, and the offsets of the
    partitions (one row each) are joined back."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = Tables(df.sparkSession, "numbered").write("ranged", ranged)
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_before")


def cell_owners(mesh: Mesh, parts: int) -> DataFrame:
    """(cell_id, owner): cells ranked by centroid (x, then y, then z, then id), cut in parts of equal count."""
    g = gathered(mesh.cells, mesh.nodes)
    axes = [a for a in ("x", "y", "z") if a in mesh.nodes.columns]
    mid = g.select("cell_id", *[(sum((F.col(f"{a}{k}") for k in range(1, mesh.corners)), F.col(f"{a}0")) / mesh.corners).alias(f"c{a}") for a in axes])
    ranked = numbered(mid, [*(f"c{a}" for a in axes), "cell_id"], "rank")
    total = mesh.cells.agg(F.count("*").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select("cell_id", F.floor(F.col("rank") * parts / F.col("total")).cast("int").alias("owner"))


def dof_owners(mesh: Mesh, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, owner): the least owner of a node's cells; and ghosts (owner, node_id): nodes others need of it."""
    seen = mesh.cells.select("cell_id", F.explode("nodes").alias("node_id")).join(owners, "cell_id").select("node_id", F.col("owner").alias("user")).distinct()
    own = seen.groupBy("node_id").agg(F.min("user").alias("owner"))
    ghosts = seen.join(own, "node_id").where("user <> owner").select("user", "owner", "node_id")
    return own, ghosts


def quality(mesh: Mesh) -> DataFrame:
    """One row: cells, measure, and minimum, first percentile and median of the mean ratio (exact percentiles)."""
    g = geometry(mesh)
    size = "volume" if mesh.corners == 4 else "area"
    g = g.withColumn("ratio", el.mean_ratio(g))
    return g.agg(F.count("*").alias("cells"), F.sum(size).alias("measure"), F.min("ratio").alias("least"), F.percentile("ratio", F.lit(0.01)).alias("p1"), F.percentile("ratio", F.lit(0.5)).alias("median"), F.sum(F.when(F.col("det") <= 0, 1).otherwise(0)).alias("inverted"))


def validate(mesh: Mesh) -> None:
    """Raises ContractError unless ids are in range, cells have no repeated node, positive size, and facets are the
    boundary exactly; every check is an aggregate."""
    n = mesh.corners
    bad = mesh.cells.where((F.size("nodes") != n) | (F.size(F.array_distinct("nodes")) != n)).limit(1).count()
    lost = mesh.cells.select(F.explode("nodes").alias("node_id")).join(mesh.nodes, "node_id", "left_anti").limit(1).count()
    if bad or lost:
        raise ContractError("cells repeat nodes or name nodes that are missing")
    axes = [a for a in ("x", "y", "z") if a in mesh.nodes.columns]
    finite = " and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('inf')" for a in axes)
    if mesh.nodes.where(f"not ({finite})").limit(1).count() or mesh.nodes.groupBy("node_id").count().where("count > 1").limit(1).count():
        raise ContractError("coordinates must be finite, node ids unique")
    g = geometry(mesh)
    edges = el.TETRAHEDRON_EDGES if n == 4 else el.TRIANGLE_EDGES
    longest = F.greatest(*[sum(((el.x(a, c) - el.x(b, c)) * (el.x(a, c) - el.x(b, c)) for c in axes), F.lit(0.0)) for a, b in edges])
    if g.where(~(F.abs("det") > 64 * 2.220446049250313e-16 * F.pow(longest, F.lit((n - 1) / 2)))).limit(1).count():
        raise ContractError("cells must have a size")
    if mesh.facets is not None:
        given, real = (d.select(F.array_sort("nodes").alias("key")) for d in (mesh.facets, boundary_facets(mesh)))
        if given.exceptAll(real).limit(1).count() or real.exceptAll(given).limit(1).count():
            raise ContractError("facets must be the boundary of the mesh, each once")


def conforming_faces(mesh: Mesh, regions: DataFrame, one: str, other: str) -> DataFrame:
    """Sides that cells of region ``one`` share with cells of region ``other``; regions(cell_id, region)."""
    keyed = sides(mesh).join(regions, "cell_id")
    return keyed.where(F.col("region") == one).select("key").distinct().intersect(keyed.where(F.col("region") == other).select("key").distinct())


def components(spark: SparkSession, edges: DataFrame, folder: str) -> DataFrame:
    """(node_id, root) by min-label propagation with pointer jumping over edges(lo, hi); tables in ``folder``."""
    both = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    both.write.mode("overwrite").parquet(f"{folder}/both")
    both = spark.read.parquet(f"{folder}/both")
    labels = both.select(F.col("a").alias("node_id")).distinct().withColumn("root", F.col("node_id"))
    state, k = None, 0
    while True:
        best = both.join(labels, both.b == labels.node_id).groupBy("a").agg(F.min("root").alias("near"))
        labels = labels.join(best, labels.node_id == best.a, "left").select("node_id", F.least("root", F.coalesce("near", "root")).alias("root"))
        up = labels.select(F.col("node_id").alias("root"), F.col("root").alias("jump"))
        labels = labels.join(up, "root").select("node_id", F.col("jump").alias("root"))
        labels.write.mode("overwrite").parquet(f"{folder}/labels-{k}")
        labels = spark.read.parquet(f"{folder}/labels-{k}")
        new = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if new == state:
            return labels
        state, k = new, k + 1
