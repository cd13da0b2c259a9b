"""Owned and ghost parts of a mesh as keyed tables: halos, ghost sums, packed layouts, placement reports.

A topology works for any element: its cells list the dof of each corner (nodes, or nodes and edges of the mixed port
space), null where the dof is constrained. Each dof belongs to the least owner among its cells; other owners that need it
hold it as a ghost. What a process mesh does by padded arrays and permutes is a join or a sum by key here, so parts may
differ in size and any number of them may run at once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .mesh import ContractError, Mesh


@dataclass
class Topology:
    """cells(cell_id, owner, local, dof), own(dof, owner), ghosts(user, owner, dof)."""

    cells: DataFrame
    own: DataFrame
    ghosts: DataFrame


# --- cells to dofs ----------------------------------------------------------------------------------------------------


def node_dofs(mesh: Mesh) -> DataFrame:
    """(cell_id, local, dof) of the nodes."""
    return mesh.cells.select("cell_id", F.posexplode("nodes").alias("local", "dof"))


def mixed_dofs(mesh: Mesh, cell_edges: DataFrame, nodes: int) -> DataFrame:
    """(cell_id, local, dof) of the mixed port space: three nodes, then three edges numbered after all nodes."""
    return node_dofs(mesh).unionByName(cell_edges.select("cell_id", (F.col("local") + 3).alias("local"), (F.col("edge_id") + nodes).alias("dof")))


def reduced(dofs: DataFrame, free: DataFrame) -> DataFrame:
    """The same cells with dofs that aren't in free(dof) null; free dofs that no cell has are an error."""
    if missing_dofs(dofs, free).limit(1).count():
        raise ContractError("a free dof belongs to no cell")
    kept = free.select(F.col("dof"), F.col("dof").alias("kept"))
    return dofs.join(kept, "dof", "left").select("cell_id", "local", F.col("kept").alias("dof"))


def missing_dofs(dofs: DataFrame, free: DataFrame) -> DataFrame:
    """Free dofs that no cell has."""
    return free.select("dof").join(dofs.select("dof").distinct(), "dof", "left_anti")


def prepare(dofs: DataFrame, owners: DataFrame) -> Topology:
    """The topology of cells(cell_id, local, dof) under owners(cell_id, owner)."""
    return of_cells(dofs.join(owners, "cell_id").select("cell_id", "owner", "local", "dof"))


def of_cells(cells: DataFrame, own: DataFrame | None = None) -> Topology:
    """The topology of cells(cell_id, owner, local, dof), with the owners of dofs where they are known."""
    seen = cells.where("dof IS NOT NULL").select("dof", F.col("owner").alias("user")).distinct()
    own = own or seen.groupBy("dof").agg(F.min("user").alias("owner"))
    return Topology(cells, own, seen.join(own, "dof").where("user <> owner").select("user", "owner", "dof"))


# --- vectors ----------------------------------------------------------------------------------------------------------


def partition_vector(topology: Topology, x: DataFrame) -> DataFrame:
    """(owner, dof, u): each value of x(dof, u) at its owner, 0 where x has none."""
    return topology.own.join(x, "dof", "left").select("owner", "dof", F.coalesce("u", F.lit(0.0)).alias("u"))


def assemble_vector(owned: DataFrame) -> DataFrame:
    """(dof, u) of (owner, dof, u); a dof that two owners hold is an error."""
    out = owned.groupBy("dof").agg(F.max("u").alias("u"), F.count("*").alias("n"))
    once = F.when(F.col("n") == 1, F.col("u")).otherwise(F.raise_error(F.lit("two owners hold a dof")).cast("double"))
    return out.select("dof", once.alias("u"))


def exchange_halo(topology: Topology, owned: DataFrame) -> DataFrame:
    """(user, owner, dof, u): owners' values at those that hold them as ghosts."""
    return topology.ghosts.join(owned, ["owner", "dof"]).select("user", "owner", "dof", "u")


def local_view(topology: Topology, owned: DataFrame) -> DataFrame:
    """(user, dof, u): all values that each owner's cells read, its own and its ghosts."""
    return owned.select(F.col("owner").alias("user"), "dof", "u").unionByName(exchange_halo(topology, owned).select("user", "dof", "u"))


def cell_gather(topology: Topology, view: DataFrame) -> DataFrame:
    """(cell_id, owner, local, u): values at the corners of each owner's cells, 0 at constrained ones."""
    cells = topology.cells.withColumnRenamed("owner", "user")
    return cells.join(view, ["user", "dof"], "left").select("cell_id", F.col("user").alias("owner"), "local", F.coalesce("u", F.lit(0.0)).alias("u"))


def local_matvec(topology: Topology, matrix: DataFrame, view: DataFrame) -> DataFrame:
    """(user, dof, v): each owner's sums over its cells; matrix(cell_id, i, j, v) holds the cells' matrices."""
    at = cell_gather(topology, view).select("cell_id", F.col("local").alias("j"), "u")
    rows = matrix.join(at, ["cell_id", "j"]).groupBy("cell_id", "i").agg(F.sum(F.col("v") * F.col("u")).alias("v"))
    return scatter(topology, rows)


def scatter(topology: Topology, rows: DataFrame) -> DataFrame:
    """(user, dof, v): local sums of cell rows(cell_id, i, v), constrained ones left out."""
    cells = topology.cells.where("dof IS NOT NULL").select("cell_id", F.col("local").alias("i"), F.col("owner").alias("user"), "dof")
    return rows.join(cells, ["cell_id", "i"]).groupBy("user", "dof").agg(F.sum("v").alias("v"))


def reduce_ghosts(topology: Topology, partial: DataFrame) -> DataFrame:
    """(owner, dof, v): the sums of all users at the owner."""
    return partial.join(topology.own, "dof").groupBy("owner", "dof").agg(F.sum("v").alias("v"))


def owned_matvec(topology: Topology, matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(dof, v) of the product by halo exchange, local products and ghost sums; the same for any owners."""
    view = local_view(topology, partition_vector(topology, x))
    return reduce_ghosts(topology, local_matvec(topology, matrix, view)).select("dof", "v")


def serial_matvec(dofs: DataFrame, matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(dof, v) of the product without owners: one gather, one sum."""
    at = dofs.join(x, "dof", "left").select("cell_id", F.col("local").alias("j"), F.coalesce("u", F.lit(0.0)).alias("u"))
    rows = matrix.join(at, ["cell_id", "j"]).groupBy("cell_id", "i").agg(F.sum(F.col("v") * F.col("u")).alias("v"))
    return rows.join(dofs.where("dof IS NOT NULL").withColumnRenamed("local", "i"), ["cell_id", "i"]).groupBy("dof").agg(F.sum("v").alias("v"))


def assemble_rows(topology: Topology, rows: DataFrame) -> DataFrame:
    """(dof, v): loads of cells(cell_id, i, v) summed in each owner, then at the owner of the dof."""
    return reduce_ghosts(topology, scatter(topology, rows)).select("dof", "v")


def residual(topology: Topology, stiffness: DataFrame, mass: DataFrame, x: DataFrame, eigenvalue: float) -> DataFrame:
    """(dof, v) of A x - lambda B x, in one pass over the cells."""
    both = stiffness.unionByName(mass.withColumn("v", -eigenvalue * F.col("v"))).groupBy("cell_id", "i", "j").agg(F.sum("v").alias("v"))
    return owned_matvec(topology, both, x)


def owner_dot(owned: DataFrame, other: DataFrame) -> DataFrame:
    """One row (dot): the product of two vectors(owner, dof, u), each dof counted at its owner only."""
    return owned.join(other.withColumnRenamed("u", "w"), ["owner", "dof"]).agg(F.sum(F.col("u") * F.col("w")).alias("dot"))


# --- packed layouts ---------------------------------------------------------------------------------------------------


def layout(topology: Topology) -> DataFrame:
    """(owner, cells, owned, ghosts) of each owner."""
    cells = topology.cells.groupBy("owner").agg(F.countDistinct("cell_id").alias("cells"))
    owned = topology.own.groupBy("owner").agg(F.count("*").alias("owned"))
    ghosts = topology.ghosts.groupBy(F.col("user").alias("owner")).agg(F.count("*").alias("ghosts"))
    zero = F.lit(0).cast("long")
    out = cells.join(owned, "owner", "left").join(ghosts, "owner", "left")
    return out.select("owner", "cells", F.coalesce("owned", zero).alias("owned"), F.coalesce("ghosts", zero).alias("ghosts"))


def layout_digest(topology: Topology) -> str:
    """SHA-256 over the owners of all dofs, in the order of the dofs; independent of partitions and of row order."""
    rows = topology.own.select(F.sha2(F.concat_ws(":", "dof", "owner"), 256).alias("h"))
    # sums of hash words don't depend on order
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    return hashlib.sha256(",".join(str(w) for w in rows.agg(*words, F.count("*")).first()).encode()).hexdigest()


def pack(values: DataFrame, key: str) -> DataFrame:
    """Adds ``slot``: rows(owner, key, ...) numbered within their owner by key."""
    return values.withColumn("slot", (F.row_number().over(Window.partitionBy("owner").orderBy(key)) - 1).cast("long"))


def pack_cells(topology: Topology, rows: DataFrame) -> DataFrame:
    """rows(cell_id, ...) with the owner of their cell and the cell's slot there."""
    slots = pack(topology.cells.select("owner", "cell_id").distinct(), "cell_id")
    return rows.join(slots, "cell_id")


def owned_mask(topology: Topology) -> DataFrame:
    """(owner, slot, active): slots up to the largest owner's count; those that hold a dof are active."""
    sizes = layout(topology).select("owner", "owned")
    most = sizes.agg(F.max("owned").alias("most"))
    out = sizes.crossJoin(F.broadcast(most)).select("owner", "owned", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("slot"))
    return out.select("owner", "slot", (F.col("slot") < F.col("owned")).alias("active"))


def unpack(packed: DataFrame) -> DataFrame:
    """(dof, u) of packed values(owner, slot, dof, u), in the order of the dofs."""
    return assemble_vector(packed.select("owner", "dof", "u"))


# --- placement --------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, parts: int) -> DataFrame:
    """rows(owner, ...) with each owner in the partition of its number."""
    return rows.repartitionById(parts, F.col("owner").cast("int"))


def describe(rows: DataFrame) -> DataFrame:
    """(owner, partitions, rows): in how many partitions each owner's rows lie, and how many they are."""
    at = rows.select("owner", F.spark_partition_id().alias("part"))
    return at.groupBy("owner").agg(F.countDistinct("part").alias("partitions"), F.count("*").alias("rows"))


def require_owners(topology: Topology, parts: int) -> None:
    """Raises unless every owner 0 .. parts - 1 has cells and no other has."""
    found = topology.cells.agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.countDistinct("owner").alias("n")).first()
    if (found.a, found.b, found.n) != (0, parts - 1, parts):
        raise ContractError("the owners aren't the partitions")


#: Rows that are replicated to every task at most.
REPLICATED_ROWS = 1 << 20


def replicated(rows: DataFrame, most: int = REPLICATED_ROWS) -> DataFrame:
    """The rows, marked to be sent to every task; more than ``most`` are an error."""
    if rows.limit(most + 1).count() > most:
        raise ContractError(f"more than {most} rows aren't replicated")
    return F.broadcast(rows)


def relative_difference(observed: DataFrame, expected: DataFrame, key: str = "dof", value: str = "v") -> DataFrame:
    """One row (difference): |observed - expected| / |expected| as norms, missing rows counting as 0."""
    zero = F.lit(0.0)
    o, e = observed.select(key, F.col(value).alias("_o")), expected.select(key, F.col(value).alias("_e"))
    both = o.join(e, key, "full").select(F.coalesce("_o", zero).alias("o"), F.coalesce("_e", zero).alias("e"))
    out = both.agg(F.sqrt(F.sum(F.pow(F.col("o") - F.col("e"), 2.0))).alias("d"), F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("n"))
    return out.select(F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(F.when(F.col("d") > 0, F.lit(float("inf"))).otherwise(0.0)).alias("difference"))


def require_finite(rows: DataFrame, *names: str) -> DataFrame:
    """The rows; evaluating one with a null, NaN or infinite value fails."""
    for name in names:
        ok = F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))
        rows = rows.withColumn(name, F.when(ok, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast("double")))
    return rows
