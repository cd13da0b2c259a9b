"""One-way electrothermal problems on tetrahedra: current in a conductor's cells, its heat in all cells, Robin faces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assembly as asm
from . import krylov
from .mesh import ContractError, Mesh, boundary_facets, components, geometry, sides
from .physics import joule
from .tables import Tables


@dataclass(frozen=True)
class Admission:
    """Greatest relative errors of the four balances."""

    charge: float = 1e-9
    electrical: float = 1e-9
    transfer: float = 1e-12
    thermal: float = 1e-9


@dataclass
class Plan:
    """Tables of a problem: cells with conductivities, held nodes, Robin faces, and the conductor's cells by parent."""

    mesh: Mesh
    conductor: DataFrame  # (cell_id, parent_cell_id, sigma)
    thermal: DataFrame  # (cell_id, k, q)
    potential: DataFrame  # (node_id, value)
    temperature: DataFrame  # (node_id, value)
    robin: DataFrame  # (facet_id, nodes, h, ambient)


def canonical_fixed(fixed: DataFrame, label: str, required: bool = True) -> DataFrame:
    """(node_id, value), each node once; a node with two values, or none at all where some are required, is an error."""
    rows = fixed.groupBy("node_id").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    checked = rows.agg(F.count("*").alias("n"), F.max((F.col("value") != F.col("other")).cast("int")).alias("two")).first()
    if required and not checked.n:
        raise ContractError(f"{label}: no node is held")
    if checked.two:
        raise ContractError(f"{label}: a node is held at two values")
    return rows.select("node_id", "value")


def require_anchored(cells: DataFrame, fixed: DataFrame, label: str) -> None:
    """Raises unless each connected part of the cells has a held node."""
    tables = Tables(cells.sparkSession, "anchored")
    edges = cells.select(F.explode(F.transform("nodes", lambda n: F.struct(F.col("nodes")[0].alias("lo"), n.alias("hi")))).alias("e")).select("e.*").distinct()
    parts = components(cells.sparkSession, edges, tables.root)
    held = parts.join(fixed, "node_id", "left_semi").select("root").distinct()
    if parts.select("root").distinct().join(held, "root", "left_anti").limit(1).count():
        raise ContractError(f"{label}: a connected part has no held node")


def faces_at(mesh: Mesh, axis: str, value: float) -> DataFrame:
    """(facet_id, nodes) of boundary faces whose nodes all have ``axis`` at ``value``."""
    rim = boundary_facets(mesh).select((F.col("cell_id") * 4 + F.col("local")).alias("facet_id"), "nodes")
    off = rim.select("facet_id", F.explode("nodes").alias("node_id")).join(mesh.nodes.where(F.abs(F.col(axis) - value) > 1e-12), "node_id", "left_semi")
    return rim.join(off, "facet_id", "left_anti")


def oriented_boundary(mesh: Mesh, facets: DataFrame) -> DataFrame:
    """(facet_id, nodes) with the outward order of the cell's side; the facets must be the boundary, each once."""
    rim = boundary_facets(mesh).select("nodes", F.array_sort("nodes").alias("key"))
    given = facets.select("facet_id", F.array_sort("nodes").alias("key"))
    if given.select("key").exceptAll(rim.select("key")).limit(1).count() or rim.select("key").exceptAll(given.select("key")).limit(1).count():
        raise ContractError("the facets aren't the boundary of the mesh, each once")
    return given.join(rim, "key").select("facet_id", "nodes")


def prepare(plan: Plan) -> Plan:
    """The plan, checked: conductor cells are cells with one parent each, and every part is held."""
    tables = Tables(plan.mesh.cells.sparkSession, "tet4-plan")
    conductor = tables.write("conductor", plan.conductor)
    bad = conductor.join(plan.mesh.cells, conductor.parent_cell_id == plan.mesh.cells.cell_id, "left_anti").limit(1).count()
    twice = conductor.groupBy("parent_cell_id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ContractError("conductor cells need one parent each")
    potential = tables.write("potential", canonical_fixed(plan.potential, "potential"))
    temperature = tables.write("temperature", canonical_fixed(plan.temperature, "temperature"))
    require_anchored(plan.mesh.cells.join(conductor.select(F.col("parent_cell_id").alias("cell_id")), "cell_id", "left_semi"), potential, "conductor")
    return Plan(plan.mesh, conductor, tables.write("thermal", plan.thermal), potential, temperature, tables.write("robin", plan.robin))


def reaction(k: DataFrame, f: DataFrame, u: DataFrame, fixed: DataFrame) -> DataFrame:
    """(node_id, r): K u - f at the held nodes."""
    ku = k.join(u.select(F.col("node_id").alias("col"), "u"), "col").groupBy("row").agg(F.sum(F.col("v") * F.col("u")).alias("ku"))
    return ku.join(f, "row", "left").join(fixed.select(F.col("node_id").alias("row")), "row", "left_semi").select(F.col("row").alias("node_id"), (F.col("ku") - F.coalesce("v", F.lit(0.0))).alias("r"))


def solve_plan(plan: Plan) -> dict[str, DataFrame]:
    """potential(node_id, u), field per conductor cell, heat(cell_id, heat) on all cells, temperature(node_id, u),
    and one row of balances."""
    tables = Tables(plan.mesh.cells.sparkSession, "tet4")
    g = tables.write("geometry", geometry(plan.mesh))
    conductor = plan.conductor.select(F.col("parent_cell_id").alias("cell_id"), "sigma")
    inner = g.join(conductor, "cell_id")
    k1 = tables.write("k1", asm.stiffness(inner, F.col("sigma")))
    zero = k1.select("row").distinct().withColumn("v", F.lit(0.0))
    phi = tables.write("potential", krylov.solved(*asm.dirichlet(k1, zero, plan.potential.join(zero.select(F.col("row").alias("node_id")), "node_id", "left_semi"))))
    part = Mesh(plan.mesh.nodes, plan.mesh.cells.join(conductor.select("cell_id"), "cell_id", "left_semi"))
    field = tables.write("field", joule(part, phi, conductor))
    heat = tables.write("heat", g.select("cell_id", "volume").join(field.select("cell_id", "heat"), "cell_id", "left").select("cell_id", "volume", F.coalesce("heat", F.lit(0.0)).alias("heat")))
    hot = g.join(heat.select("cell_id", "heat"), "cell_id").join(plan.thermal, "cell_id")
    k2, f2 = asm.stiffness(hot, F.col("k")), asm.load(hot, F.col("heat") + F.col("q"))
    measured = asm.facet_measure(plan.robin.select("facet_id", "nodes"), plan.mesh.nodes).join(plan.robin.select("facet_id", "h", "ambient"), "facet_id")
    kr, fr = asm.robin(measured, F.col("h"), F.col("ambient"))
    k2, f2 = tables.write("k2", asm.add(k2, kr)), tables.write("f2", asm.add(f2, fr))
    temperature = tables.write("temperature", krylov.solved(*asm.dirichlet(k2, f2, plan.temperature)))
    r1 = tables.write("r1", reaction(k1, zero, phi, plan.potential)).join(plan.potential, "node_id")
    charge = r1.agg(F.abs(F.sum("r")).alias("a"), F.sum(F.abs("r")).alias("b"), F.sum(F.col("r") * F.col("value")).alias("supplied")).select((F.col("a") / F.col("b")).alias("charge"), "supplied")
    power = field.agg(F.sum(F.col("size") * F.col("heat")).alias("power"))
    moved = heat.agg(F.sum(F.col("volume") * F.col("heat")).alias("moved"))
    r2 = reaction(k2, f2, temperature, plan.temperature).agg(F.sum("r").alias("held"))
    source = hot.agg(F.sum(F.col("volume") * (F.col("heat") + F.col("q"))).alias("source"))
    rows = measured.select(F.explode(F.array(*[F.struct(F.col(f"n{i}").alias("node_id"), (F.col("h") * F.col("size") / 3).alias("w"), F.col("ambient").alias("ambient")) for i in range(3)])).alias("e")).select("e.*")
    lost = rows.join(temperature, "node_id").agg(F.sum(F.col("w") * (F.col("u") - F.col("ambient"))).alias("lost"))
    one = charge.crossJoin(power).crossJoin(moved).crossJoin(r2).crossJoin(source).crossJoin(lost)
    rel = lambda a, b: F.abs(a - b) / (F.abs(a) + F.abs(b))
    # heat put in leaves through held nodes (the reaction is what they give) and Robin faces
    balances = one.select("power", "source", "lost", "held", "charge", rel(F.col("power"), F.col("supplied")).alias("electrical"), rel(F.col("power"), F.col("moved")).alias("transfer"), rel(F.col("source") + F.col("held"), F.col("lost")).alias("thermal"))
    return {"potential": phi, "field": field, "heat": heat, "temperature": temperature, "balances": tables.write("balances", balances)}


def admitted(balances: DataFrame, policy: Admission = Admission()) -> DataFrame:
    """The balances with ``ok``: whether all are within the policy."""
    limits = {"charge": policy.charge, "electrical": policy.electrical, "transfer": policy.transfer, "thermal": policy.thermal}
    ok = F.lit(True)
    for name, most in limits.items():
        ok = ok & (F.col(name) <= most)
    return balances.withColumn("ok", ok)


def reconstructed(nodes: DataFrame, free: DataFrame, fixed: DataFrame) -> DataFrame:
    """(node_id, u) of all nodes: free(node_id, u) and held(node_id, value); nodes of neither are an error."""
    both = free.unionByName(fixed.select("node_id", F.col("value").alias("u")))
    out = nodes.select("node_id").join(both, "node_id", "left")
    return out.withColumn("u", F.when(F.col("u").isNotNull(), F.col("u")).otherwise(F.raise_error(F.lit("a node has no value")).cast("double")))


def disjoint_terminals(one: DataFrame, other: DataFrame) -> None:
    """Raises if two node sets share a node."""
    if one.select("node_id").intersect(other.select("node_id")).limit(1).count():
        raise ContractError("terminals share a node")


def shared_faces(mesh: Mesh, regions: DataFrame, one: str, other: str) -> DataFrame:
    """(key) of faces between two regions(cell_id, region)."""
    keyed = sides(mesh).join(regions, "cell_id")
    return keyed.where(F.col("region") == one).select("key").join(keyed.where(F.col("region") == other).select("key"), "key", "left_semi").distinct()
