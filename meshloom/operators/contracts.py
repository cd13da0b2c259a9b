"""Contracts of problems: parameters, coefficients, regions, constraints, capabilities, workflows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import ContractError, Mesh

ROLES = ("fixed", "design", "control")


@dataclass(frozen=True)
class Parameter:
    name: str
    unit: str
    value: float
    role: str = "fixed"
    lower: float = -math.inf
    upper: float = math.inf

    def __post_init__(self):
        if self.role not in ROLES or not self.lower <= self.upper:
            raise ContractError(f"parameter {self.name}: unknown role or empty bounds")
        if isinstance(self.value, bool) or not math.isfinite(self.value) or not self.lower <= self.value <= self.upper:
            raise ContractError(f"parameter {self.name}: value is no finite number within its bounds")


@dataclass(frozen=True)
class Reference:
    """A coefficient that is resolved by a parameter's name."""

    name: str


def resolve(value: float | Reference, parameters: dict[str, Parameter], positive: bool = False) -> float:
    if isinstance(value, Reference):
        if value.name not in parameters:
            raise ContractError(f"no parameter {value.name}")
        value = parameters[value.name].value
    if isinstance(value, bool) or not math.isfinite(value) or (positive and value <= 0):
        raise ContractError("a coefficient must be finite" + " and positive" * positive)
    return float(value)


def active(parameters: list[Parameter]) -> list[Parameter]:
    """Design and control parameters in schema order."""
    names = [p.name for p in parameters]
    if len(set(names)) != len(names):
        raise ContractError("parameter names must be unique")
    return [p for p in parameters if p.role != "fixed"]


def on_cells(mesh: Mesh, regions: dict[str, float], name: str) -> DataFrame:
    """(cell_id, <name>): coefficients by region tag; the tags must cover every cell exactly once."""
    spark = mesh.cells.sparkSession
    table = spark.createDataFrame(list(regions.items()), f"name string, {name} double")
    top = 3 if mesh.corners == 4 else 2
    tagged = mesh.tags.where(F.col("dim") == top).join(F.broadcast(table), "name").select(F.col("entity_id").alias("cell_id"), name)
    if repeats(tagged, "cell_id") or mesh.cells.join(tagged, "cell_id", "left_anti").limit(1).count():
        raise ContractError("regions must cover every cell exactly once")
    return tagged


def repeats(df: DataFrame, key: str) -> bool:
    return bool(df.groupBy(key).count().where("count > 1").limit(1).count())


def constraints(mesh: Mesh, values: dict[str, float]) -> DataFrame:
    """(node_id, value) of boundary tags with fixed values; nodes that two tags fix differently fail."""
    spark = mesh.nodes.sparkSession
    table = spark.createDataFrame(list(values.items()), "name string, value double")
    rows = mesh.tags.where(F.col("dim") == mesh.corners - 2).join(F.broadcast(table), "name").join(mesh.facets, F.col("entity_id") == F.col("facet_id"))
    nodes = rows.select("value", F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n"))
    if nodes.where("n > 1").limit(1).count():
        raise ContractError("a node has two fixed values")
    return nodes.select("node_id", "value")


def free_nodes(mesh: Mesh, fixed: DataFrame) -> DataFrame:
    return mesh.nodes.select("node_id").join(fixed, "node_id", "left_anti")


def facet_cells(mesh: Mesh) -> DataFrame:
    """(facet_id, cell_id, local nodes' positions): each facet with its only cell."""
    from .mesh import sides

    keyed = mesh.facets.select("facet_id", F.array_sort("nodes").alias("key"), F.col("nodes").alias("facet_nodes"))
    rows = sides(mesh).join(keyed, "key").join(mesh.cells.withColumnRenamed("nodes", "cell_nodes"), "cell_id")
    rows = rows.select("facet_id", "cell_id", F.transform("facet_nodes", lambda n: (F.array_position("cell_nodes", n) - 1).cast("int")).alias("positions"))
    return rows


def transferred(thermal: DataFrame, current: DataFrame) -> DataFrame:
    """Joule heat on the thermal cells: current(parent_cell_id, heat) by parent, zero elsewhere."""
    return thermal.join(current, thermal.cell_id == current.parent_cell_id, "left").select("cell_id", F.coalesce("heat", F.lit(0.0)).alias("heat"))


def unanchored(components: DataFrame, fixed: DataFrame) -> DataFrame:
    """Roots of connected components(node_id, root) without a fixed node."""
    held = components.join(fixed, "node_id", "left_semi").select("root").distinct()
    return components.select("root").distinct().join(held, "root", "left_anti")


@dataclass(frozen=True)
class Capabilities:
    analyses: frozenset = frozenset()
    spaces: frozenset = frozenset()
    scalars: frozenset = frozenset()
    gradients: frozenset = frozenset()

    def missing(self, other: Capabilities) -> dict[str, list[str]]:
        """What ``other`` asks for and this lacks."""
        lacks = {k: sorted(getattr(other, k) - getattr(self, k)) for k in ("analyses", "spaces", "scalars", "gradients")}
        return {k: v for k, v in lacks.items() if v}


@dataclass
class Backends:
    """Named solvers with their capabilities; lookups fail rather than fall back."""

    known: dict[str, tuple[Capabilities, Callable]] = field(default_factory=dict)

    def add(self, name: str, has: Capabilities, solve: Callable) -> None:
        if name in self.known:
            raise ContractError(f"{name} is registered already")
        self.known[name] = (has, solve)

    def names(self) -> list[str]:
        return sorted(self.known)

    def get(self, name: str, needs: Capabilities) -> Callable:
        if name not in self.known:
            raise ContractError(f"no backend {name}")
        if lacks := self.known[name][0].missing(needs):
            raise ContractError(f"{name} lacks {lacks}")
        return self.known[name][1]


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    quantity: str
    unit: str


def ordered(nodes: list[str], edges: list[Edge]) -> list[str]:
    """Topological order, the smallest ready name first; an input has one producer, units agree, no cycles."""
    if len(set(nodes)) != len(nodes) or any(e.source not in nodes or e.target not in nodes for e in edges):
        raise ContractError("workflow nodes must be unique and known")
    if len({(e.target, e.quantity) for e in edges}) != len(edges) or len({e.quantity for e in edges}) != len({(e.quantity, e.unit) for e in edges}):
        raise ContractError("an input has two producers, or a quantity two units")
    waits = {n: sum(e.target == n for e in edges) for n in nodes}
    ready, out = [n for n in nodes if not waits[n]], []
    heapq.heapify(ready)
    while ready:
        out.append(now := heapq.heappop(ready))
        for e in edges:
            if e.source == now:
                waits[e.target] -= 1
                if not waits[e.target]:
                    heapq.heappush(ready, e.target)
    if len(out) != len(nodes):
        raise ContractError("the workflow has a cycle")
    return out
