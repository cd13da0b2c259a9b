"""Typed problems and the Spark backends that solve them."""

from __future__ import annotations

import importlib.util
import math
import platform
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assembly as asm
from . import krylov, port
from .contracts import Capabilities, Parameter, Reference, constraints, free_nodes, on_cells, repeats, resolve
from .evidence import digest
from .mesh import ContractError, Mesh, geometry, validate
from .physics import joule
from .tables import Tables

Coefficient = float | Reference


def name_of(value: str, label: str) -> str:
    if not isinstance(value, str) or not value or value != value.strip():
        raise ContractError(f"{label}: a name without outer blanks is needed")
    return value


def coefficient(value: Coefficient, label: str, positive: bool = False) -> Coefficient:
    if isinstance(value, Reference):
        name_of(value.name, label)
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or positive and value <= 0:
        raise ContractError(f"{label}: a finite{' positive' * positive} number or a parameter is needed")
    return float(value)


def coefficient_data(value: Coefficient):
    return {"parameter": value.name} if isinstance(value, Reference) else value


def unique_tags(tags: list[str], label: str) -> None:
    if not tags or len(set(tags)) != len(tags):
        raise ContractError(f"{label}: tags must be there, each once")


def coefficient_from_vector(value: Coefficient, names: list[str], vector: list[float]) -> float:
    """The number of a literal, or the entry of a parameter vector in schema order."""
    return vector[names.index(value.name)] if isinstance(value, Reference) else value


def full_vector(parameters: list[Parameter], values: dict[str, float]) -> list[float]:
    """Values in schema order; every parameter and no other must be given."""
    if set(values) != {p.name for p in parameters}:
        raise ContractError("the parameters given aren't those of the schema")
    return [float(values[p.name]) for p in parameters]


@dataclass(frozen=True)
class ActiveBinding:
    """Design and control parameters of a schema: vectors of them alone, and back to whole ones."""

    parameters: tuple[Parameter, ...]

    @property
    def active(self) -> list[int]:
        return [i for i, p in enumerate(self.parameters) if p.role != "fixed"]

    def project(self, full: list[float]) -> list[float]:
        return [full[i] for i in self.active]

    def embed(self, part: list[float]) -> list[float]:
        """The whole vector, NaN throughout where a part is outside its parameter's bounds."""
        out = [p.value for p in self.parameters]
        for i, v in zip(self.active, part, strict=True):
            out[i] = float(v)
        ok = all(p.lower <= v <= p.upper for p, v in zip(self.parameters, out))
        return out if ok else [math.nan] * len(out)


def integers(df: DataFrame, name: str) -> DataFrame:
    """The table, if the column is of a whole-number type."""
    if dict(df.dtypes)[name] not in ("tinyint", "smallint", "int", "bigint"):
        raise ContractError(f"{name} isn't of a whole-number type")
    return df


def shape_of(value) -> tuple[int, ...]:
    """Lengths of nested lists; ragged ones are an error."""
    if not isinstance(value, (list, tuple)):
        return ()
    inner = {shape_of(x) for x in value}
    if len(inner) > 1:
        raise ContractError("a ragged list has no shape")
    return (len(value), *next(iter(inner), ()))


@dataclass(frozen=True)
class ExecutionPolicy:
    """What a run may do; nothing by default."""

    authorized: bool = False
    external: bool = False
    accelerator: bool = False
    network: bool = False

    def require(self, *needs: str) -> None:
        lacks = [n for n in ("authorized", *needs) if not getattr(self, n)]
        if lacks:
            raise ContractError(f"not permitted: {', '.join(lacks)}")


# --- problems ---------------------------------------------------------------------------------------------------------


class Physics(Protocol):
    kind: str

    def requirements(self) -> Capabilities: ...

    def validate(self, mesh: Mesh) -> None: ...

    def data(self) -> dict: ...


class Backend(Protocol):
    name: str

    def capabilities(self) -> Capabilities: ...

    def solve(self, problem, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame: ...


WeakForm = Callable[[DataFrame], DataFrame]  # geometry rows -> (row, col, v) or (row, v)
Preconditioner = Callable[[DataFrame], DataFrame]  # (node_id, r) -> (node_id, z)


def needs(space: str, analysis: str = "steady", scalar: str = "real", gradient: str = "none") -> Capabilities:
    return Capabilities(frozenset([analysis]), frozenset([space]), frozenset([scalar]), frozenset([gradient]))


@dataclass(frozen=True)
class Steady:
    """What heat and current share: regions with coefficients, held boundaries, boundaries with a flux into the body."""

    regions: dict[str, dict[str, Coefficient]]
    held: dict[str, Coefficient]
    fluxes: dict[str, Coefficient] = field(default_factory=dict)
    gradient: str = "none"
    kind = "steady"
    positive: tuple[str, ...] = ()
    free: tuple[str, ...] = ()

    def __post_init__(self):
        unique_tags(list(self.regions), "regions")
        unique_tags(list(self.held), "held boundaries")
        if set(self.held) & set(self.fluxes):
            raise ContractError("a boundary can't be held and have a flux")
        for tag, values in self.regions.items():
            if set(values) != {*self.positive, *self.free}:
                raise ContractError(f"{tag}: other coefficients than {(*self.positive, *self.free)}")
            for n, v in values.items():
                coefficient(v, f"{tag}.{n}", n in self.positive)
        for tag, v in {**self.held, **self.fluxes}.items():
            coefficient(v, name_of(tag, "boundary"))

    def requirements(self) -> Capabilities:
        return needs("H1", gradient=self.gradient)

    def data(self) -> dict:
        of = lambda d: {k: coefficient_data(v) for k, v in d.items()}
        return {"kind": self.kind, "regions": {k: of(v) for k, v in self.regions.items()}, "held": of(self.held), "fluxes": of(self.fluxes), "gradient": self.gradient}

    def digest(self) -> str:
        return digest(self.data())

    def tables(self, mesh: Mesh, parameters: dict[str, Parameter]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cell_id, <coefficients>), held (node_id, value) and fluxes (facet_id, g); all tags must exist, the regions cover
        every cell once, a node is held at one value, and a node stays free."""
        validate(mesh)
        cells = None
        for n in (*self.positive, *self.free):
            part = on_cells(mesh, {t: resolve(v[n], parameters, n in self.positive) for t, v in self.regions.items()}, n)
            cells = part if cells is None else cells.join(part, "cell_id")
        held = constraints(mesh, {t: resolve(v, parameters) for t, v in self.held.items()})
        if not free_nodes(mesh, held).limit(1).count():
            raise ContractError("no node is free")
        known = {r.name for r in mesh.tags.where(F.col("dim") == mesh.corners - 2).select("name").distinct().limit(10_000).collect()}
        if {*self.held, *self.fluxes} - known:
            raise ContractError("a boundary has no such tag")
        rows = mesh.cells.sparkSession.createDataFrame([(t, resolve(v, parameters)) for t, v in self.fluxes.items()], "name string, g double")
        flux = mesh.tags.where(F.col("dim") == mesh.corners - 2).join(F.broadcast(rows), "name").select(F.col("entity_id").alias("facet_id"), "g")
        if repeats(flux, "facet_id"):
            raise ContractError("a facet has two fluxes")
        return cells, held, flux

    def validate(self, mesh: Mesh, parameters: dict[str, Parameter] | None = None) -> None:
        self.tables(mesh, parameters or {})


@dataclass(frozen=True)
class SteadyHeat(Steady):
    kind = "steady_heat"
    positive: tuple[str, ...] = ("k",)
    free: tuple[str, ...] = ("q",)


@dataclass(frozen=True)
class SteadyCurrent(Steady):
    kind = "steady_current"
    positive: tuple[str, ...] = ("sigma",)


@dataclass(frozen=True)
class PortEigenmode:
    """Modes of a closed guide: relative permittivity and permeability of the regions, conducting walls all around."""

    regions: dict[str, dict[str, Coefficient]]
    walls: list[str]
    frequency: Coefficient
    modes: int
    selected: int = 0
    power: float = 1.0
    kind = "port_eigenmode"

    def __post_init__(self):
        unique_tags(list(self.regions), "regions")
        unique_tags(self.walls, "walls")
        coefficient(self.frequency, "frequency", True)
        coefficient(self.power, "power", True)
        if not 0 <= self.selected < self.modes:
            raise ContractError("the selected mode isn't one of those asked for")
        for tag, v in self.regions.items():
            if set(v) != {"eps_r", "mu_r"}:
                raise ContractError(f"{tag}: eps_r and mu_r are needed")
            for n, c in v.items():
                coefficient(c, f"{tag}.{n}", True)

    def requirements(self) -> Capabilities:
        return needs("Hcurl", "eigenmode", "complex")

    def data(self) -> dict:
        return {"kind": self.kind, "regions": {t: {n: coefficient_data(c) for n, c in v.items()} for t, v in self.regions.items()}, "walls": self.walls, "frequency": coefficient_data(self.frequency), "modes": self.modes, "selected": self.selected, "power": self.power}

    def digest(self) -> str:
        return digest(self.data())

    def materials(self, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame:
        """(cell_id, eps_r, mu_r)."""
        eps, mu = (on_cells(mesh, {t: resolve(v[n], parameters, True) for t, v in self.regions.items()}, n) for n in ("eps_r", "mu_r"))
        return eps.join(mu, "cell_id")

    def validate(self, mesh: Mesh, parameters: dict[str, Parameter] | None = None) -> None:
        """The regions cover every cell, the walls every boundary facet."""
        validate(mesh)
        self.materials(mesh, parameters or {})
        resolve(self.frequency, parameters or {}, True)
        walls = mesh.tags.where((F.col("dim") == 1) & F.col("name").isin(*self.walls)).select(F.col("entity_id").alias("facet_id"))
        if repeats(walls, "facet_id") or mesh.facets.join(walls, "facet_id", "left_anti").limit(1).count():
            raise ContractError("walls must cover the whole boundary once")


# --- backends ---------------------------------------------------------------------------------------------------------


def steady_solution(problem: Steady, mesh: Mesh, parameters: dict[str, Parameter], stiff: str, source: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """u(node_id, u) with the system K, f and the tables behind it."""
    tables = Tables(mesh.cells.sparkSession, problem.kind)
    cells, held, flux = problem.tables(mesh, parameters)
    g = tables.write("geometry", geometry(mesh).join(cells, "cell_id"))
    held = tables.write("held", held)
    k = tables.write("k", asm.stiffness(g, F.col(stiff)))
    f = asm.load(g, F.col(source) if source else F.lit(0.0))
    if problem.fluxes:
        measured = asm.facet_measure(mesh.facets.join(flux, "facet_id", "left_semi"), mesh.nodes).join(flux, "facet_id")
        f = asm.add(f, asm.flux_load(measured, F.col("g")))
    f = tables.write("f", f)
    u = tables.write("u", krylov.solved(*asm.dirichlet(k, f, held)))
    return u, k, f, held, cells


class SparkHeat:
    name = "spark-heat"

    def capabilities(self) -> Capabilities:
        return Capabilities(frozenset(["steady"]), frozenset(["H1"]), frozenset(["real"]), frozenset(["none", "adjoint"]))

    def solve(self, problem: SteadyHeat, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame:
        """(node_id, u): the temperature."""
        return steady_solution(problem, mesh, parameters, "k", "q")[0]


class SparkCurrent:
    name = "spark-current"
    capabilities = SparkHeat.capabilities

    def solve(self, problem: SteadyCurrent, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame:
        return steady_solution(problem, mesh, parameters, "sigma", None)[0]

    def report(self, problem: SteadyCurrent, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame:
        """One row: Joule power, power given by held nodes and fluxes, their relative difference, and the backward error."""
        u, k, f, held, cells = steady_solution(problem, mesh, parameters, "sigma", None)
        power = joule(mesh, u, cells).agg(F.sum(F.col("size") * F.col("heat")).alias("power"))
        at = u.select(F.col("node_id").alias("col"), "u")
        ku = k.join(at, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("u")).alias("ku"), F.sum(F.abs(F.col("v")) * F.abs("u")).alias("size"))
        r = ku.join(f.withColumnRenamed("v", "f"), "row", "left").join(u.select(F.col("node_id").alias("row"), "u"), "row").join(held.select(F.col("node_id").alias("row"), F.lit(True).alias("is_held")), "row", "left")
        r = r.withColumn("r", F.col("ku") - F.coalesce("f", F.lit(0.0)))
        given = F.sum(F.coalesce("f", F.lit(0.0)) * F.col("u") + F.when(F.col("is_held"), F.col("r") * F.col("u")).otherwise(0.0)).alias("given")
        error = (F.sqrt(F.sum(F.when(F.col("is_held").isNull(), F.col("r") * F.col("r")))) / F.sqrt(F.sum(F.pow(F.col("size") + F.abs(F.coalesce("f", F.lit(0.0))), 2.0)))).alias("backward_error")
        out = power.crossJoin(r.agg(given, error))
        return out.withColumn("imbalance", F.abs(F.col("power") - F.col("given")) / (F.abs("power") + F.abs("given")))


class SparkPort:
    name = "spark-port"

    def capabilities(self) -> Capabilities:
        return Capabilities(frozenset(["eigenmode"]), frozenset(["Hcurl"]), frozenset(["complex"]), frozenset(["none", "adjoint"]))

    def solve(self, problem: PortEigenmode, mesh: Mesh, parameters: dict[str, Parameter]) -> DataFrame:
        """(mode, beta_re, beta_im, residual) of a guide with one material."""
        import numpy as np
        import pandas as pd

        problem.validate(mesh, parameters)
        if len(problem.regions) != 1:
            raise ContractError("this backend takes one material")
        values = next(iter(problem.regions.values()))
        case = (0, resolve(problem.frequency, parameters, True), resolve(values["eps_r"], parameters, True), resolve(values["mu_r"], parameters, True))
        spark = mesh.cells.sparkSession
        rows = port.kernel_rows(mesh, spark.createDataFrame([case], "case_id long, frequency double, eps_r double, mu_r double"))
        nodes, count = mesh.nodes.count(), problem.modes

        def run(part: pd.DataFrame) -> pd.DataFrame:
            _, beta, _, res = port.modes_of(part.sort_values("cell_id"), nodes, count)
            return pd.DataFrame({"mode": np.arange(len(beta)), "beta_re": beta.real, "beta_im": beta.imag, "residual": res})

        return rows.groupBy("case_id").applyInPandas(run, "mode long, beta_re double, beta_im double, residual double")


# --- the environment --------------------------------------------------------------------------------------------------


def doctor(require: frozenset[str] = frozenset()) -> list[dict]:
    """What is installed, without loading or running any of it."""
    out = [{"name": "python", "available": sys.version_info >= (3, 11), "detail": platform.python_version(), "required": True}]
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb"):
        found = importlib.util.find_spec(name) is not None
        out.append({"name": name, "available": found, "detail": "installed" if found else "not installed", "required": name in require or name in ("pyspark", "pyarrow", "pandas", "numpy")})
    return out
