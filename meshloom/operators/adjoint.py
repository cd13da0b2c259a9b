"""Gradients by adjoints: one transposed solve a functional, then sums of multiplier times residual derivative.

Stiffness, load and held values are affine in their coefficients, so the derivative of a residual with respect to a cell's
coefficient is a local row, and a gradient is a join and a sum. Systems of many cases use one group a case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el

from . import assembly as asm
from . import krylov, solve
from .mesh import Mesh, geometry
from .tables import Tables


def implicit_solve(systems: DataFrame) -> DataFrame:
    """For dense systems(case_id, row, col, a, b, seed), b and seed on the diagonal rows: (case_id, row, x, multiplier) with
    A x = b and A^T multiplier = seed. The pullbacks are multiplier for b, and -multiplier x^T for A."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(part["row"])
        i, j = (np.searchsorted(ids, part[c].to_numpy()) for c in ("row", "col"))
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (i, j), part["a"].to_numpy())
        diag = part[part["row"] == part["col"]].sort_values("row")
        return pd.DataFrame({"case_id": key[0], "row": ids, "x": np.linalg.solve(a, diag["b"].to_numpy()), "multiplier": np.linalg.solve(a.T, diag["seed"].to_numpy())})

    return systems.groupBy("case_id").applyInPandas(run, "case_id long, row long, x double, multiplier double")


def affine_coefficients(base: DataFrame, weights: DataFrame, parameters: DataFrame) -> DataFrame:
    """(cell_id, value): base(cell_id, value) plus the sum of weights(cell_id, name, w) times parameters(name, p); a weight
    without its parameter is an error."""
    rows = weights.join(F.broadcast(parameters), "name", "left")
    part = F.when(F.col("p").isNotNull(), F.col("w") * F.col("p")).otherwise(F.raise_error(F.concat(F.lit("no parameter "), F.col("name"))).cast("double"))
    moved = rows.groupBy("cell_id").agg(F.sum(part).alias("moved"))
    return base.join(moved, "cell_id", "left").select("cell_id", (F.col("value") + F.coalesce("moved", F.lit(0.0))).alias("value"))


class ScalarState:
    """-div k grad u = q on a mesh, u held at some nodes: the state, and pullbacks of functionals of it.

    coefficients(cell_id, k, q); fixed(node_id, value). A pullback is linear in its cotangent(node_id, w) = dJ/du.
    """

    def __init__(self, mesh: Mesh, coefficients: DataFrame, fixed: DataFrame, extra_source: DataFrame | None = None):
        self.mesh = mesh
        self.tables = Tables(mesh.cells.sparkSession, "adjoint")
        if extra_source is not None:
            coefficients = coefficients.join(extra_source, "cell_id", "left").select("cell_id", "k", (F.col("q") + F.coalesce("source", F.lit(0.0))).alias("q"))
        self.cells = self.tables.write("cells", geometry(mesh).join(coefficients, "cell_id"))
        self.fixed = self.tables.write("fixed", fixed.select("node_id", "value"))
        self.k = self.tables.write("k", asm.stiffness(self.cells, F.col("k")))
        self.f = self.tables.write("f", asm.load(self.cells, F.col("q")))
        self.u = self.tables.write("u", self.solved(*asm.dirichlet(self.k, self.f, self.fixed), "u"))

    def solved(self, k: DataFrame, f: DataFrame, name: str) -> DataFrame:
        return krylov.solved(k, f).select("node_id", F.col("u").alias(name))

    def multiplier(self, cotangent: DataFrame, name: str = "lam") -> DataFrame:
        """(node_id, lam): K lam = w on free nodes, 0 on held ones (K is symmetric)."""
        held = self.fixed.withColumn("value", F.lit(0.0))
        load = cotangent.select(F.col("node_id").alias("row"), F.col("w").alias("v"))
        return self.tables.write(name, self.solved(*asm.dirichlet(self.k, load, held), name))

    def pullback(self, cotangent: DataFrame, name: str = "lam") -> tuple[DataFrame, DataFrame]:
        """(cell_id, d_k, d_q) and (node_id, d_value): derivatives with respect to coefficients and held values."""
        lam = self.multiplier(cotangent, name)
        nodal = lam.select("node_id", F.col(name).alias("lam")).join(self.u, "node_id")
        rows = geometry(self.mesh, self.mesh.nodes.join(nodal, "node_id"), ["u", "lam"])
        n, axes, size = el.shape(rows)
        u, m = el.gradient(rows, "u"), el.gradient(rows, "lam")
        inner = sum((u[a] * m[a] for a in axes), F.lit(0.0))
        mean = sum((F.col(f"lam{i}") for i in range(n)), F.lit(0.0)) / n
        cells = rows.select("cell_id", (-F.col(size) * inner).alias("d_k"), (F.col(size) * mean).alias("d_q"))
        # a held value moves the state through its column of K, and counts itself
        moved = self.k.join(lam.select(F.col("node_id").alias("row"), F.col(name).alias("lam")), "row").groupBy("col").agg(F.sum(F.col("v") * F.col("lam")).alias("s"))
        held = self.fixed.join(moved, F.col("node_id") == F.col("col"), "left").join(cotangent, "node_id", "left")
        return cells, held.select("node_id", (F.coalesce("w", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("d_value"))


class CurrentState(ScalarState):
    """A potential with conductivity k and no source: its Joule heat per cell, and pullbacks through both."""

    def joule(self) -> DataFrame:
        """(cell_id, heat, size): k |grad u|^2."""
        rows = geometry(self.mesh, self.mesh.nodes.join(self.u, "node_id"), ["u"]).join(self.cells.select("cell_id", "k"), "cell_id")
        _, axes, size = el.shape(rows)
        g = el.gradient(rows, "u")
        return rows.select("cell_id", (F.col("k") * sum((g[a] * g[a] for a in axes), F.lit(0.0))).alias("heat"), F.col(size).alias("size"))

    def pullback_joule(self, cotangent: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Derivatives for cotangent(cell_id, w) = dJ/d heat: the direct one by k, and the adjoint one through u."""
        rows = geometry(self.mesh, self.mesh.nodes.join(self.u, "node_id"), ["u"]).join(self.cells.select("cell_id", "k"), "cell_id").join(cotangent, "cell_id")
        n, axes, _ = el.shape(rows)
        g = el.gradient(rows, "u")
        direct = rows.select("cell_id", (F.col("w") * sum((g[a] * g[a] for a in axes), F.lit(0.0))).alias("direct"))
        seeds = rows.select(F.inline(F.array(*[F.struct(F.col(f"n{i}").alias("node_id"), (2 * F.col("w") * F.col("k") * sum((g[a] * F.col(f"g{i}{a}") for a in axes), F.lit(0.0))).alias("w")) for i in range(n)])))
        seeds = self.tables.write("seeds", seeds.groupBy("node_id").agg(F.sum("w").alias("w")))
        cells, held = self.pullback(seeds, "lam_joule")
        cells = cells.join(direct, "cell_id", "left").select("cell_id", (F.col("d_k") + F.coalesce("direct", F.lit(0.0))).alias("d_k"))
        return cells, held


class Electrothermal:
    """Current, its heat as the thermal source on the same cells, temperature: one adjoint for each field, chained."""

    def __init__(self, mesh: Mesh, sigma: DataFrame, potential: DataFrame, thermal: DataFrame, temperature: DataFrame):
        self.current = CurrentState(mesh, sigma.select("cell_id", F.col("sigma").alias("k"), F.lit(0.0).alias("q")), potential)
        self.heat = self.current.joule()
        self.thermal = ScalarState(mesh, thermal, temperature, self.heat.select("cell_id", F.col("heat").alias("source")))

    def pullback(self, cotangent: DataFrame) -> dict[str, DataFrame]:
        """Derivatives of a functional of the temperature: sigma, potential (held), k, q and temperature (held)."""
        cells, held = self.thermal.pullback(cotangent)
        sigma, volts = self.current.pullback_joule(cells.select("cell_id", F.col("d_q").alias("w")))
        return {"sigma": sigma.select("cell_id", F.col("d_k").alias("d_sigma")), "potential": volts, "thermal": cells, "temperature": held}


# --- the coupled problem ----------------------------------------------------------------------------------------------


def scattered(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values (..., i) by at[i] in 0 .. n - 1."""
    rows = values.reshape(-1, len(at))
    where = np.arange(len(rows))[:, None] * n + at
    return np.bincount(where.ravel(), rows.ravel(), len(rows) * n).reshape(*values.shape[:-1], n)


class Coupled:
    """phi and T of sigma(T) = s / (1 + a (T - t0)) on arrays: the state by block iteration, gradients by one transposed
    solve with the Jacobian of both residuals. Parameters are numbers, or arrays of many cases, whose states then have their
    axes before that of the nodes. For meshes that fit a worker."""

    NAMES = ("sigma", "alpha", "k", "volts", "t0")

    def __init__(self, tri: np.ndarray, grads: np.ndarray, area: np.ndarray, left: np.ndarray, right: np.ndarray, n: int):
        self.tri, self.grads, self.area, self.n = tri, grads, area, n
        self.left, self.right = left, right
        self.held = np.union1d(left, right)
        self.free = np.setdiff1d(np.arange(n), self.held)
        self.local = np.einsum("cia,cja,c->cij", grads, grads, area)
        self.unit = self.blocks(self.local)

    @classmethod
    def of(cls, mesh: Mesh, ends: DataFrame) -> Coupled:
        g = geometry(mesh).orderBy("cell_id").toPandas()
        at = ends.toPandas()
        tri = g[["n0", "n1", "n2"]].to_numpy()
        grads = g[[f"g{k}{a}" for k in range(3) for a in "xy"]].to_numpy().reshape(-1, 3, 2)
        left, right = (np.sort(at.loc[at["name"] == s, "node_id"].to_numpy()) for s in ("left", "right"))
        return cls(tri, grads, g["area"].to_numpy(), left, right, int(tri.max()) + 1)

    def blocks(self, values: np.ndarray) -> np.ndarray:
        """Matrices over all nodes of (..., cell, 3, 3)."""
        at = (np.repeat(self.tri, 3, 1) * self.n + np.tile(self.tri, (1, 3))).ravel()
        return scattered(at, values.reshape(*values.shape[:-3], -1), self.n**2).reshape(*values.shape[:-3], self.n, self.n)

    def inner(self, matrix: np.ndarray) -> np.ndarray:
        return matrix[..., self.free, :][..., self.free]

    def matrix(self, coefficient: np.ndarray) -> np.ndarray:
        return self.blocks(self.local * coefficient[..., None, None])

    def law(self, p: dict, t: np.ndarray) -> np.ndarray:
        sigma, alpha, t0 = (np.asarray(p[n], float)[..., None, None] for n in ("sigma", "alpha", "t0"))
        return sigma / (1 + alpha * (t[..., self.tri] - t0))

    def residual(self, p: dict, phi: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Both residuals on free nodes, held nodes as they are."""
        s = self.law(p, t)
        field = -np.einsum("cia,...ci->...ca", self.grads, phi[..., self.tri])
        q = s * (field**2).sum(-1)[..., None]
        nodal = self.area[:, None] / 12 * (q + q.sum(-1, keepdims=True))
        load = scattered(self.tri.ravel(), nodal.reshape(*nodal.shape[:-2], -1), self.n)
        current = (self.matrix(s.mean(-1)) @ phi[..., None])[..., 0]
        heat = np.asarray(p["k"], float)[..., None] * (t @ self.unit) - load
        return np.concatenate([current[..., self.free], heat[..., self.free]], -1)

    def fields(self, p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape, m = (*x.shape[:-1], self.n), len(self.free)
        phi, t = np.zeros(shape), np.broadcast_to(np.asarray(p["t0"], float)[..., None], shape).copy()
        phi[..., self.right] = np.asarray(p["volts"], float)[..., None]
        phi[..., self.free], t[..., self.free] = x[..., :m], x[..., m:]
        return phi, t

    def solve(self, p: dict, tolerance: float = 1e-13, most: int = 200) -> np.ndarray:
        """The state of every case at once; those that have settled leave."""
        shape, m = np.broadcast_shapes(*(np.shape(p[n]) for n in self.NAMES)), len(self.free)
        p = {n: np.broadcast_to(np.asarray(p[n], float), shape).ravel() for n in self.NAMES}
        x = np.concatenate([np.zeros((len(p["t0"]), m)), np.repeat(p["t0"][:, None], m, 1)], 1)
        going = np.arange(len(x))
        for _ in range(most):
            now = {n: v[going] for n, v in p.items()}
            phi, t = self.fields(now, x[going])
            k = self.matrix(self.law(now, t).mean(-1))
            given = k[:, self.free][:, :, self.held] @ phi[:, self.held, None]
            phi[:, self.free] = np.linalg.solve(self.inner(k), -given)[..., 0]
            r = self.residual(now, phi, t)[:, m:]
            step = np.linalg.solve(self.inner(self.unit), r.T).T / now["k"][:, None]
            new = np.concatenate([phi[:, self.free], t[:, self.free] - step], 1)
            settled = np.linalg.norm(new - x[going], axis=1) <= tolerance * np.linalg.norm(new, axis=1)
            x[going] = new
            going = going[~settled]
            if not len(going):
                return x.reshape(*shape, 2 * m)
        raise ValueError("the coupled iteration doesn't settle")

    def jacobian(self, p: dict, x: np.ndarray) -> np.ndarray:
        """d residual / d x, by blocks in closed form."""
        phi, t = self.fields(p, x)
        s = self.law(p, t)
        alpha, t0 = (np.asarray(p[n], float)[..., None, None] for n in ("alpha", "t0"))
        ds = -s * alpha / (1 + alpha * (t[..., self.tri] - t0))
        grad = np.einsum("cia,...ci->...ca", self.grads, phi[..., self.tri])
        e2 = (grad**2).sum(-1)
        block = lambda values: self.inner(self.blocks(values))
        pp = block(self.local * s.mean(-1)[..., None, None])
        pt = block(np.einsum("cij,...cj->...ci", self.local, phi[..., self.tri])[..., None] * (ds / 3)[..., None, :])
        mass = (np.ones((3, 3)) + np.eye(3)) / 12
        de = 2 * np.einsum("...ca,cja->...cj", grad, self.grads)
        tp = block(-self.area[:, None, None] * np.einsum("il,...cl->...ci", mass, s)[..., None] * de[..., None, :])
        tt = block(self.local * np.asarray(p["k"], float)[..., None, None, None] - self.area[:, None, None] * mass * (ds * e2[..., None])[..., None, :])
        return np.block([[pp, pt], [tp, tt]])

    def gradient(self, p: dict, weight_phi: np.ndarray, weight_t: np.ndarray) -> dict[str, np.ndarray]:
        """d J / d p for J = weight_phi . phi + weight_t . T over all nodes."""
        x = self.solve(p)
        seed = np.concatenate([weight_phi[self.free], weight_t[self.free]])
        lam = np.linalg.solve(np.swapaxes(self.jacobian(p, x), -1, -2), np.broadcast_to(seed[:, None], (*x.shape, 1)))[..., 0]
        out = {}
        for name in self.NAMES:
            step = 1e-6 * np.maximum(1.0, np.abs(p[name]))
            ends = []
            for sign in (1, -1):  # the residual is cheap: its partial derivative by central differences at a fixed state
                q = {**p, name: p[name] + sign * step}
                phi, t = self.fields(q, x)
                ends.append((self.residual(q, phi, t), phi @ weight_phi + t @ weight_t))
            out[name] = (ends[0][1] - ends[1][1]) / (2 * step) - (lam * (ends[0][0] - ends[1][0])).sum(-1) / (2 * step)
        return out

    def functional(self, p: dict, weight_phi: np.ndarray, weight_t: np.ndarray) -> np.ndarray:
        phi, t = self.fields(p, self.solve(p))
        return phi @ weight_phi + t @ weight_t


#: Entries of all matrices of a batch of cases at most.
ENTRIES = 1 << 19


def coupled_gradients(cases: DataFrame, mesh: Mesh, ends: DataFrame) -> DataFrame:
    """(case_id, parameter, gradient, difference) of the mean temperature for cases(case_id, sigma, alpha, k, volts, t0):
    the implicit adjoint beside central differences of whole solves."""
    problem = Coupled.of(mesh, ends)

    size = max(1, ENTRIES // problem.n**2)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                p = {n: part[n].to_numpy(float) for n in Coupled.NAMES}
                wt, wp = np.full(problem.n, 1 / problem.n), np.zeros(problem.n)
                for name, value in problem.gradient(p, wp, wt).items():
                    step = 1e-3 * np.maximum(1e-3, np.abs(p[name]))
                    ends = [problem.functional({**p, name: p[name] + s * step}, wp, wt) for s in (1, -1)]
                    yield pd.DataFrame({"case_id": part["case_id"], "parameter": name, "gradient": value, "difference": (ends[0] - ends[1]) / (2 * step)})

    return solve.dealt(cases.select("case_id", *Coupled.NAMES)).mapInPandas(run, "case_id long, parameter string, gradient double, difference double")
