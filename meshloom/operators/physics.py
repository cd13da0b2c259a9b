"""Steady heat, steady current, Joule coupling and port modes over the mesh and system tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el

from . import assembly as asm
from . import krylov, solve
from .mesh import Mesh, edge_map, geometry
from .tables import Tables


def side_nodes(mesh: Mesh, *names: str) -> DataFrame:
    """(name, node_id) of tagged facets, each once."""
    tagged = mesh.tags.where(F.col("name").isin(*names) & (F.col("dim") == 1)).join(mesh.facets, F.col("entity_id") == F.col("facet_id"))
    return tagged.select("name", F.explode("nodes").alias("node_id")).distinct()


def basis(mesh: Mesh) -> DataFrame:
    """(node_id, x, y, u_source, u_left, u_right): unit responses of -div grad u = s with u fixed left and right.

    Any case (k, q, left, right) is u = q / k u_source + left u_left + right u_right: geometry is solved once, whatever
    the number of cases.
    """
    tables = Tables(mesh.cells.sparkSession, "basis")
    g = geometry(mesh)
    k, f = tables.write("K", asm.stiffness(g, F.lit(1.0))), asm.load(g, F.lit(1.0))
    ends = side_nodes(mesh, "left", "right").groupBy("node_id").agg(*[F.max((F.col("name") == s).cast("double")).alias(f"u_{s}") for s in ("left", "right")])
    ends = tables.write("ends", ends)
    # one elimination for all three right-hand sides, which share the matrix
    free = k.join(ends.select(F.col("node_id").alias("row")), "row", "left_anti")
    at = free.join(ends.withColumnRenamed("node_id", "col").withColumn("held", F.lit(True)), "col", "left")
    moved = at.groupBy("row").agg(*[(-F.sum(F.col("v") * F.coalesce(c, F.lit(0.0)))).alias(c) for c in ("u_left", "u_right")])
    names = ["u_source", "u_left", "u_right"]
    loads = moved.join(f.withColumnRenamed("v", "u_source"), "row").select("row", F.posexplode(F.array(*names)).alias("case_id", "v"))
    out = krylov.conjugate_gradients(at.where("held IS NULL").select("row", "col", "v"), tables.write("loads", loads.withColumn("case_id", F.col("case_id").cast("long"))), solve.CgPolicy(relative=1e-13, most=10_000))
    inner = out.groupBy("node_id").agg(*[F.max(F.when(F.col("case_id") == k, F.col("u"))).alias(n) for k, n in enumerate(names)])
    held = ends.select("node_id", F.lit(0.0).alias("u_source"), "u_left", "u_right")
    return tables.write("responses", inner.unionByName(held).join(mesh.nodes, "node_id"))


#: Rows of responses that are broadcast at most; more are joined by blocks of nodes.
BROADCAST_ROWS = 1 << 18


def sweep(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Nodal values u of every case(case_id, k, q, left, right): small meshes are broadcast, and of larger ones blocks of
    nodes meet all cases, a block in a task at a time."""
    u = F.col("q") / F.col("k") * F.col("u_source") + F.col("left") * F.col("u_left") + F.col("right") * F.col("u_right")
    n = responses.count()
    if n <= BROADCAST_ROWS:
        return cases.crossJoin(F.broadcast(responses)).withColumn("u", u)
    blocks = -(-n // BROADCAST_ROWS)
    cases = cases.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    responses = responses.withColumn("_block", F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int"))
    return cases.join(responses, "_block").drop("_block").withColumn("u", u)


def joule(mesh: Mesh, potential: DataFrame, sigma: DataFrame) -> DataFrame:
    """Per cell: ex, ey, jx, jy, heat = J.E and area; potential(node_id, u), sigma(cell_id, sigma)."""
    g = geometry(mesh, mesh.nodes.join(potential, "node_id"), ["u"]).join(sigma, "cell_id")
    grad = el.gradient(g, "u")
    g = g.withColumns({f"e{a}": -v for a, v in grad.items()})
    g = g.withColumns({f"j{a}": F.col("sigma") * F.col(f"e{a}") for a in grad})
    size = el.shape(g)[2]
    return g.select("cell_id", *[f"e{a}" for a in grad], *[f"j{a}" for a in grad], sum((F.col(f"j{a}") * F.col(f"e{a}") for a in grad), F.lit(0.0)).alias("heat"), F.col(size).alias("size"))


def balance(k: DataFrame, f: DataFrame, u: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row: load, reaction at fixed nodes, and their relative imbalance; u(node_id, u)."""
    r = asm.matvec(k, u).join(f.withColumnRenamed("v", "f"), "row", "left").select(F.col("row").alias("node_id"), (F.col("v") - F.coalesce("f", F.lit(0.0))).alias("r"))
    reaction = r.join(fixed, "node_id", "left_semi").agg(F.sum("r").alias("reaction"))
    total = f.agg(F.sum("v").alias("load"))
    out = total.crossJoin(reaction)
    return out.withColumn("imbalance", F.abs(F.col("load") + F.col("reaction")) / (F.abs("load") + F.abs("reaction")))


#: Entries of all matrices of a batch of cases at most.
ENTRIES = 1 << 20


def self_consistent(cases: DataFrame, mesh: Mesh, relax: float = 1.0, tolerance: float = 1e-12, most: int = 100) -> DataFrame:
    """(case_id, t_max, power, iterations, change, charge, heat, converged) of Joule heating with sigma(T) = s / (1 + a (T -
    t0)); charge and heat are the relative imbalances of the ends' currents, and of the power and the heat that leaves.

    cases(case_id, sigma, alpha, volts, k, t0): potential 0 left and ``volts`` right, temperature t0 on both. The mesh
    has a fixed size, is read once and sent along; a batch of cases is a block Gauss-Seidel iteration in a worker, over
    dense matrices.
    """
    policy = solve.CgPolicy()
    g = geometry(mesh).orderBy("cell_id").toPandas()
    ends = side_nodes(mesh, "left", "right").toPandas()
    n = int(g[["n0", "n1", "n2"]].to_numpy().max()) + 1
    tri, area = g[["n0", "n1", "n2"]].to_numpy(), g["area"].to_numpy()
    grads = g[[f"g{k}{a}" for k in range(3) for a in "xy"]].to_numpy().reshape(-1, 3, 2)
    local = np.einsum("cia,cja,c->cij", grads, grads, area)
    row, col = np.repeat(tri, 3, axis=1).ravel(), np.tile(tri, (1, 3)).ravel()
    left, right = (np.sort(ends.loc[ends["name"] == s, "node_id"].to_numpy()) for s in ("left", "right"))
    held = np.union1d(left, right)
    free = np.setdiff1d(np.arange(n), held)

    at = row * n + col
    unit = np.bincount(at, local.ravel(), n * n).reshape(n, n)
    size = max(1, ENTRIES // n**2)

    def nodal_sums(values):
        """(case, node) of values (case, cell, 3)."""
        return np.bincount((np.arange(len(values))[:, None] * n + tri.ravel()).ravel(), values.ravel(), len(values) * n).reshape(-1, n)

    def solution(matrix, value, load):
        """Free values of every case, as held ones ask, and whether each solution is admitted."""
        a, b = matrix[:, free][:, :, free], load[:, free] - (matrix[:, free][:, :, held] @ value[:, held, None])[..., 0]
        ok = (np.einsum("cii->ci", a) > 0).all(1) & np.isfinite(a).all((1, 2))
        x = np.linalg.solve(np.where(ok[:, None, None], a, np.eye(len(free))), b[..., None])[..., 0]
        off = np.linalg.norm(b - (a @ x[..., None])[..., 0], axis=1)
        of = np.linalg.norm((np.abs(a) @ np.abs(x)[..., None])[..., 0] + np.abs(b), axis=1)
        ok &= off <= policy.backward * of
        out = value.copy()
        out[:, free] = np.where(ok[:, None], x, np.nan)
        return out, ok

    def conductivities(c, t):
        law = c["sigma"][:, None, None] / (1 + c["alpha"][:, None, None] * (t[:, tri] - c["t0"][:, None, None]))
        return np.where(law > 0, law, np.nan)

    def batch_of(c):
        """All cases of a batch advance together; those that have settled leave."""
        m, names = len(c["k"]), ("t", "phi", "nodal", "current")
        held_t, held_v = np.zeros((m, n)), np.zeros((m, n))
        held_t[:, held], held_v[:, right] = c["t0"][:, None], c["volts"][:, None]
        last = {name: np.full((m, n), np.nan) for name in names}
        last["t"], ok = solution(c["k"][:, None, None] * unit, held_t, np.zeros((m, n)))
        change, it = np.full(m, np.inf), np.zeros(m, np.int32)
        while (going := np.flatnonzero((change > tolerance) & (it < most) & ok)).size:
            now, t = {name: v[going] for name, v in c.items()}, last["t"][going]
            s = conductivities(now, t)
            flows = np.bincount((np.arange(len(s))[:, None] * n * n + at).ravel(), (local * s.mean(-1)[..., None, None]).ravel(), len(s) * n * n).reshape(-1, n, n)
            phi, ok1 = solution(flows, held_v[going], np.zeros((len(s), n)))
            e = -np.einsum("cia,kci->kca", grads, phi[:, tri])
            q = s * (e**2).sum(-1)[..., None]
            nodal = nodal_sums(area[:, None] / 12 * (q + q.sum(-1, keepdims=True)))
            new, ok2 = solution(now["k"][:, None, None] * unit, held_t[going], nodal)
            change[going] = np.linalg.norm(new - t, axis=1) / np.maximum(1e-300, np.linalg.norm(new, axis=1))
            ok[going], it[going] = ok1 & ok2, it[going] + 1
            for name, value in zip(names, (t + relax * (new - t), phi, nodal, (flows @ phi[..., None])[..., 0])):
                last[name][going] = value
        good = ok & (change <= tolerance)
        # without an iteration there is no potential: nan stays
        power, current = last["nodal"].sum(1), last["current"]
        moved = c["k"][:, None] * (last["t"] @ unit) - last["nodal"]
        one, other, gone = current[:, left].sum(1), current[:, right].sum(1), moved[:, held].sum(1)
        charge = np.abs(one + other) / np.maximum(1e-300, np.abs(one) + np.abs(other))
        heat = np.abs(power + gone) / np.maximum(1e-300, np.abs(power) + np.abs(gone))
        told = {"t_max": last["t"].max(1), "power": power, "iterations": it, "change": change, "charge": charge, "heat": heat}
        return {name: v if name in ("iterations", "change") else np.where(good, v, np.nan) for name, v in told.items()} | {"converged": good}

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                with np.errstate(all="ignore"):
                    told = batch_of({name: part[name].to_numpy(float) for name in ("sigma", "alpha", "volts", "k", "t0")})
                yield pd.DataFrame({"case_id": part["case_id"].to_numpy(), **told})

    out = solve.dealt(cases.select("case_id", "sigma", "alpha", "volts", "k", "t0")).mapInPandas(run, "case_id long, t_max double, power double, iterations int, change double, charge double, heat double, converged boolean")
    return out.fillna(float("nan"), ["t_max", "power", "charge", "heat"])


#: Vacuum permeability and permittivity.
MU_0 = 1.25663706212e-6
EPS_0 = 8.8541878128e-12
LIGHT = 299792458.0


def port_rows(mesh: Mesh) -> DataFrame:
    """Geometry rows with edge ids e0..e2 and signs s0..s2."""
    _, ce = edge_map(mesh)
    pick = lambda name, k: F.max(F.when(F.col("local") == k, F.col(name)))
    wide = ce.groupBy("cell_id").agg(*[pick("edge_id", k).alias(f"e{k}") for k in range(3)], *[pick("sign", k).cast("double").alias(f"s{k}") for k in range(3)])
    return geometry(mesh).join(wide, "cell_id")


def port_pencil(mesh: Mesh, frequency: float, eps_r: float = 1.0, mu_r: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A(row, col, v), B(row, col, v) of the mixed pencil: dofs are nodes, then edges after all nodes."""
    g = port_rows(mesh)
    nodes = (mesh.nodes.agg(F.count("*")).first())[0]
    eps, nu, w2 = EPS_0 * eps_r, 1 / (MU_0 * mu_r), (2 * np.pi * frequency) ** 2
    shift = lambda df, row, col: df.select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), "v")
    m = g.select(F.inline(el.mass(g, F.lit(-eps))))
    e = g.select(F.inline(el.edge_gradient(g, F.lit(eps))))
    gt = g.select(F.inline(el.edge_gradient(g, F.lit(nu)))).select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    c = g.select(F.inline(el.nedelec_curl(g, F.lit(nu)))).select("row", "col", "v")
    n = g.select(F.inline(el.nedelec_mass(g, F.lit(-w2 * eps)))).select("row", "col", "v")
    a = m.unionByName(shift(e, 0, nodes)).unionByName(shift(gt, nodes, 0)).unionByName(shift(c.unionByName(n), nodes, nodes))
    b = shift(g.select(F.inline(el.nedelec_mass(g, F.lit(nu)))).select("row", "col", "v"), nodes, nodes)
    return asm.summed_rows(a), asm.summed_rows(b)


def port_free(mesh: Mesh) -> DataFrame:
    """(dof) not on a perfectly conducting boundary: nodes first, then edges."""
    edges, ce = edge_map(mesh)
    nodes = mesh.nodes.agg(F.count("*")).first()[0]
    rim_edges = ce.groupBy("edge_id").count().where("count = 1").join(edges, "edge_id")
    rim = rim_edges.select(F.explode(F.array("lo", "hi")).alias("dof")).union(rim_edges.select((F.col("edge_id") + nodes).alias("dof")))
    return mesh.nodes.select(F.col("node_id").alias("dof")).union(edges.select((F.col("edge_id") + nodes).alias("dof"))).join(rim, "dof", "left_anti")


def port_modes(mesh: Mesh, frequency: float, count: int = 4) -> DataFrame:
    """(mode, beta_re, beta_im, residual) of a closed guide; one dense kernel on the reduced pencil."""
    a, b = port_pencil(mesh, frequency)
    nodes = mesh.nodes.agg(F.count("*")).first()[0]
    free = port_free(mesh)
    keep = lambda m: m.join(free.withColumnRenamed("dof", "row"), "row", "left_semi").join(free.withColumnRenamed("dof", "col"), "col", "left_semi")
    rows = keep(a).withColumn("kind", F.lit(0)).unionByName(keep(b).withColumn("kind", F.lit(1))).withColumn("case_id", F.lit(0).cast("long"))
    scale = 2 * np.pi * frequency / LIGHT

    def eig(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["row"])
        mats = np.zeros((2, len(ids), len(ids)))
        np.add.at(mats, (pdf["kind"].to_numpy(), np.searchsorted(ids, pdf["row"]), np.searchsorted(ids, pdf["col"])), pdf["v"].to_numpy())
        beta, _, res = solve.dense_modes(mats[0], mats[1], int((ids < nodes).sum()), scale, count)
        return pd.DataFrame({"mode": np.arange(len(beta), dtype=np.int32), "beta_re": beta.real, "beta_im": beta.imag, "residual": res})

    return rows.groupBy("case_id").applyInPandas(eig, "mode int, beta_re double, beta_im double, residual double")
