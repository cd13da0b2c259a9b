"""Port modes without a global matrix: shifts, preconditioned GMRES, B-Arnoldi, contours, derivatives, fields.

The mixed space has a longitudinal potential at the nodes and a transverse field on the edges; a cell's pencil (A, B) is a
pair of 6 by 6 matrices, three nodes first. Tables make the pencils (``local_pencil``) and reduced dofs; a case's cells fit a
worker, so kernels on arrays run one case a group, and cases (frequencies, shifts, contour points) run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el

from . import partition
from .mesh import ContractError, Mesh, edge_map
from .physics import EPS_0, LIGHT, MU_0, port_free, port_rows
from .solve import dense_modes

LOCAL = 6


# --- tables -----------------------------------------------------------------------------------------------------------


def lossless_coefficients(eps_r: Column, mu_r: Column) -> tuple[Column, Column]:
    """Permittivity and reluctivity of relative ones; neither may be 0 or less."""
    ok = (eps_r > 0) & (mu_r > 0)
    fail = F.raise_error(F.lit("relative permittivity and permeability must be positive")).cast("double")
    return F.when(ok, EPS_0 * eps_r).otherwise(fail), F.when(ok, 1 / (MU_0 * mu_r)).otherwise(fail)


def local_pencil(g: DataFrame, eps: Column, nu: Column, w2: Column) -> DataFrame:
    """(cell_id, i, j, a, b) of rows with geometry and edge signs s0 .. s2; w2 is the squared angular frequency."""
    hat = lambda p, q: F.col("area") * (1 + (p == q)) / 12.0
    edges = el.TRIANGLE_EDGES

    def edge_mass(i, j):
        (p, q), (r, s) = edges[i], edges[j]
        return F.col(f"s{i}") * F.col(f"s{j}") * (hat(p, r) * el.grad_dot(q, s, "xy") - hat(p, s) * el.grad_dot(q, r, "xy") - hat(q, r) * el.grad_dot(p, s, "xy") + hat(q, s) * el.grad_dot(p, r, "xy"))

    def coupling(i, j):
        s, e = edges[j]
        return F.col("area") / 3.0 * (el.grad_dot(i, e, "xy") - el.grad_dot(i, s, "xy")) * F.col(f"s{j}")

    out = []
    for i in range(LOCAL):
        for j in range(LOCAL):
            b = F.lit(0.0)
            if i < 3 and j < 3:
                a = -eps * hat(i, j)
            elif i < 3:
                a = eps * coupling(i, j - 3)
            elif j < 3:
                a = nu * coupling(j, i - 3)
            else:
                n = edge_mass(i - 3, j - 3)
                a = nu * F.col(f"s{i - 3}") * F.col(f"s{j - 3}") / F.col("area") - w2 * eps * n
                b = nu * n
            out.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), a.alias("a"), b.alias("b")))
    return g.select("cell_id", F.inline(F.array(*out)))


def reduced_cells(mesh: Mesh) -> DataFrame:
    """(cell_id, local, dof): six dofs a cell, null on conducting walls; nodes first."""
    _, cell_edges = edge_map(mesh)
    return partition.reduced(partition.mixed_dofs(mesh, cell_edges, mesh.nodes.count()), port_free(mesh))


def row_sums(pencil: DataFrame, cells: DataFrame, shift: Column) -> DataFrame:
    """(dof, row_sum, col_sum): sums of magnitudes of the shifted cell entries between free dofs, cell by cell."""
    free = cells.where("dof IS NOT NULL")
    at = lambda c, name: free.select("cell_id", F.col("local").alias(c), F.col("dof").alias(name))
    rows = pencil.join(at("i", "p"), ["cell_id", "i"]).join(at("j", "q"), ["cell_id", "j"]).withColumn("m", F.abs(F.col("a") - shift * F.col("b")))
    both = rows.select(F.inline(F.array(F.struct(F.col("p").alias("dof"), F.col("m").alias("row_sum"), F.lit(0.0).alias("col_sum")), F.struct(F.col("q").alias("dof"), F.lit(0.0).alias("row_sum"), F.col("m").alias("col_sum")))))
    return both.groupBy("dof").agg(F.sum("row_sum").alias("row_sum"), F.sum("col_sum").alias("col_sum"))


def reordered_edges(coefficients: DataFrame, foreign: DataFrame, own: DataFrame) -> DataFrame:
    """(edge_id, value) of coefficients(foreign_id, value) by their end nodes: foreign(foreign_id, a, b), own(edge_id, lo,
    hi). A reversed edge changes its sign; an edge without a partner is an error."""
    keyed = foreign.select("foreign_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.when(F.col("a") < F.col("b"), 1.0).otherwise(-1.0).alias("sign"))
    out = own.join(keyed, ["lo", "hi"], "left").join(coefficients, "foreign_id", "left")
    value = F.when(F.col("value").isNotNull(), F.col("sign") * F.col("value")).otherwise(F.raise_error(F.lit("an edge has no coefficient")).cast("double"))
    return out.select("edge_id", value.alias("value"))


def expanded(reduced: DataFrame, nodes: int, edges: int) -> DataFrame:
    """(dof, value) of all nodes and edges: reduced(dof, value), 0 elsewhere."""
    whole = reduced.sparkSession.range(nodes + edges).withColumnRenamed("id", "dof")
    return whole.join(reduced, "dof", "left").select("dof", F.coalesce("value", F.lit(0.0)).alias("value"))


def storage(cells: Column, free: Column, value: int = 8, index: int = 4) -> dict[str, Column]:
    """Bytes of cell matrices and indices, and of two dense matrices of the free dofs."""
    values, indices, dense = cells * (2 * LOCAL * LOCAL * value), cells * (LOCAL * index), 2 * free * free * value
    return {"value_bytes": values, "index_bytes": indices, "total_bytes": values + indices, "dense_bytes": dense, "ratio": dense / (values + indices)}


def kernel_rows(mesh: Mesh, cases: DataFrame) -> DataFrame:
    """One row a cell and case(case_id, frequency, eps_r, mu_r): geometry, dofs (-1 where held), edge ids, both matrices
    row by row. The mesh is of a bounded size: a case is solved in one group."""
    cells = reduced_cells(mesh).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", F.coalesce("dof", F.lit(-1).cast("long")).alias("d")))), lambda s: s["d"]).alias("dofs"))
    g = port_rows(mesh).join(cells, "cell_id")
    rows = g.crossJoin(F.broadcast(cases))
    eps, nu = lossless_coefficients(F.col("eps_r"), F.col("mu_r"))
    w = 2 * np.pi * F.col("frequency")
    rows = rows.withColumns({"_e": eps, "_n": nu, "_w": w * w})
    corner = ["n0", "n1", "n2", "e0", "e1", "e2", "s0", "s1", "s2", *[f"{a}{k}" for k in range(3) for a in "xy"]]
    entries = local_pencil(rows.select(F.struct("case_id", "cell_id").alias("cell_id"), "area", "_e", "_n", "_w", "s0", "s1", "s2", *[f"g{k}{a}" for k in range(3) for a in "xy"]), F.col("_e"), F.col("_n"), F.col("_w"))
    packed = entries.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "a", "b"))).alias("m"))
    packed = packed.select("cell_id.case_id", "cell_id.cell_id", F.transform("m", lambda s: s["a"]).alias("a"), F.transform("m", lambda s: s["b"]).alias("b"))
    return rows.select("case_id", "cell_id", "frequency", "eps_r", "mu_r", "dofs", *corner).join(packed, ["case_id", "cell_id"])


# --- kernels ----------------------------------------------------------------------------------------------------------


@dataclass
class Pencil:
    """Cell matrices and dofs (n for held ones) of one case; dofs below ``scalars`` are potentials."""

    a: np.ndarray
    b: np.ndarray
    dofs: np.ndarray
    n: int
    scalars: int
    ids: np.ndarray

    @classmethod
    def of(cls, part: pd.DataFrame, nodes: int) -> Pencil:
        raw = np.array(part["dofs"].tolist())
        ids = np.unique(raw[raw >= 0])
        dofs = np.where(raw >= 0, np.searchsorted(ids, np.maximum(raw, 0)), len(ids))
        shape = (len(part), LOCAL, LOCAL)
        return cls(np.array(part["a"].tolist()).reshape(shape), np.array(part["b"].tolist()).reshape(shape), dofs, len(ids), int((ids < nodes).sum()), ids)

    def apply(self, local: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.concatenate([x, [0]])[self.dofs]
        y = np.einsum("cij,cj->ci", local, at).ravel()
        add = lambda v: np.bincount(self.dofs.ravel(), v, self.n + 1)[: self.n]
        return add(y.real) + 1j * add(y.imag) if np.iscomplexobj(y) else add(y)

    def dense(self, local: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n + 1, self.n + 1))
        np.add.at(out, (np.repeat(self.dofs, LOCAL, 1).ravel(), np.tile(self.dofs, (1, LOCAL)).ravel()), local.ravel())
        return out[: self.n, : self.n]


class Shifted:
    """(A - shift B), scaled by its row and column sums of magnitudes, with a block triangular preconditioner."""

    def __init__(self, p: Pencil, shift: float, least_diagonal: float = 1e-14):
        self.p, self.shift, self.local = p, shift, p.a - shift * p.b
        free = p.dofs < p.n
        size = np.abs(self.local) * (free[:, :, None] & free[:, None, :])
        self.rows = np.bincount(p.dofs.ravel(), size.sum(2).ravel(), p.n + 1)[: p.n]
        self.cols = np.bincount(p.dofs.ravel(), size.sum(1).ravel(), p.n + 1)[: p.n]
        if not (np.isfinite(self.rows).all() and (self.rows > 0).all() and (self.cols > 0).all()):
            raise ContractError("a row or column of the shifted system is empty")
        self.left, self.right = 1 / self.rows, 1 / self.cols
        pad = lambda v: np.concatenate([v, [0.0]])[p.dofs]
        self.left = self.left / np.abs(pad(self.left)[:, :, None] * self.local * pad(self.right)[:, None, :]).max()
        diag = np.bincount(p.dofs.ravel(), np.einsum("cii->ci", self.local).ravel(), p.n + 1)[: p.n]
        self.diag = self.left * diag * self.right
        if np.abs(self.diag).min() < least_diagonal * np.abs(self.diag).max():
            raise ContractError("the preconditioner's diagonal isn't large enough")

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.left * self.p.apply(self.local, self.right * x)

    def precondition(self, r: np.ndarray) -> np.ndarray:
        """Potentials by their diagonal, then edges by theirs, of what the potentials leave."""
        scalar = np.arange(self.p.n) < self.p.scalars
        s = np.where(scalar, r / self.diag, 0)
        return s + np.where(scalar, 0, (r - self.apply(s)) / self.diag)

    def solve(self, b: np.ndarray, tolerance: float = 1e-11, restart: int = 80, cycles: int = 100, admit: float = 5e-10, preconditioned: bool = True):
        """x with (A - shift B) x = b, its scaled residual; NaN where that is above ``admit``."""
        rhs = self.left * b
        if not np.linalg.norm(rhs):
            return np.zeros_like(rhs), 0.0
        y = gmres(self.apply, rhs, self.precondition if preconditioned else (lambda r: r), tolerance, restart, cycles)
        error = float(np.linalg.norm(self.apply(y) - rhs) / np.linalg.norm(rhs))
        return (self.right * y if error <= admit else np.full_like(y, np.nan)), error

    def invert(self, x: np.ndarray, **policy):
        """(A - shift B)^-1 B x."""
        return self.solve(self.p.apply(self.p.b, x), **policy)


def gmres(apply, b: np.ndarray, precondition, tolerance: float, restart: int, cycles: int) -> np.ndarray:
    """Right-preconditioned, restarted; columns orthogonalised twice, the small problem by least squares."""
    x, goal = np.zeros_like(b), tolerance * np.linalg.norm(b)
    for _ in range(cycles):
        r = b - apply(x)
        size = np.linalg.norm(r)
        if size <= goal:
            break
        q, h = [r / size], np.zeros((restart + 1, restart), b.dtype)
        used = 0
        for k in range(min(restart, len(b))):
            w = apply(precondition(q[k]))
            for _ in range(2):
                c = np.array([np.vdot(v, w) for v in q])
                w = w - sum(ci * v for ci, v in zip(c, q))
                h[: k + 1, k] += c
            h[k + 1, k] = np.linalg.norm(w)
            used = k + 1
            e = np.zeros(k + 2, b.dtype)
            e[0] = size
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)
            if np.linalg.norm(h[: k + 2, : k + 1] @ y - e) <= goal or abs(h[k + 1, k]) < 1e-300:
                break
            q.append(w / h[k + 1, k])
        x = x + precondition(sum(yi * v for yi, v in zip(y, q[:used])))
    return x


def branch(lam: np.ndarray) -> np.ndarray:
    """sqrt(-lambda) with positive real part, or zero real part and non-negative imaginary part."""
    beta = np.sqrt(-lam.astype(complex))
    return np.where((beta.real < 0) | ((beta.real == 0) & (beta.imag < 0)), -beta, beta)


def arnoldi(p: Pencil, shift: float, modes: int, dimension: int = 25, seed: int = 5):
    """(beta, vectors, residuals) of the modes nearest to the shift: Arnoldi with |shift| (A - shift B)^-1 B in the inner
    product of B, which is taken twice; theta goes back to lambda = shift + |shift| / theta."""
    s = Shifted(p, shift)
    scale = abs(shift)
    mass = lambda v: p.apply(p.b, v)
    start, _ = s.invert(np.random.default_rng(seed).normal(size=p.n))
    q = [start / np.sqrt(start @ mass(start))]
    h = np.zeros((dimension + 1, dimension))
    for k in range(dimension):
        w, _ = s.invert(q[k])
        w = scale * w
        for _ in range(2):
            bw = mass(w)
            c = np.array([v @ bw for v in q])
            w = w - sum(ci * v for ci, v in zip(c, q))
            h[: k + 1, k] += c
        h[k + 1, k] = np.sqrt(max(0.0, w @ mass(w)))
        if h[k + 1, k] < 1e-13:
            dimension = k + 1
            break
        q.append(w / h[k + 1, k])
    theta, y = np.linalg.eig(h[:dimension, :dimension])
    top = np.argsort(-np.abs(theta), kind="stable")[:modes]
    lam, vec = shift + scale / theta[top], np.stack(q[:dimension], 1) @ y[:, top]
    beta = branch(lam)
    order = np.lexsort((beta.imag, -beta.real))
    lam, vec, beta = lam[order], vec[:, order], beta[order]
    res = []
    for k in range(len(lam)):
        ax, bx = p.apply(p.a, vec[:, k]), p.apply(p.b, vec[:, k])
        res.append(np.linalg.norm(s.left * (ax - lam[k] * bx)) / np.linalg.norm(s.left * bx) / scale)
    return beta, vec, np.array(res)


def schur(a: np.ndarray, b: np.ndarray, scalars: int) -> tuple[np.ndarray, np.ndarray]:
    """(S, M) of the edges: A11 - A10 A00^-1 A01 and B11."""
    s = a[scalars:, scalars:] - a[scalars:, :scalars] @ np.linalg.solve(a[:scalars, :scalars], a[:scalars, scalars:]) if scalars else a
    return s, b[scalars:, scalars:]


def subspace_cosines(one: np.ndarray, other: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Cosines of the principal angles between column spaces in the inner product of ``mass``."""
    root = np.linalg.cholesky(mass).T
    u, v = (np.linalg.qr(root @ x)[0] for x in (one, other))
    return np.clip(np.linalg.svd(u.conj().T @ v, compute_uv=False), 0, 1)


def simple_pair(s: np.ndarray, m: np.ndarray, index: int, least_gap: float = 1e-6, most_residual: float = 1e-10):
    """The eigenvalue of S x = lambda M x that is ``index``-th by propagation, right and left vectors with x^T M x = 1 and
    y^T M x = 1, the anchor of x positive; gap and residual are relative and must pass."""
    lam, vec = np.linalg.eig(np.linalg.solve(m, s))
    order = np.lexsort((branch(lam).imag, -branch(lam).real))
    lam, vec = lam[order], vec[:, order]
    scale = np.abs(lam).max()
    gap = float(np.abs(np.delete(lam, index) - lam[index]).min() / scale)
    x = vec[:, index].real
    x = x / np.sqrt(x @ m @ x)
    x = x * np.sign(x[np.abs(x).argmax()])
    left, lv = np.linalg.eig(np.linalg.solve(m.T, s.T))
    y = lv[:, np.abs(left - lam[index]).argmin()].real
    y = y / (y @ m @ x)
    value = float(lam[index].real)
    residual = float(np.linalg.norm(s @ x - value * (m @ x)) / (np.linalg.norm(s, 2) * np.linalg.norm(x)))
    ok = gap >= least_gap and residual <= most_residual and abs(lam[index].imag) <= 1e-10 * scale
    if not ok:
        raise ContractError(f"the mode isn't simple enough: gap {gap:.3g}, residual {residual:.3g}")
    return value, x, y, {"gap": gap, "residual": residual}


def pair_pullback(s: np.ndarray, m: np.ndarray, value: float, x: np.ndarray, y: np.ndarray, seed_value: float, seed_x: np.ndarray | None = None):
    """(dJ/dS, dJ/dM) for cotangents of the eigenvalue and of x (with x^T M x = 1), by one bordered transposed solve."""
    ds, dm = seed_value * np.outer(y, x), -seed_value * value * np.outer(y, x)
    if seed_x is not None:
        n = len(x)
        border = np.zeros((n + 1, n + 1))
        border[:n, :n], border[:n, n], border[n, :n] = s - value * m, -m @ x, (m + m.T) @ x
        lam = np.linalg.solve(border.T, np.concatenate([seed_x, [0.0]]))
        ds = ds - np.outer(lam[:n], x)
        dm = dm + value * np.outer(lam[:n], x) - lam[n] * np.outer(x, x)
    return ds, dm


def contour_point(s: np.ndarray, m: np.ndarray, z: complex, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Moments at one point of a contour: left^T M (z M - S)^-1 M right."""
    return left.T @ m @ np.linalg.solve(z * m - s, m @ right)


def cluster_sums(moments: np.ndarray, z: np.ndarray, center: float, radius: float) -> tuple[int, complex, complex]:
    """Size, sum of eigenvalues and sum of propagation constants inside a circle, of moments at equally spaced points. The
    circle must not hold 0; the root is taken so that it has no cut on the circle's side."""
    w = (z - center) / len(z)
    root = np.sqrt(-z) if center < 0 else 1j * np.sqrt(z)
    p0, p1, pb = (np.einsum("k,kij->ij", w * f, moments) for f in (np.ones_like(z), z, root))
    inverse = np.linalg.inv(p0)
    return len(p0), np.trace(inverse @ p1), np.trace(inverse @ pb)


def fields_at(part: pd.DataFrame, full: np.ndarray, nodes: int, beta: complex, bary: np.ndarray):
    """E and H (cells, points, 3) at barycentric points of the cells, of all coefficients in full."""
    corner = part[["n0", "n1", "n2"]].to_numpy()
    xy = part[[f"{a}{k}" for k in range(3) for a in "xy"]].to_numpy().reshape(-1, 3, 2)
    det = (xy[:, 1, 0] - xy[:, 0, 0]) * (xy[:, 2, 1] - xy[:, 0, 1]) - (xy[:, 2, 0] - xy[:, 0, 0]) * (xy[:, 1, 1] - xy[:, 0, 1])
    nxt, far = [1, 2, 0], [2, 0, 1]
    grad = np.stack([(xy[:, nxt, 1] - xy[:, far, 1]) / det[:, None], (xy[:, far, 0] - xy[:, nxt, 0]) / det[:, None]], 2)
    sign = part[["s0", "s1", "s2"]].to_numpy()
    edge = full[nodes + part[["e0", "e1", "e2"]].to_numpy()] * sign
    potential = full[corner]
    start, end = [0, 1, 2], [1, 2, 0]
    per_cell = bary.ndim == 3
    b = bary if per_cell else np.broadcast_to(bary, (len(part), *bary.shape))
    basis = b[:, :, start, None] * grad[:, None, end, :] - b[:, :, end, None] * grad[:, None, start, :]
    et = np.einsum("ce,cqed->cqd", edge, basis)
    ez = np.einsum("cqi,ci->cq", b, potential) / (1j * beta)
    gz = np.einsum("ci,cid->cd", potential, grad)[:, None, :] / (1j * beta)
    curl = (edge.sum(1) * 2 / det)[:, None]
    w = 2 * np.pi * float(part["frequency"].iloc[0])
    nu = (1 / (MU_0 * part["mu_r"].to_numpy()))[:, None] / (1j * w)
    h = np.stack([nu * (gz[..., 1] - 1j * beta * et[..., 1]), nu * (1j * beta * et[..., 0] - gz[..., 0]), nu * np.broadcast_to(curl, ez.shape)], 2)
    return np.concatenate([et, ez[..., None]], 2), h, np.abs(det)


#: Points and weights of the triangle rule that is exact for squares, weights for twice the area.
POINTS = np.array([[2 / 3, 1 / 6, 1 / 6], [1 / 6, 2 / 3, 1 / 6], [1 / 6, 1 / 6, 2 / 3]])
WEIGHT = 1 / 6


def forward_power(e: np.ndarray, h: np.ndarray, size: np.ndarray) -> float:
    """Half the real part of the integral of Ex conj(Hy) - Ey conj(Hx)."""
    flux = 0.5 * (e[..., 0] * h[..., 1].conj() - e[..., 1] * h[..., 0].conj()).real
    return float((size[:, None] * WEIGHT * flux).sum())


def projected(part: pd.DataFrame, samples: np.ndarray, size: np.ndarray, nodes: int) -> np.ndarray:
    """Nodal values (nodes, components) that match samples at the rule's points in the least-squares sense."""
    corner = part[["n0", "n1", "n2"]].to_numpy()
    local = np.einsum("c,qi,cqd->cid", size * WEIGHT, POINTS, samples)
    rhs = np.zeros((nodes, samples.shape[2]), complex)
    np.add.at(rhs, corner.ravel(), local.reshape(-1, samples.shape[2]))
    mass = np.zeros((nodes, nodes))
    values = (size / 2)[:, None, None] * (np.ones((3, 3)) + np.eye(3)) / 12
    np.add.at(mass, (np.repeat(corner, 3, 1).ravel(), np.tile(corner, (1, 3)).ravel()), values.ravel())
    return np.linalg.solve(mass, rhs)


def normalized(e: np.ndarray, h: np.ndarray, power: float, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Both fields scaled to the target power, the largest entry of E (the first of equal ones) real and positive."""
    if not power > 0 or not target > 0:
        raise ContractError("forward power must be positive")
    flat = e.ravel()
    anchor = flat[np.round(np.abs(flat) / np.abs(flat).max(), 12).argmax()]
    turn = np.conj(anchor) / abs(anchor) * np.sqrt(target / power)
    return e * turn, h * turn


def dense_pair(p: Pencil) -> tuple[np.ndarray, np.ndarray]:
    return p.dense(p.a), p.dense(p.b)


def whole(p: Pencil, edge_vector: np.ndarray, total: int) -> np.ndarray:
    """All coefficients of an edge vector: its potentials by A00, zero on walls."""
    a = p.dense(p.a)
    k = p.scalars
    scalar = -np.linalg.solve(a[:k, :k], a[:k, k:] @ edge_vector) if k else np.zeros(0)
    full = np.zeros(total, complex)
    full[p.ids] = np.concatenate([scalar, edge_vector])
    return full


def modes_of(part: pd.DataFrame, nodes: int, count: int):
    """Pencil, propagation constants and edge vectors of a case by the dense reduced problem."""
    p = Pencil.of(part, nodes)
    a, b = dense_pair(p)
    scale = 2 * np.pi * float(part["frequency"].iloc[0]) / LIGHT
    beta, vec, res = dense_modes(a, b, p.scalars, scale, count)
    return p, beta, vec, res


def yee_plane(part: pd.DataFrame, full: np.ndarray, nodes: int, beta: complex, xs: np.ndarray, ys: np.ndarray, target: float):
    """Fields at the staggered points of a grid with the edge coordinates xs, ys, scaled to the target power.

    Ex, Hy lie at (mid, edge), Ey, Hx at (edge, mid), Ez at (edge, edge), Hz at (mid, mid); the lowest cell that holds a
    point gives its value. Returns rows (component, i, j, re, im), power before scaling and the scale.
    """
    xy = part[[f"{a}{k}" for k in range(3) for a in "xy"]].to_numpy().reshape(-1, 3, 2)
    d = (xy[:, 1, 0] - xy[:, 0, 0]) * (xy[:, 2, 1] - xy[:, 0, 1]) - (xy[:, 2, 0] - xy[:, 0, 0]) * (xy[:, 1, 1] - xy[:, 0, 1])
    mid = lambda v: (v[1:] + v[:-1]) / 2
    where = {"Ex": (mid(xs), ys[:-1]), "Ey": (xs[:-1], mid(ys)), "Ez": (xs[:-1], ys[:-1]), "Hx": (xs[:-1], mid(ys)), "Hy": (mid(xs), ys[:-1]), "Hz": (mid(xs), mid(ys))}
    out = {}
    for k, (name, (u, v)) in enumerate(where.items()):
        px, py = (g.ravel() for g in np.meshgrid(u, v, indexing="ij"))
        w1 = ((px[:, None] - xy[None, :, 0, 0]) * (xy[:, 2, 1] - xy[:, 0, 1]) - (xy[:, 2, 0] - xy[:, 0, 0]) * (py[:, None] - xy[None, :, 0, 1])) / d
        w2 = ((xy[:, 1, 0] - xy[:, 0, 0]) * (py[:, None] - xy[None, :, 0, 1]) - (px[:, None] - xy[None, :, 0, 0]) * (xy[:, 1, 1] - xy[:, 0, 1])) / d
        inside = np.minimum(np.minimum(w1, w2), 1 - w1 - w2) >= -1e-9
        if not inside.any(1).all():
            raise ContractError("a grid point lies in no cell")
        cell = inside.argmax(1)
        at = np.arange(len(cell))
        bary = np.stack([1 - w1[at, cell] - w2[at, cell], w1[at, cell], w2[at, cell]], 1)[:, None, :]
        e, h, _ = fields_at(part.iloc[cell], full, nodes, beta, bary)
        out[name] = (e if name[0] == "E" else h)[:, 0, k % 3].reshape(len(u), len(v))
    area = np.diff(xs)[:, None] * np.diff(ys)[None, :]
    power = float((area * 0.5 * (out["Ex"] * out["Hy"].conj() - out["Ey"] * out["Hx"].conj()).real).sum())
    if not power > 0:
        raise ContractError("the sampled forward power isn't positive")
    scale = float(np.sqrt(target / power))
    return {k: v * scale for k, v in out.items()}, power, scale
