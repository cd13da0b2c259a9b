"""Solvers of many small systems, one Arrow group per case; ``krylov`` has those of any size, over tables.

Every solution carries its recomputed residual and a converged flag; what isn't admitted is NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import ContractError


@dataclass(frozen=True)
class CgPolicy:
    relative: float = 1e-13
    absolute: float = 0.0
    most: int = 10_000
    backward: float = 1e-10


def pcg(row, col, v, b, policy: CgPolicy = CgPolicy()):
    """Jacobi-preconditioned conjugate gradients on COO arrays; returns x, iterations, residual, admitted."""
    n = len(b)
    product = lambda x: np.bincount(row, v * x[col], n)
    diag = np.bincount(row[row == col], v[row == col], n)
    if n == 0 or (diag <= 0).any():
        return np.full(n, np.nan), 0, np.nan, n == 0
    x, r = np.zeros(n), b.copy()
    z = r / diag
    p, rz = z.copy(), r @ z
    target = max(policy.relative**2 * (b @ b), policy.absolute**2)
    k = 0
    while r @ r > target and k < policy.most:
        q = product(p)
        curve = p @ q
        if not curve > 0:
            break
        step = rz / curve
        x, r = x + step * p, r - step * q
        z = r / diag
        rz, old = r @ z, rz
        p = z + rz / old * p
        k += 1
    real = b - product(x)
    scale = np.linalg.norm(np.bincount(row, np.abs(v) * np.abs(x)[col], n) + np.abs(b))
    error = float(np.linalg.norm(real) / scale) if scale > 0 else 0.0
    ok = bool(np.isfinite(error) and error <= policy.backward)
    return (x if ok else np.full(n, np.nan)), k, error, ok


#: Cases of a task.
CASES = 1024


def dealt(cases: DataFrame, each: int = CASES) -> DataFrame:
    """Cases in so many tasks as they are work for, however few files or bytes they are."""
    return cases.repartition(max(1, -(-cases.count() // each)), "case_id")


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may come of one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def solve_cases(k: DataFrame, f: DataFrame, policy: CgPolicy = CgPolicy()) -> DataFrame:
    """(case_id, node_id, u, iterations, backward_error, converged) for K(case_id, row, col, v), f(case_id, row, v)."""

    def solve(key, matrix: pd.DataFrame, load: pd.DataFrame) -> pd.DataFrame:
        ids = np.union1d(matrix["row"].to_numpy(), load["row"].to_numpy())
        at = lambda c: np.searchsorted(ids, c.to_numpy())
        b = np.bincount(at(load["row"]), load["v"].to_numpy(), len(ids)) if len(load) else np.zeros(len(ids))
        x, n, error, ok = pcg(at(matrix["row"]), at(matrix["col"]), matrix["v"].to_numpy(), b, policy)
        return pd.DataFrame({"case_id": key[0], "node_id": ids, "u": x, "iterations": n, "backward_error": error, "converged": ok})

    out = fresh(k).groupBy("case_id").cogroup(fresh(f).groupBy("case_id")).applyInPandas(solve, "case_id long, node_id long, u double, iterations int, backward_error double, converged boolean")
    return out.withColumn("u", F.coalesce("u", F.lit(float("nan"))))  # NaN leaves pandas as null


def assert_converged(report: dict) -> dict:
    """The report, or an error where the solution was not admitted."""
    if not report["converged"]:
        raise ContractError(f"no convergence after {report['iterations']} iterations, backward error {report['backward_error']:.3g}")
    return report


def dense_modes(a: np.ndarray, b: np.ndarray, scalars: int, scale: float, count: int):
    """Modes of the mixed pencil: Schur complement of the scalar block, eigenvalues of B^-1 S, beta = sqrt(-lambda).

    Returns (beta, edge vectors with e^T B e = 1, residuals), by falling Re beta, then rising Im beta.
    """
    s = a[scalars:, scalars:] - a[scalars:, :scalars] @ np.linalg.solve(a[:scalars, :scalars], a[:scalars, scalars:]) if scalars else a
    m = b[scalars:, scalars:]
    lam, vec = np.linalg.eig(np.linalg.solve(m, s) / scale**2)
    beta = np.sqrt(-lam.astype(complex))
    beta = np.where((beta.real < 0) | ((beta.real == 0) & (beta.imag < 0)), -beta, beta) * scale
    order = np.lexsort((beta.imag, -beta.real))[:count]
    vec, beta, lam = vec[:, order].astype(complex), beta[order], lam[order]
    norm = np.sqrt(np.einsum("ik,ij,jk->k", vec, m, vec))
    vec = vec / norm
    anchor = np.abs(vec).argmax(0)
    turn = vec[anchor, np.arange(vec.shape[1])]
    vec = vec * np.where(turn.real < 0, -1, 1)
    res = np.linalg.norm(s @ vec - m @ vec * (lam * scale**2), axis=0) / (np.linalg.norm(s @ vec, axis=0) + 1e-300)
    return beta, vec, res
