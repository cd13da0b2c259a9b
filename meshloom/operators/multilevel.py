"""Additive multilevel preconditioning: z = w D^-1 r + P C P^T r, where C is the next coarser level's, and the coarsest is
solved by a Cholesky factor whose size is bounded and checked.

Vectors and matrices of the fine levels are tables; restriction, prolongation and Galerkin products are joins and sums.
Vectors may have a case_id: all cases share the hierarchy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assembly as asm
from .mesh import ContractError
from .krylov import solve_large
from .solve import CgPolicy
from .tables import Tables


@dataclass(frozen=True)
class MultilevelPolicy:
    diagonal_weight: float = 1.0
    least_diagonal: float = 1e-14
    most_asymmetry: float = 1e-10
    most_condition: float = 1e12
    #: Dofs of the coarsest level at most; its matrix is collected and its inverse sent to every task.
    coarse_dofs: int = 2048

    def __post_init__(self):
        if not (self.diagonal_weight > 0 and 0 < self.least_diagonal < 1 and self.most_asymmetry >= 0 and self.most_condition > 1 and self.coarse_dofs > 0):
            raise ContractError("a multilevel policy is out of its bounds")


def free_transfer(transfer: DataFrame, fine_free: DataFrame, coarse_free: DataFrame) -> DataFrame:
    """(fine, coarse, w) between free dofs(node_id) only."""
    return transfer.join(fine_free.withColumnRenamed("node_id", "fine"), "fine", "left_semi").join(coarse_free.withColumnRenamed("node_id", "coarse"), "coarse", "left_semi")


def of_case(vector: DataFrame) -> list[str]:
    return [c for c in vector.columns if c == "case_id"]


def restrict(transfer: DataFrame, r: DataFrame) -> DataFrame:
    """([case_id,] node_id, r) = P^T r on the coarse level."""
    return r.join(transfer, r.node_id == transfer.fine).groupBy(*of_case(r), F.col("coarse").alias("node_id")).agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def prolong(transfer: DataFrame, z: DataFrame) -> DataFrame:
    """([case_id,] node_id, z) = P z on the fine level."""
    return z.join(transfer, z.node_id == transfer.coarse).groupBy(*of_case(z), F.col("fine").alias("node_id")).agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def jacobi(matrix: DataFrame, least: float = 1e-14) -> DataFrame:
    """(node_id, d): the diagonal; one that isn't positive, or far below the greatest, is an error."""
    diag = matrix.where("row = col").select(F.col("row").alias("node_id"), F.col("v").alias("d"))
    low, high, n = diag.agg(F.min("d"), F.max("d"), F.count("*")).first()
    if not n or not low > 0 or low < least * high:
        raise ContractError("the diagonal isn't positive enough")
    return diag


def diagnostics(matrix: np.ndarray) -> dict:
    """Asymmetry relative to the greatest entry, least diagonal over the greatest, condition number."""
    top = np.abs(matrix).max()
    diag = np.diag(matrix)
    low, *_, high = np.linalg.eigvalsh((matrix + matrix.T) / 2)
    return {"asymmetry": float(np.abs(matrix - matrix.T).max() / top), "diagonal": float(diag.min() / diag.max()), "condition": float(high / low) if low > 0 else float("inf")}


def admitted(matrix: np.ndarray, policy: MultilevelPolicy) -> dict:
    found = diagnostics(matrix)
    if found["asymmetry"] > policy.most_asymmetry or found["diagonal"] < policy.least_diagonal or found["condition"] > policy.most_condition:
        raise ContractError(f"the coarse matrix isn't admitted: {found}")
    return found


@dataclass
class Hierarchy:
    """Levels from fine to coarse: matrices[k], and transfers[k] from level k + 1 to level k."""

    matrices: list[DataFrame]
    transfers: list[DataFrame]
    policy: MultilevelPolicy
    ids: np.ndarray
    inverse: np.ndarray
    found: dict


def prepare(matrix: DataFrame, transfers: list[DataFrame], policy: MultilevelPolicy = MultilevelPolicy()) -> Hierarchy:
    """Galerkin matrices of all levels; the coarsest must be small enough and positive definite."""
    if not transfers:
        raise ContractError("a hierarchy has two levels at least")
    tables = Tables(matrix.sparkSession, "levels")
    matrices, kept = [matrix], []
    for k, p in enumerate(transfers):
        kept.append(tables.write(f"p{k}", p))
        matrices.append(tables.write(f"k{k + 1}", asm.galerkin(matrices[-1], kept[-1])))
    n = matrices[-1].select("row").distinct().count()
    if not 0 < n <= policy.coarse_dofs:
        raise ContractError(f"the coarsest level has {n} dofs, the bound is {policy.coarse_dofs}")
    rows = matrices[-1].toPandas()
    ids = np.unique(rows["row"])
    dense = np.zeros((n, n))
    np.add.at(dense, (np.searchsorted(ids, rows["row"]), np.searchsorted(ids, rows["col"])), rows["v"])
    found = admitted(dense, policy)
    factor = np.linalg.inv(np.linalg.cholesky((dense + dense.T) / 2))
    return Hierarchy(matrices, kept, policy, ids, factor.T @ factor, found)


def coarse_solve(h: Hierarchy, r: DataFrame) -> DataFrame:
    """([case_id,] node_id, z) on the coarsest level: a residual of it has a bounded number of rows, one group a case."""
    ids, inverse, case = h.ids, h.inverse, of_case(r)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(len(ids))
        full[np.searchsorted(ids, part["node_id"])] = part["r"]
        out = pd.DataFrame({"node_id": ids, "z": inverse @ full})
        return out.assign(case_id=part["case_id"].iloc[0])[["case_id", "node_id", "z"]] if case else out

    return r.groupBy(*(case or [F.lit(0).alias("_one")])).applyInPandas(run, ("case_id long, " if case else "") + "node_id long, z double")


def preconditioner(h: Hierarchy):
    """A function from ([case_id,] node_id, r) to ([case_id,] node_id, z)."""
    diagonals = [jacobi(m, h.policy.least_diagonal) for m in h.matrices[:-1]]

    def apply(r: DataFrame, level: int = 0) -> DataFrame:
        if level == len(h.transfers):
            return coarse_solve(h, r)
        keys = [*of_case(r), "node_id"]
        own = r.join(diagonals[level], "node_id").select(*keys, (h.policy.diagonal_weight * F.col("r") / F.col("d")).alias("z"))
        below = prolong(h.transfers[level], apply(restrict(h.transfers[level], r), level + 1))
        return own.unionByName(below).groupBy(*keys).agg(F.sum("z").alias("z"))

    return apply


def solve(matrix: DataFrame, load: DataFrame, transfers: list[DataFrame], policy: MultilevelPolicy = MultilevelPolicy(), cg: CgPolicy = CgPolicy(relative=1e-10, most=200)) -> tuple[DataFrame, dict]:
    """Multilevel PCG over tables: (node_id, u) and its report."""
    h = prepare(matrix, transfers, policy)
    u, report = solve_large(matrix, load, cg, preconditioner(h))
    return u, report | h.found
