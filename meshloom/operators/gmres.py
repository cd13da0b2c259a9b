"""Restarted GMRES over tables, for complex systems that needn't be symmetric, such as shifted ones.

A vector is a table (node_id, re, im), a matrix A(row, col, re, im). The Krylov basis is one table, keyed by the vector's number and
node_id: a new vector is made orthogonal to all others by one aggregation for their products and one for their sum, twice,
and written as a partition of the basis. The driver sees the products only, one number a basis vector, and solves
the small least-squares problem. Preconditioned from the right, so residuals are true ones: by the inverse diagonal, or by
substructures of the real system with twice the unknowns, so that steps don't grow with the mesh.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import substructure
from .krylov import ENTRIES
from .mesh import ContractError
from .tables import Tables

#: Basis vectors before a restart.
RESTART = 40


def product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def pair(re: str = "re", im: str = "im") -> tuple[Column, Column]:
    return F.col(re), F.col(im)


def summed(rows: DataFrame, value: tuple[Column, Column], *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value[0]).alias("re"), F.sum(value[1]).alias("im"))


def norm(vector: DataFrame) -> float:
    return float(vector.agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")))).first()[0] or 0.0)


def less(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b for all rows of a."""
    out = a.join(b.withColumnsRenamed({"re": "bre", "im": "bim"}), "node_id", "left").fillna(0.0, ["bre", "bim"])
    return out.select("node_id", (F.col("re") - F.col("bre")).alias("re"), (F.col("im") - F.col("bim")).alias("im"))


def combined(basis: DataFrame, factors: np.ndarray) -> DataFrame:
    """Sum of the basis vectors times one factor each."""
    rows = basis.sparkSession.createDataFrame([(j, float(c.real), float(c.imag)) for j, c in enumerate(factors)], "j int, fre double, fim double")
    return summed(basis.join(F.broadcast(rows), "j"), product(pair(), pair("fre", "fim")), "node_id")


def exact(tables: Tables, a: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A preconditioner for A(row, node_id, re, im): the solution by substructures, real and imaginary parts at neighbouring numbers."""
    entry = lambda i, j, v: F.struct((2 * F.col("row") + i).alias("row"), (2 * F.col("node_id") + j).alias("col"), v.alias("v"))
    re, im = pair()
    k = tables.write("exact-K", a.select(F.inline(F.array(entry(0, 0, re), entry(0, 1, -im), entry(1, 0, im), entry(1, 1, re)))))
    calls = count()

    def apply(x: DataFrame) -> DataFrame:
        name = f"exact-{next(calls)}"
        part = lambda i, v: F.struct((2 * F.col("node_id") + i).alias("row"), v.alias("v"))
        f = x.select(F.lit(0).cast("long").alias("case_id"), F.inline(F.array(part(0, re), part(1, im))))
        z = substructure.solve(tables, name, k, tables.write(f"{name}-f", f), definite=False)
        if z is None:
            raise ContractError("linked nodes' numbers are too far apart")
        of = lambda i: F.max(F.when(F.col("node_id") % 2 == i, F.col("u")))
        return z.groupBy(F.floor(F.col("node_id") / 2).cast("long").alias("node_id")).agg(of(0).alias("re"), of(1).alias("im"))

    return apply


def gmres(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, restart: int = RESTART, most: int = 400, direct: bool = False) -> tuple[DataFrame, dict]:
    """(node_id, re, im) of A x = b for b(row, re, im), and a report: iterations, the recomputed residual against |b|, and
    whether that is within the tolerance; a solution that isn't is NaN. Every diagonal entry must be other than zero. ``direct``
    preconditions by substructures, for meshes that are numbered row by row."""
    spark = a.sparkSession
    tables = Tables(spark, "gmres")
    a = tables.write("A", a.select("row", F.col("col").alias("node_id"), "re", "im"))
    a = a.repartition(max(1, -(-a.count() // ENTRIES)), "node_id").persist()
    try:
        diag = a.where("row = node_id").select("node_id", *[c.alias(n) for n, c in zip(("dre", "dim"), pair())])
        size = F.col("dre") * F.col("dre") + F.col("dim") * F.col("dim")
        inverse = tables.write("inverse", diag.select("node_id", (F.col("dre") / size).alias("ire"), (-F.col("dim") / size).alias("iim")))
        b = inverse.select("node_id").join(b.select(F.col("row").alias("node_id"), "re", "im"), "node_id", "left").fillna(0.0)
        b = tables.write("b", b)

        def scaled(x: DataFrame) -> DataFrame:
            z = product(pair(), pair("ire", "iim"))
            return x.join(inverse, "node_id").select("node_id", z[0].alias("re"), z[1].alias("im"))

        if direct:
            scaled = exact(tables, a)

        def times(x: DataFrame) -> DataFrame:
            rows = a.join(x.withColumnsRenamed({"re": "xre", "im": "xim"}), "node_id")
            return summed(rows, product(pair(), pair("xre", "xim")), F.col("row").alias("node_id"))

        whole, done, cycle = norm(b), 0, 0
        x = tables.write("x-0", b.select("node_id", F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
        residual, last = b, float("inf")
        while True:
            beta = norm(residual)
            if beta <= tolerance * whole or done >= most or not beta < last:
                break
            last = beta
            factors = grown(tables, f"basis-{cycle}", residual, beta, scaled, times, min(restart, most - done), tolerance * whole)
            done += len(factors)
            step = combined(spark.read.parquet(f"{tables.root}/basis-{cycle}-z"), factors)
            minus = step.select("node_id", (-F.col("re")).alias("re"), (-F.col("im")).alias("im"))
            x = tables.write(f"x-{cycle + 1}", less(x, minus))
            residual = tables.write(f"r-{cycle + 1}", less(b, times(x)))
            tables.drop(f"basis-{cycle}", f"basis-{cycle}-z", f"x-{cycle}", f"r-{cycle}")
            cycle += 1
    finally:
        a.unpersist()
    off = beta / whole if whole else 0.0
    good = off <= tolerance
    nan = F.lit(float("nan"))
    return (x if good else x.select("node_id", nan.alias("re"), nan.alias("im"))), {"iterations": done, "residual": off, "converged": good}


def grown(tables: Tables, name: str, residual: DataFrame, beta: float, scaled, times, most: int, target: float) -> np.ndarray:
    """Grows the basis ``name`` from the residual until its least residual meets the target; the factors of its vectors, which
    are written preconditioned as ``name``-z."""
    spark = residual.sparkSession
    over = lambda v, s: v.select("node_id", (F.col("re") / s).alias("re"), (F.col("im") / s).alias("im"))
    h = np.zeros((most + 1, most), complex)
    first = np.zeros(most + 1, complex)
    first[0] = beta
    vector = tables.write(f"{name}/j=0", over(residual, beta))
    for j in range(most):
        basis = spark.read.parquet(f"{tables.root}/{name}")
        w = tables.write(f"{name}-w{j}-0", times(tables.write(f"{name}-z/j={j}", scaled(vector))))
        for again in (1, 2):  # twice is enough for orthogonality
            rows = basis.join(w.withColumnsRenamed({"re": "wre", "im": "wim"}), "node_id")
            found = summed(rows, product((F.col("re"), -F.col("im")), pair("wre", "wim")), "j").collect()
            part = np.zeros(j + 1, complex)
            for r in found:
                part[r.j] = complex(r.re, r.im)
            h[: j + 1, j] += part
            w = tables.write(f"{name}-w{j}-{again}", less(w, combined(basis, part)))
        size = norm(w)
        h[j + 1, j] = size
        y, *_ = np.linalg.lstsq(h[: j + 2, : j + 1], first[: j + 2], rcond=None)
        off = float(np.linalg.norm(h[: j + 2, : j + 1] @ y - first[: j + 2]))
        ended = off <= 0.5 * target or size <= 1e-14 * abs(h[: j + 1, j]).max(initial=1e-300) or j + 1 == most
        if not ended:
            vector = tables.write(f"{name}/j={j + 1}", over(w, size))
        tables.drop(*[f"{name}-w{j}-{k}" for k in range(3)])
        if ended:
            return y
    return np.zeros(0)
