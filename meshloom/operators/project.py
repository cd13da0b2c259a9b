"""Consistent-mass projection to nodes of fields that are known inside cells, over tables.

Every cell's quadrature points are rows, at which a field is a column expression of the point, the cell and the case. The nodal
field that matches it best in the least-squares sense solves M u = f with the consistent mass matrix, which all cases and
components share: one conjugate gradient iteration advances all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import assembly as asm
from . import krylov
from .solve import CgPolicy


def triangle_rule(m: int) -> list[tuple[float, float, float, float]]:
    """(three barycentric coordinates, weight as a share of the area) of m * m points, exact to degree 2 m - 2: Gauss's points
    on a square that is collapsed to the triangle."""
    at, weight = np.polynomial.legendre.leggauss(m)
    at, weight = (at + 1) / 2, weight / 2
    return [(float((1 - s) * (1 - t)), float(s), float((1 - s) * t), float(2 * (1 - s) * a * b)) for s, a in zip(at, weight) for t, b in zip(at, weight)]


def quadrature_points(geometry: DataFrame, m: int = 3) -> DataFrame:
    """The columns of a triangle mesh's geometry with l0, l1, l2, x, y and weight of each point, a row a point."""
    points = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, ("l0", "l1", "l2", "share"))]) for p in triangle_rule(m)])
    rows = geometry.select("*", F.inline(points))
    place = {a: sum((F.col(f"l{k}") * F.col(f"{a}{k}") for k in range(3)), F.lit(0.0)) for a in "xy"}
    return rows.withColumns({**place, "weight": F.col("share") * F.col("area")}).drop("share")


def projected(geometry: DataFrame, points: DataFrame, components: dict[str, Column], policy: CgPolicy = CgPolicy(relative=1e-13, most=200)) -> DataFrame:
    """(case_id, node_id, a column for each component) of fields at points(case_id, n0.., l0.., weight, ...)."""
    names = list(components)
    # all components from one pass over the points; a system's number is case_id * components + component
    entries = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"n{k}").alias("row"), (F.col("weight") * F.col(f"l{k}") * components[c]).alias("v")) for i, c in enumerate(names) for k in range(3)])
    f = points.select("case_id", F.inline(entries)).groupBy((F.col("case_id") * len(names) + F.col("part")).alias("case_id"), "row").agg(F.sum("v").alias("v"))
    u = krylov.conjugate_gradients(asm.mass(geometry, F.lit(1.0)), f, policy, direct=True)
    case, part = F.floor(F.col("case_id") / len(names)).cast("long"), F.col("case_id") % len(names)
    return u.groupBy(case.alias("case_id"), "node_id").agg(*[F.max(F.when(part == i, F.col("u"))).alias(c) for i, c in enumerate(names)])
