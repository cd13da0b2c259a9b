"""Heat on one small mesh for any number of cases, each with its own conductivities, source and held values.

A case is a row with an array of its cells' conductivities; batches of rows become stacked matrices, which are factored at
once. Nothing is shuffled but the cases, and nothing is written: what a task holds is a batch, and what comes out is a row
for each free node. The mesh is collected, as it is the same for all cases and small.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import solve
from .mesh import Mesh, geometry

#: Cases of a task, and entries of all matrices of a batch, at most.
CASES, ENTRIES = 1 << 16, 1 << 19


def heat(mesh: Mesh, cases: DataFrame, conductivity: Callable[[Column], Column], source: Column, held: Callable[[float, float], Column | None], backward: float = 1e-10) -> DataFrame:
    """(case_id, node_id, u, f, ku) at free nodes for -div k grad u = q: ``conductivity`` of a cell's number, ``source``, and
    ``held`` values at (x, y), None where a node is free, are expressions of the columns of ``cases``(case_id, ...). f is the
    load less what held values draw, ku the product with the solution, both recomputed; NaN where the residual isn't small."""
    nodes = sorted(mesh.nodes.select("node_id", "x", "y").collect())
    cells = geometry(mesh).orderBy("cell_id").collect()
    at = {r.node_id: i for i, r in enumerate(nodes)}
    tri = np.array([[at[r[f"n{k}"]] for k in range(3)] for r in cells])
    grads = np.array([[[r[f"g{k}{a}"] for a in "xy"] for k in range(3)] for r in cells])
    area = np.array([r.area for r in cells])
    values = {i: v for i, r in enumerate(nodes) if (v := held(r.x, r.y)) is not None}
    fixed = np.array(sorted(values), np.int64)
    free = np.setdiff1d(np.arange(len(nodes)), fixed)
    ids = np.array([r.node_id for r in nodes], np.int64)[free]
    n = len(nodes)
    local = area[:, None, None] * np.einsum("cia,cja->cij", grads, grads)
    # unit[cell, entry]: what a cell of conductivity 1 adds to the entries of free rows
    unit = np.zeros((len(cells), n, n))
    for c, (corners, part) in enumerate(zip(tri, local)):
        unit[c][np.ix_(corners, corners)] += part
    unit = np.ascontiguousarray(unit[:, free]).reshape(len(cells), -1)
    load = np.bincount(tri.ravel(), np.repeat(area / 3, 3), n)[free]
    size = max(1, ENTRIES // max(n * n, 1))

    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    cell_ids = F.array(*[F.lit(int(r.cell_id)) for r in cells])
    rows = cases.select(F.col("case_id").cast("long").alias("case_id"), F.transform(cell_ids, lambda c: number(conductivity(c))).alias("k"), number(source).alias("q"), F.array(*[number(values[i]) for i in fixed.tolist()]).alias("held"))

    def solved(case, k, q, value):
        rows = (k @ unit).reshape(len(case), len(free), n)
        a, f = rows[:, :, free], q[:, None] * load - (rows[:, :, fixed] @ value[:, :, None])[..., 0]
        ok = np.isfinite(a).all((1, 2)) & np.isfinite(f).all(1)
        a, f = np.where(ok[:, None, None], a, np.eye(len(free))), np.where(ok[:, None], f, 0.0)
        # a positive definite matrix has only positive eigenvalues, of which the least bounds all pivots
        ok &= np.linalg.eigvalsh(a)[:, 0] > 0
        u = np.linalg.solve(np.where(ok[:, None, None], a, np.eye(len(free))), f[..., None])[..., 0]
        ku = (a @ u[..., None])[..., 0]
        of = np.linalg.norm((np.abs(a) @ np.abs(u)[..., None])[..., 0] + np.abs(f), axis=1)
        ok &= np.linalg.norm(f - ku, axis=1) <= backward * of
        out = [np.where(ok[:, None], v, np.nan).ravel() for v in (u, f, ku)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(case, len(free)), np.tile(ids, len(case)), *out)], ["case_id", "node_id", "u", "f", "ku"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                case, k, q, value = batch.slice(i, size).columns
                lists = [np.asarray(c.flatten()).reshape(len(case), -1) for c in (k, value)]
                with np.errstate(all="ignore"):
                    yield solved(np.asarray(case), lists[0], np.asarray(q), lists[1])

    return solve.dealt(rows, CASES).mapInArrow(run, "case_id long, node_id long, u double, f double, ku double")
