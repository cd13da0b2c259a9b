"""Field transfer: point location, P1 sampling, nested prolongation, staggered grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el

from .mesh import Mesh, gathered


def located(mesh: Mesh, points: DataFrame, tolerance: float = 1e-12, bins: int = 16) -> DataFrame:
    """(point_id, cell_id, w0, w1, w2, n0, n1, n2): the lowest cell that holds each point(point_id, u, v).

    A range join by binning: cells are listed in each square bin their bounding box touches, points in their own; the
    barycentric test decides. Points outside all cells are missing from the result.
    """
    g = el.triangle(gathered(mesh.cells, mesh.nodes))
    box = mesh.nodes.agg(F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x")).alias("wx"), (F.max("y") - F.min("y")).alias("wy"))
    bin_of = lambda value, low, width: F.floor((value - F.col(low)) / F.col(width) * bins).cast("int")
    pad = tolerance
    cells = g.crossJoin(F.broadcast(box))
    for a, low, width in (("x", "bx", "wx"), ("y", "by", "wy")):
        lo, hi = F.least(*[F.col(f"{a}{k}") for k in range(3)]), F.greatest(*[F.col(f"{a}{k}") for k in range(3)])
        slack = F.col(width) * pad
        cells = cells.withColumn(f"bin_{a}", F.explode(F.sequence(bin_of(lo - slack, low, width), bin_of(hi + slack, low, width))))
    spots = points.crossJoin(F.broadcast(box)).select("point_id", "u", "v", bin_of(F.col("u"), "bx", "wx").alias("bin_x"), bin_of(F.col("v"), "by", "wy").alias("bin_y"))
    hit = cells.drop("bx", "by", "wx", "wy").join(spots, ["bin_x", "bin_y"])
    w = {k: F.col(f"g{k}x") * (F.col("u") - F.col(f"x{(k + 1) % 3}")) + F.col(f"g{k}y") * (F.col("v") - F.col(f"y{(k + 1) % 3}")) for k in range(3)}
    hit = hit.withColumns({f"w{k}": v for k, v in w.items()})
    inside = " and ".join(f"w{k} between {-tolerance} and {1 + tolerance}" for k in range(3))
    best = hit.where(inside).groupBy("point_id").agg(F.min(F.struct("cell_id", "w0", "w1", "w2", "n0", "n1", "n2")).alias("m"))
    return best.select("point_id", "m.*")


def sampled(where: DataFrame, values: DataFrame) -> DataFrame:
    """(point_id, value) = sum of w T over the corners; values(node_id, u)."""
    rows = where.select("point_id", F.inline(F.array(*[F.struct(F.col(f"n{k}").alias("node_id"), F.col(f"w{k}").alias("w")) for k in range(3)])))
    return rows.join(values, "node_id").groupBy("point_id").agg(F.sum(F.col("w") * F.col("u")).alias("value"))


def prolongation(fine: Mesh, coarse: Mesh, tolerance: float = 1e-12) -> DataFrame:
    """(fine, coarse, w): each fine node by the hat functions of the coarse cell that holds it; weights near 0 or 1
    snap to these, zeros go."""
    where = located(coarse, fine.nodes.select(F.col("node_id").alias("point_id"), F.col("x").alias("u"), F.col("y").alias("v")), tolerance)
    rows = where.select(F.col("point_id").alias("fine"), F.inline(F.array(*[F.struct(F.col(f"n{k}").alias("coarse"), F.col(f"w{k}").alias("w")) for k in range(3)])))
    snap = F.when(F.abs("w") <= 32 * tolerance, 0.0).when(F.abs(F.col("w") - 1) <= 32 * tolerance, 1.0).otherwise(F.col("w"))
    return rows.withColumn("w", snap).where("w <> 0")


#: Half-cell offsets of the staggered components of E and H.
YEE = {"Ex": (0.5, 0, 0), "Ey": (0, 0.5, 0), "Ez": (0, 0, 0.5), "Hx": (0, 0.5, 0.5), "Hy": (0.5, 0, 0.5), "Hz": (0.5, 0.5, 0)}


def yee_points(axes: DataFrame) -> DataFrame:
    """(comp, i, j, k, x, y, z) of a staggered grid; axes(axis 'x'|'y'|'z', idx, coord), rising edge coordinates."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("axis").orderBy("idx")
    half = axes.withColumn("next", F.lead("coord").over(w)).withColumn("mid", (F.col("coord") + F.col("next")) / 2).where("next IS NOT NULL")
    one = {a: half.where(F.col("axis") == a).select(F.col("idx").alias(i), F.col("coord").alias(f"{a}e"), F.col("mid").alias(f"{a}m")) for a, i in zip("xyz", "ijk")}
    grid = one["x"].crossJoin(one["y"]).crossJoin(one["z"])
    comps = F.array(*[F.struct(F.lit(c).alias("comp"), *[F.col(f"{a}m" if o else f"{a}e").alias(a) for a, o in zip("xyz", offs)]) for c, offs in YEE.items()])
    return grid.select("i", "j", "k", F.inline(comps)).select("comp", "i", "j", "k", "x", "y", "z")
