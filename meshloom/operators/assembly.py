"""Sparse systems as tables K(row, col, v) and f(row, v): assembly, constraints, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el


def summed(rows: DataFrame, entries: Column, keys: list[str]) -> DataFrame:
    """Sums local entries by key, after a partial sum in each task."""
    return rows.select(F.inline(entries)).groupBy(*keys).agg(F.sum("v").alias("v"))


def stiffness(geometry: DataFrame, k: Column) -> DataFrame:
    return summed(geometry, el.stiffness(geometry, k), ["row", "col"])


def mass(geometry: DataFrame, rho: Column) -> DataFrame:
    return summed(geometry, el.mass(geometry, rho), ["row", "col"])


def load(geometry: DataFrame, q: Column) -> DataFrame:
    return summed(geometry, el.loads(geometry, q), ["row"])


def facet_measure(facets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facets with n0, n1[, n2] and their length or area."""
    axes = [a for a in ("x", "y", "z") if a in nodes.columns]
    rows = facets.select("facet_id", F.posexplode("nodes").alias("k", "node_id")).join(nodes, "node_id")
    pick = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name)))
    n = len(axes)
    g = rows.groupBy("facet_id").agg(*[pick("node_id", k).alias(f"n{k}") for k in range(n)], *[pick(a, k).alias(f"{a}{k}") for k in range(n) for a in axes])
    d = lambda k, a: F.col(f"{a}{k}") - F.col(f"{a}0")
    if n == 2:
        size = F.hypot(d(1, "x"), d(1, "y"))
    else:
        c = (d(1, "y") * d(2, "z") - d(1, "z") * d(2, "y"), d(1, "z") * d(2, "x") - d(1, "x") * d(2, "z"), d(1, "x") * d(2, "y") - d(1, "y") * d(2, "x"))
        size = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) / 2
    return g.withColumn("size", size)


def flux_load(measured: DataFrame, g: Column) -> DataFrame:
    """A positive right-hand side g |facet| shared by the facet's corners (so q.n = -g)."""
    n = 3 if "n2" in measured.columns else 2
    return summed(measured, F.array(*[F.struct(F.col(f"n{k}").alias("row"), (g * F.col("size") / n).alias("v")) for k in range(n)]), ["row"])


def robin(measured: DataFrame, h: Column, ambient: Column) -> tuple[DataFrame, DataFrame]:
    """Matrix h |facet| (1 + delta) / (n (n + 1)) and load h u |facet| / n for -k du/dn = h (u - ambient)."""
    n = 3 if "n2" in measured.columns else 2
    entries = F.array(*[F.struct(F.col(f"n{i}").alias("row"), F.col(f"n{j}").alias("col"), (h * F.col("size") * (1 + (i == j)) / float(n * (n + 1))).alias("v")) for i in range(n) for j in range(n)])
    return summed(measured, entries, ["row", "col"]), flux_load(measured, h * ambient)


def add(*parts: DataFrame) -> DataFrame:
    """Sum of matrices or of vectors."""
    keys = [c for c in parts[0].columns if c != "v"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("v").alias("v"))


def matvec(k: DataFrame, x: DataFrame) -> DataFrame:
    """(row, v) of K x; x(node_id, u)."""
    return k.join(x, k.col == x.node_id).groupBy("row").agg(F.sum(F.col("v") * F.col("u")).alias("v"))


def dirichlet(k: DataFrame, f: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symmetric elimination: f - K[:, c] u_c on free rows; identity rows and f_c = u_c; fixed(node_id, value)."""
    held = fixed.select("node_id", "value")
    moved = k.join(held, k.col == held.node_id).groupBy("row").agg((-F.sum(F.col("v") * F.col("value"))).alias("v"))
    rows = f.unionByName(moved).groupBy("row").agg(F.sum("v").alias("v"))
    free_rows = rows.join(held, rows.row == held.node_id, "left_anti")
    free = k.join(held, k.row == held.node_id, "left_anti").join(held, k.col == held.node_id, "left_anti")
    one = held.select(F.col("node_id").alias("row"), F.col("node_id").alias("col"), F.lit(1.0).alias("v"))
    return free.unionByName(one), free_rows.unionByName(held.select(F.col("node_id").alias("row"), F.col("value").alias("v")))


def free_block(k: DataFrame, fixed: DataFrame) -> DataFrame:
    """Principal submatrix of the rows and columns that aren't fixed."""
    return k.join(fixed, k.row == fixed.node_id, "left_anti").join(fixed, k.col == fixed.node_id, "left_anti")


def galerkin(k: DataFrame, p: DataFrame) -> DataFrame:
    """P^T K P; p(fine, coarse, w)."""
    left = p.select(F.col("fine").alias("row"), F.col("coarse").alias("r"), F.col("w").alias("wr"))
    right = p.select(F.col("fine").alias("col"), F.col("coarse").alias("c"), F.col("w").alias("wc"))
    half = k.join(right, "col").groupBy("row", "c").agg(F.sum(F.col("v") * F.col("wc")).alias("v"))
    return half.join(left, "row").groupBy("r", "c").agg(F.sum(F.col("v") * F.col("wr")).alias("v")).select(F.col("r").alias("row"), F.col("c").alias("col"), "v")


def diagnostics(k: DataFrame) -> DataFrame:
    """One row: entries, greatest |K - K^T|, least diagonal over the greatest, greatest |row sum|."""
    t = k.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("v").alias("t"))
    sym = k.join(t, ["row", "col"], "full").agg(F.count("v").alias("entries"), F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("t", F.lit(0.0)))).alias("asymmetry"))
    diag = k.where("row = col").agg((F.min("v") / F.max("v")).alias("least_diagonal"))
    sums = k.groupBy("row").agg(F.abs(F.sum("v")).alias("s")).agg(F.max("s").alias("row_sum"))
    return sym.crossJoin(diag).crossJoin(sums)


def summed_rows(rows: DataFrame) -> DataFrame:
    """Adds up equal entries."""
    return rows.groupBy("row", "col").agg(F.sum("v").alias("v"))
