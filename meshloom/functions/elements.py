"""Element kernels as Column expressions on one row per cell; all of them stay inside whole-stage codegen.

A gathered triangle row holds n0..n2 (node ids) and x0, y0, .., y2; a tetrahedron row n0..n3 and x0, y0, z0, .., z3.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local edges of a triangle, from start to end.
TRIANGLE_EDGES = ((0, 1), (1, 2), (2, 0))
#: Local edges and outward faces of a positively oriented tetrahedron.
TETRAHEDRON_EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
TETRAHEDRON_FACES = ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3))


def x(k: int, axis: str = "x") -> Column:
    return F.col(f"{axis}{k}")


def triangle(df):
    """Adds det, area and the gradients g0x .. g2y of the three hat functions."""
    det = (x(1) - x(0)) * (x(2, "y") - x(0, "y")) - (x(2) - x(0)) * (x(1, "y") - x(0, "y"))
    df = df.withColumn("det", det).withColumn("area", F.abs("det") / 2)
    cols = {}
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        cols[f"g{k}x"] = (x(a, "y") - x(b, "y")) / F.col("det")
        cols[f"g{k}y"] = (x(b) - x(a)) / F.col("det")
    return df.withColumns(cols)


def tetrahedron(df):
    """Adds det (signed), volume and the gradients g0x .. g3z."""
    e = {(k, a): x(k, a) - x(0, a) for k in (1, 2, 3) for a in "xyz"}
    cross = lambda p, q: (e[p, "y"] * e[q, "z"] - e[p, "z"] * e[q, "y"], e[p, "z"] * e[q, "x"] - e[p, "x"] * e[q, "z"], e[p, "x"] * e[q, "y"] - e[p, "y"] * e[q, "x"])
    c = {1: cross(2, 3), 2: cross(3, 1), 3: cross(1, 2)}
    df = df.withColumn("det", sum((e[1, a] * v for a, v in zip("xyz", c[1])), F.lit(0.0)))
    df = df.withColumn("volume", F.abs("det") / 6).withColumns({f"g{k}{a}": v / F.col("det") for k in c for a, v in zip("xyz", c[k])})
    return df.withColumns({f"g0{a}": -(F.col(f"g1{a}") + F.col(f"g2{a}") + F.col(f"g3{a}")) for a in "xyz"})


def grad_dot(i: int, j: int, axes: str) -> Column:
    return sum((F.col(f"g{i}{a}") * F.col(f"g{j}{a}") for a in axes[1:]), F.col(f"g{i}{axes[0]}") * F.col(f"g{j}{axes[0]}"))


def shape(df) -> tuple[int, str, str]:
    """(corners, axes, name of the measure) of rows that ``triangle`` or ``tetrahedron`` made."""
    return (4, "xyz", "volume") if "n3" in df.columns else (3, "xy", "area")


def pairs(df, value) -> Column:
    """Array of (row, col, v) with v = value(i, j) for each pair of corners."""
    n = shape(df)[0]
    return F.array(*[F.struct(F.col(f"n{i}").alias("row"), F.col(f"n{j}").alias("col"), value(i, j).alias("v")) for i in range(n) for j in range(n)])


def stiffness(df, k: Column) -> Column:
    """k |cell| grad Ni . grad Nj."""
    _, axes, size = shape(df)
    return pairs(df, lambda i, j: k * F.col(size) * grad_dot(i, j, axes))


def tensor_stiffness(df, c: dict[tuple[str, str], Column]) -> Column:
    """|cell| grad Ni^T C grad Nj for a full tensor, not symmetrized."""
    _, axes, size = shape(df)
    return pairs(df, lambda i, j: F.col(size) * sum((F.col(f"g{i}{a}") * c[a, b] * F.col(f"g{j}{b}") for a in axes for b in axes), F.lit(0.0)))


def mass(df, rho: Column) -> Column:
    """rho |cell| (1 + delta) over 12 for triangles, over 20 for tetrahedra."""
    n, _, size = shape(df)
    return pairs(df, lambda i, j: rho * F.col(size) * (1 + (i == j)) / F.lit(float(n * (n + 1))))


def loads(df, q: Column) -> Column:
    """Array of (row, v): q |cell| shared by the corners."""
    n, _, size = shape(df)
    return F.array(*[F.struct(F.col(f"n{i}").alias("row"), (q * F.col(size) / n).alias("v")) for i in range(n)])


def gradient(df, prefix: str) -> dict[str, Column]:
    """Gradient of the field whose corner values are in columns prefix0, prefix1, .."""
    n, axes, _ = shape(df)
    return {a: sum((F.col(f"{prefix}{k}") * F.col(f"g{k}{a}") for k in range(n)), F.lit(0.0)) for a in axes}


def mean_ratio(df) -> Column:
    """12 (3V)^(2/3) / sum of squared edges for tetrahedra, 4 sqrt(3) A / sum for triangles: 1 when regular."""
    n, axes, size = shape(df)
    edges = TETRAHEDRON_EDGES if n == 4 else TRIANGLE_EDGES
    total = sum(((x(a, c) - x(b, c)) * (x(a, c) - x(b, c)) for a, b in edges for c in axes), F.lit(0.0))
    return 12.0 * F.pow(3.0 * F.col(size), F.lit(2.0 / 3.0)) / total if n == 4 else 4.0 * 3.0**0.5 * F.col(size) / total


def nedelec(df, value) -> Column:
    """Array of (i, j, row edge, col edge, v) over local edges; s0..s2 are edge signs and e0..e2 edge ids."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"e{i}").alias("row"), F.col(f"e{j}").alias("col"), (F.col(f"s{i}") * F.col(f"s{j}") * value(i, j)).alias("v")) for i in range(3) for j in range(3)])


def nedelec_mass(df, w: Column) -> Column:
    """w times the integral of wi . wj, wi = Ns grad Ne - Ne grad Ns, by the exact mass of hat functions."""
    m = lambda a, b: F.col("area") * (1 + (a == b)) / 12.0

    def value(i, j):
        (a, b), (c, d) = TRIANGLE_EDGES[i], TRIANGLE_EDGES[j]
        return w * (m(a, c) * grad_dot(b, d, "xy") - m(a, d) * grad_dot(b, c, "xy") - m(b, c) * grad_dot(a, d, "xy") + m(b, d) * grad_dot(a, c, "xy"))

    return nedelec(df, value)


def nedelec_curl(df, w: Column) -> Column:
    """w times the integral of curl wi curl wj; every basis function has curl 1 / (signed area)."""
    return nedelec(df, lambda i, j: w / F.col("area"))


def edge_gradient(df, w: Column) -> Column:
    """Array of (row node, col edge, v): w |cell| grad Ni . we at the centroid, the exact integral."""
    out = []
    for i in range(3):
        for j, (s, e) in enumerate(TRIANGLE_EDGES):
            v = w * F.col("area") / 3.0 * (grad_dot(i, e, "xy") - grad_dot(i, s, "xy")) * F.col(f"s{j}")
            out.append(F.struct(F.col(f"n{i}").alias("row"), F.col(f"e{j}").alias("col"), v.alias("v")))
    return F.array(*out)
