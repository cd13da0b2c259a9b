"""Registered queries of port modes: matrix-free kernels, fields, staggered samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshloom.operators import mesh, physics, port
from meshloom.plans.registry import EDGES_SQL, dot, query, r9, square_sql, table

WIDTH, HEIGHT, HZ = 2e-6, 1e-6, 1e14
N = 4
NODES = (N + 1) ** 2
EDGES = 3 * N * N + 2 * N
EXACT = float(np.sqrt((2 * np.pi * HZ / physics.LIGHT) ** 2 - (np.pi / WIDTH) ** 2))


def guide(spark, n: int = N):
    return mesh.unit_square(spark, n, WIDTH, HEIGHT)


def one_case(spark, frequency: float = HZ, eps: float = 1.0):
    return spark.createDataFrame([(0, frequency, eps, 1.0)], "case_id long, frequency double, eps_r double, mu_r double")


def by_case(rows, run, schema):
    return rows.groupBy("case_id").applyInPandas(run, schema)


def pencil_sql() -> str:
    m = lambda a, b: f"area * {1 + (a == b)} / 12.0"
    e = ((0, 1), (1, 2), (2, 0))
    out = []
    for i in range(6):
        for j in range(6):
            b = "0.0"
            if i < 3 and j < 3:
                a = f"-2.0 * {m(i, j)}"
            elif i < 3 or j < 3:
                node, edge = (i, j - 3) if i < 3 else (j, i - 3)
                s, t = e[edge]
                a = f"{2.0 if i < 3 else 3.0} * area / 3.0 * ({dot(node, t, 'xy')} - {dot(node, s, 'xy')}) * s{edge}"
            else:
                (p, q), (r, s) = e[i - 3], e[j - 3]
                n = f"s{i - 3} * s{j - 3} * ({m(p, r)} * {dot(q, s, 'xy')} - {m(p, s)} * {dot(q, r, 'xy')} - {m(q, r)} * {dot(p, s, 'xy')} + {m(q, s)} * {dot(p, r, 'xy')})"
                a, b = f"3.0 * s{i - 3} * s{j - 3} / area - 2.5 * 2.0 * {n}", f"3.0 * {n}"
            out.append(f"SELECT cell_id, {i} AS i, {j} AS j, {a} AS a, {b} AS b FROM gp")
    return f"""WITH {square_sql(N)}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce)),
rim AS (SELECT edge_id, lo, hi FROM ce JOIN ids USING (lo, hi) GROUP BY ALL HAVING count(*) = 1),
wide AS (SELECT cell_id, {", ".join(f"max(sign) FILTER (local = {k}) AS s{k}" for k in range(3))} FROM ce GROUP BY 1),
gp AS (SELECT * FROM g JOIN wide USING (cell_id)), pencil AS ({" UNION ALL ".join(out)}),
full_dofs AS (SELECT cell_id, unnest([0, 1, 2]) AS local, unnest([n0, n1, n2]) AS d FROM cells UNION ALL SELECT cell_id, local + 3, edge_id + {NODES} FROM ce JOIN ids USING (lo, hi)),
fd AS (SELECT cell_id, local, d AS dof FROM full_dofs WHERE d NOT IN (SELECT unnest([lo, hi]) FROM rim) AND d NOT IN (SELECT edge_id + {NODES} FROM rim))"""


def unit_pencil(spark):
    """The local pencil of the unit square with permittivity 2, reluctivity 3 and a squared frequency of 2.5."""
    m = mesh.unit_square(spark, N)
    return m, port.local_pencil(physics.port_rows(m), F.lit(2.0), F.lit(3.0), F.lit(2.5))


@query(f"{pencil_sql()} SELECT cell_id, i, j, round(a, 9) + 0.0 AS a, round(b, 9) + 0.0 AS b FROM pencil")
def port_local_pencil(spark, sf):
    """The pair of 6 by 6 matrices of every cell."""
    return unit_pencil(spark)[1].select("cell_id", "i", "j", r9(F.col("a")).alias("a"), r9(F.col("b")).alias("b"))


@query(f"""{pencil_sql()}, entry AS (SELECT p.dof AS r, q.dof AS c, abs(a - 4.0 * b) AS m FROM pencil JOIN fd p ON p.cell_id = pencil.cell_id AND p.local = i JOIN fd q ON q.cell_id = pencil.cell_id AND q.local = j)
SELECT dof, round(sum(rs), 9) AS row_sum, round(sum(cs), 9) AS col_sum FROM (SELECT r AS dof, m AS rs, 0.0 AS cs FROM entry UNION ALL SELECT c, 0.0, m FROM entry) GROUP BY 1""")
def port_equilibration(spark, sf):
    """Sums of magnitudes of shifted cell entries by row and column, for scaling."""
    m, pencil = unit_pencil(spark)
    return port.row_sums(pencil, port.reduced_cells(m), F.lit(4.0)).select("dof", F.round("row_sum", 9).alias("row_sum"), F.round("col_sum", 9).alias("col_sum"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS case_id, true AS solved, true AS plain, true AS inverted FROM nation")
def port_shift_solve(spark, sf):
    """(A - shift B) x = b for every nation, whose number gives the permittivity and the shift: GMRES with and without its preconditioner meets the dense solution; the
    inverse takes B x back."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    shifts = nations.select(F.col("id").alias("case_id"), F.lit(HZ).alias("frequency"), (1.0 + F.col("id") / 10).alias("eps_r"), F.lit(1.0).alias("mu_r"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell_id")
        p = port.Pencil.of(part, NODES)
        shift = -(1.6 + part["case_id"].iloc[0] / 10) * (2 * np.pi * HZ / physics.LIGHT) ** 2
        s = port.Shifted(p, shift)
        b = np.random.default_rng(3).normal(size=p.n) * s.rows
        matrix = s.left[:, None] * p.dense(s.local) * s.right
        dense = s.right * np.linalg.solve(matrix, s.left * b)
        x, e1 = s.solve(b)
        y, e2 = s.solve(b, preconditioned=False)
        near = lambda u, v: bool(np.linalg.norm(s.cols * (u - v)) <= 1e-6 * np.linalg.norm(s.cols * v))
        z, e3 = s.invert(x)
        back = s.right * np.linalg.solve(matrix, s.left * (p.dense(p.b) @ x))
        return pd.DataFrame({"case_id": part["case_id"].iloc[:1], "solved": near(x, dense) and e1 <= 5e-10, "plain": near(y, dense) and e2 <= 5e-10, "inverted": near(z, back) and e3 <= 5e-10})

    return by_case(port.kernel_rows(guide(spark), shifts), run, "case_id long, solved boolean, plain boolean, inverted boolean")


@query("SELECT r.id AS mode, true AS agrees, true AS small FROM range(3) r(id)")
def port_arnoldi(spark, sf):
    """Three modes by Arnoldi without a global matrix, against the dense reduced problem."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell_id")
        p, dense, _, _ = port.modes_of(part, NODES, 3)
        beta, _, res = port.arnoldi(p, -1.3 * (2 * np.pi * HZ / physics.LIGHT) ** 2, 3, 20)
        return pd.DataFrame({"mode": np.arange(3), "agrees": np.abs(beta - dense) <= 1e-7 * np.abs(dense), "small": res <= 1e-6})

    return by_case(port.kernel_rows(guide(spark), one_case(spark)), run, "mode long, agrees boolean, small boolean")


@query("SELECT n, e AS relative_error, true AS one_mode FROM (VALUES (4, 0.001091), (6, 0.000556), (8, 0.000326)) t(n, e)")
def port_te10(spark, sf):
    """Relative error of the first propagation constant on meshes of 4, 6 and 8 intervals; one mode propagates."""
    out = None
    for n in (4, 6, 8):
        rows = by_case(port.kernel_rows(guide(spark, n), one_case(spark)), first_mode(n), "n int, relative_error double, one_mode boolean")
        out = rows if out is None else out.unionByName(rows)
    return out


def first_mode(n: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        _, beta, _, _ = port.modes_of(part.sort_values("cell_id"), (n + 1) ** 2, 3)
        return pd.DataFrame({"n": [n], "relative_error": [round(float(abs(beta[0] / EXACT - 1)), 6)], "one_mode": [bool(beta[0].real > 0 and abs(beta[1].real) < 1e-3 * abs(beta[1]))]})

    return run


@query("SELECT true AS same, true AS across")
def port_subspaces(spark, sf):
    """Spaces of two modes: equal to a rotated basis of themselves, orthogonal to the next two."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p, _, vec, _ = port.modes_of(part.sort_values("cell_id"), NODES, 4)
        m = port.schur(*port.dense_pair(p), p.scalars)[1]
        turned = vec[:, :2] @ np.array([[0.6, 0.8], [-0.8, 0.6]])
        return pd.DataFrame({"same": [bool(port.subspace_cosines(vec[:, :2], turned, m).min() > 1 - 1e-9)], "across": [bool(port.subspace_cosines(vec[:, :2], vec[:, 2:], m).max() < 1e-5)]})

    return by_case(port.kernel_rows(guide(spark), one_case(spark)), run, "same boolean, across boolean")


@query("SELECT true AS admitted, true AS value_agrees, true AS vector_agrees")
def port_simple_gradient(spark, sf):
    """Derivatives of the first eigenvalue and of a functional of its vector by a change of both matrices, against
    differences."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p = port.Pencil.of(part.sort_values("cell_id"), NODES)
        s, m = port.schur(*port.dense_pair(p), p.scalars)
        s = s / (2 * np.pi * HZ / physics.LIGHT) ** 2  # eigenvalues near 1
        r, h = np.linspace(0.5, 1.5, len(m)), 1e-5
        ds, dm = np.outer(r, r[::-1]) * s, np.outer(r, r) * m
        lam, x, y, told = port.simple_pair(s, m, 0)
        up, down = (port.simple_pair(s + t * ds, m + t * dm, 0) for t in (h, -h))
        weight = np.linspace(0, 1, len(x)) / np.abs(x).max()
        one, two = (sum((g * d).sum() for g, d in zip(port.pair_pullback(s, m, lam, x, y, *seeds), (ds, dm))) for seeds in ((1.0,), (0.0, weight)))
        first, second = (up[0] - down[0]) / (2 * h), weight @ (up[1] - down[1]) / (2 * h)
        near = lambda a, b: bool(abs(a - b) <= 1e-4 * abs(b) + 1e-6)
        return pd.DataFrame({"admitted": [told["residual"] < 1e-10], "value_agrees": [near(one, first)], "vector_agrees": [near(two, second)]})

    return by_case(port.kernel_rows(guide(spark), one_case(spark)), run, "admitted boolean, value_agrees boolean, vector_agrees boolean")


@query("SELECT 2 AS size, true AS eigenvalues, true AS constants")
def port_cluster(spark, sf):
    """Sums over two modes that are nearly one (the second and third) by 32 points of a circle, one task a point, against
    the dense spectrum."""
    rows = port.kernel_rows(guide(spark), one_case(spark))
    k2 = (2 * np.pi * HZ / physics.LIGHT) ** 2

    def spectrum(part: pd.DataFrame):
        p = port.Pencil.of(part.sort_values("cell_id"), NODES)
        s, m = port.schur(*port.dense_pair(p), p.scalars)
        s = s / k2
        lam = np.sort(np.linalg.eigvals(np.linalg.solve(m, s)).real)
        return s, m, lam[1:3], (lam[1] + lam[2]) / 2, (lam[2] - lam[1]) / 2 + min(lam[1] - lam[0], lam[3] - lam[2]) / 2

    def point(key, part: pd.DataFrame) -> pd.DataFrame:
        s, m, _, center, radius = spectrum(part)
        right = np.random.default_rng(1).normal(size=(len(m), 2))
        left = np.random.default_rng(2).normal(size=(len(m), 2))
        z = center + radius * np.exp(2j * np.pi * (key[0] + 0.5) / 32)
        value = port.contour_point(s, m, z, right, left).ravel()
        return pd.DataFrame({"k": [key[0]], "re": [value.real.tolist()], "im": [value.imag.tolist()]})

    points = rows.crossJoin(F.broadcast(spark.range(32).withColumnRenamed("id", "k")))
    moments = points.groupBy("k").applyInPandas(point, "k long, re array<double>, im array<double>")

    def total(key, cells: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        _, _, lam, center, radius = spectrum(cells)
        found = found.sort_values("k")
        values = (np.array(found["re"].tolist()) + 1j * np.array(found["im"].tolist())).reshape(-1, 2, 2)
        z = center + radius * np.exp(2j * np.pi * (found["k"].to_numpy() + 0.5) / 32)
        size, one, two = port.cluster_sums(values, z, center, radius)
        return pd.DataFrame({"size": [size], "eigenvalues": [bool(abs(one - lam.sum()) < 1e-5 * abs(lam).sum())], "constants": [bool(abs(two - port.branch(lam).sum()) < 1e-5 * abs(port.branch(lam)).sum())]})

    tagged = rows.select(F.lit(0).alias("one"), *[F.col(c).alias(c) for c in rows.columns])
    return tagged.groupBy("one").cogroup(moments.select(F.lit(0).alias("one"), "k", "re", "im").groupBy("one")).applyInPandas(total, "size int, eigenvalues boolean, constants boolean")


@query(f"SELECT 1.0 AS power, true AS profile, true AS anchored, {NODES} AS nodes")
def port_fields(spark, sf):
    """Nodal fields of the first mode at a power of 1: E is vertical and follows sin(pi x / a) along the guide's middle."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell_id")
        p, beta, vec, _ = port.modes_of(part, NODES, 1)
        full = port.whole(p, vec[:, 0], NODES + EDGES)
        e, h, size = port.fields_at(part, full, NODES, beta[0], port.POINTS)
        power = port.forward_power(e, h, size)
        nodal = port.projected(part, np.concatenate([e, h], 2), size, NODES)
        en, hn = port.normalized(nodal[:, :3], nodal[:, 3:], power, 1.0)
        again = port.forward_power(e * np.sqrt(1 / power), h * np.sqrt(1 / power), size)
        row = en[(N // 2) * (N + 1) : (N // 2 + 1) * (N + 1), 1]
        sine = np.sin(np.pi * np.arange(N + 1) / N)
        return pd.DataFrame({"power": [round(again, 9)], "profile": [bool(np.abs(row / row[N // 2] - sine).max() < 0.2)], "anchored": [bool(abs(en.ravel()[np.abs(en).argmax()].imag) < 1e-9 * np.abs(en).max())], "nodes": [len(hn)]})

    return by_case(port.kernel_rows(guide(spark), one_case(spark)), run, "power double, profile boolean, anchored boolean, nodes int")


@query("SELECT component, 64 AS points, 2.5 AS power, true AS near FROM (SELECT unnest(['Ex', 'Ey', 'Ez', 'Hx', 'Hy', 'Hz']) AS component)")
def yee_mode_samples(spark, sf):
    """The first mode at the staggered points of an 8 by 8 grid, scaled to 2.5 W; the scale is near that of the exact
    integral."""
    xs, ys = np.linspace(0, WIDTH, 9), np.linspace(0, HEIGHT, 9)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell_id")
        p, beta, vec, _ = port.modes_of(part, NODES, 1)
        full = port.whole(p, vec[:, 0], NODES + EDGES)
        samples, power, scale = port.yee_plane(part, full, NODES, beta[0], xs, ys, 2.5)
        exact = port.forward_power(*port.fields_at(part, full, NODES, beta[0], port.POINTS))
        names = sorted(samples)
        return pd.DataFrame({"component": names, "points": [samples[n].size for n in names], "power": round(power * scale**2, 9), "near": bool(abs(power / exact - 1) < 0.1)})

    return by_case(port.kernel_rows(guide(spark), one_case(spark)), run, "component string, points int, power double, near boolean")


@query(f"SELECT r.id AS dof, CASE WHEN r.id % 3 = 1 THEN 0.5 * r.id ELSE 0.0 END AS value FROM range({NODES + EDGES}) r(id)")
def port_expanded(spark, sf):
    """Reduced coefficients in the full space, zero where walls hold them."""
    some = spark.range(NODES + EDGES).where("id % 3 = 1").select(F.col("id").alias("dof"), (0.5 * F.col("id")).alias("value"))
    return port.expanded(some, NODES, EDGES)


@query(f"""WITH {square_sql(N)}, {EDGES_SQL}, ids AS (SELECT lo, hi, row_number() OVER (ORDER BY lo, hi) - 1 AS edge_id FROM (SELECT DISTINCT lo, hi FROM ce))
SELECT edge_id, CASE WHEN (lo + hi) % 2 = 0 THEN 1.0 ELSE -1.0 END * (lo * 100 + hi) AS value FROM ids""")
def edge_reorder(spark, sf):
    """Edge coefficients of another numbering and orientation, by their end nodes."""
    edges, _ = mesh.edge_map(mesh.unit_square(spark, N))
    even = (F.col("lo") + F.col("hi")) % 2 == 0
    foreign = edges.select((1000 - F.col("edge_id")).alias("foreign_id"), F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("b"), "lo", "hi")
    values = foreign.select("foreign_id", (F.col("lo") * 100 + F.col("hi")).cast("double").alias("value"))
    return port.reordered_edges(values, foreign.select("foreign_id", "a", "b"), edges)


@query("SELECT p_partkey, p_size * 576 AS value_bytes, p_size * 24 AS index_bytes, p_size * 600 AS total_bytes, p_size * p_size * 16 AS dense_bytes, round(p_size * 16 / 600.0, 9) AS ratio FROM part")
def port_storage(spark, sf):
    """Bytes of cell matrices against two dense ones, for as many cells and dofs as a part's size."""
    out = port.storage(F.col("p_size").cast("long"), F.col("p_size").cast("long"))
    return table(spark, sf, "part").select("p_partkey", *[(F.round(v, 9) if k == "ratio" else v).alias(k) for k, v in out.items()])
