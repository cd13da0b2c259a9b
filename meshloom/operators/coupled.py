"""Joule heating whose conductivity falls with temperature, over tables: state by fixed point, gradients by its adjoint.

For each case phi is the potential, 0 left and ``volts`` right, and T = t0 + rise the temperature, t0 on both ends, of

    F1 = K(s) phi = 0,    F2 = k K rise - load(s |grad phi|^2) = 0,    s = sigma / (1 + alpha rise) at the corners,

where a cell conducts with the mean of its corners. All cases of cases(case_id, sigma, alpha, volts, k, t0) share the mesh,
which may be large: nodal values are rows (case_id, node_id), cells rows (case_id, cell_id), products and Jacobians are
column expressions on cells, summed by node. A round solves F1 for phi, then F2 for the rise, each from the last round's
values; the rise is relaxed by Aitken's rule, case by case. Every round is written: with ``resume``, an iteration that was cut
off goes on from there. Cases that have settled leave.

The adjoint equations K lam_phi = L'lam_T and k K lam_T = w + M'lam_T - G'lam_phi (L, M: derivatives of the load by
phi and rise, G: of F1 by the rise) are a fixed point of the same kind, with the forward state's matrix kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import elements as el

from . import assembly as asm
from . import krylov
from .mesh import Mesh, geometry
from .physics import side_nodes
from .solve import CgPolicy
from .tables import Tables

POLICY = CgPolicy(relative=1e-12, most=2000)
CORNERS, AXES = range(3), "xy"


def total(parts) -> Column:
    parts = list(parts)
    return sum(parts[1:], parts[0])


def grad(name: str) -> dict[str, Column]:
    return {a: total(F.col(f"{name}{i}") * F.col(f"g{i}{a}") for i in CORNERS) for a in AXES}


def inner(p: dict[str, Column], q: dict[str, Column]) -> Column:
    return total(p[a] * q[a] for a in AXES)


def corner_gradient(i: int) -> dict[str, Column]:
    return {a: F.col(f"g{i}{a}") for a in AXES}


def mass(values) -> list[Column]:
    """|cell| / 12 (1 + delta) times the corners' values."""
    values = list(values)
    return [F.col("area") / 12.0 * (total(values) + v) for v in values]


def at_corners(values) -> Column:
    """Rows (node_id, v) of a cell's corners."""
    return F.inline(F.array(*[F.struct(F.col(f"n{i}").alias("node_id"), v.alias("v")) for i, v in enumerate(values)]))


def relaxed(rows: DataFrame, fields: list[tuple[str, str, str]], change: str, most: float) -> DataFrame:
    """Moves each (value, now, step) by omega times its step ``now``, with omega by Aitken's rule from this step and the one
    before, case by case: - omega step.(now - step) / |now - step|^2, within 0.1 and ``most`` times 4; sets ``change``, the largest
    relative step of a value, and omega."""
    dot = lambda a, b: F.sum(total(a(*f) * b(*f) for f in fields))
    turn = lambda v, now, step: F.col(now) - F.col(step)
    sizes = [F.sqrt(F.coalesce(F.try_divide(F.sum(F.col(now) * F.col(now)), F.sum(F.pow(F.col(v) + F.col(now), 2.0))), F.lit(0.0))) for v, now, _ in fields]
    sums = rows.groupBy("case_id").agg(dot(lambda v, now, step: F.col(step), turn).alias("a"), dot(turn, turn).alias("b"), F.max("omega").alias("o"), (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]).alias("off"))
    aitken = F.coalesce(F.try_divide(-F.col("o") * F.col("a"), F.col("b")), F.col("o"))
    sums = sums.select("case_id", F.greatest(F.least(aitken, F.lit(4.0 * most)), F.lit(0.1)).alias("o"), "off")
    out = rows.drop("omega", change).join(sums, "case_id").withColumnsRenamed({"o": "omega", "off": change})
    return out.withColumns({v: F.col(v) + F.col("omega") * F.col(now) for v, now, _ in fields} | {step: F.col(now) for _, now, step in fields})


class Coupled:
    """The problem of some cases on a mesh; ``solve`` first, then ``gradient``."""

    def __init__(self, cases: DataFrame, mesh: Mesh, relax: float = 1.0, tolerance: float = 1e-10, most: int = 60, resume: Tables | None = None):
        self.relax, self.tolerance, self.most = relax, tolerance, most
        spark = mesh.cells.sparkSession
        self.tables = resume or Tables(spark, "coupled")
        ends = side_nodes(mesh, "left", "right").groupBy("node_id").agg(F.max((F.col("name") == "right").cast("double")).alias("end"))
        self.nodes = self.tables.write("nodes", mesh.nodes.select("node_id").join(ends, "node_id", "left"))
        self.cases = self.tables.write("cases", cases.select("case_id", *[F.col(c).cast("double").alias(c) for c in ("sigma", "alpha", "volts", "k", "t0")]))
        g = self.tables.write("geometry", geometry(mesh))
        # every case has every cell: what a coupled state is made of
        self.cells = self.tables.write("cells", g.crossJoin(F.broadcast(self.cases.select("case_id", "sigma", "alpha", "k"))))
        self.corners = self.tables.write("corners", self.cells.select("case_id", "cell_id", F.posexplode(F.array("n0", "n1", "n2")).alias("corner", "node_id")))
        unit = asm.free_block(asm.stiffness(g, F.lit(1.0)), self.nodes.where("end IS NOT NULL").select("node_id"))
        self.unit = krylov.Matrix(self.tables, unit.select("row", "col", "v"), "unit")

    def __enter__(self) -> Coupled:
        return self

    def __exit__(self, *_) -> None:
        self.unit.__exit__()

    def wide(self, values: DataFrame, names: list[str], active: DataFrame | None = None) -> DataFrame:
        """Cells with the corners' values name0, name1, name2 of values(case_id, node_id, <names>), and s0, s1, s2."""
        corners, cells = self.corners, self.cells
        if active is not None:
            corners, cells = (t.join(active.select("case_id"), "case_id", "left_semi") for t in (corners, cells))
        rows = corners.join(values.select("case_id", "node_id", *names), ["case_id", "node_id"])
        rows = rows.groupBy("case_id", "cell_id").agg(*[F.max(F.when(F.col("corner") == i, F.col(n))).alias(f"{n}{i}") for n in names for i in CORNERS])
        rows = cells.join(rows, ["case_id", "cell_id"])
        return rows.withColumns({f"s{i}": F.col("sigma") / (1 + F.col("alpha") * F.col(f"rise{i}")) for i in CORNERS})

    def conduction(self, wide: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """K(case_id, row, col, v) of F1 on free nodes, and the load of 1 V at the right end."""
        mean = total(F.col(f"s{i}") for i in CORNERS) / 3.0
        entries = wide.select("case_id", F.inline(el.stiffness(wide, mean))).groupBy("case_id", "row", "col").agg(F.sum("v").alias("v"))
        row, col = (self.nodes.select(F.col("node_id").alias(c), F.col("end").alias(f"{c}_end")) for c in ("row", "col"))
        entries = self.tables.write(name, entries.join(row, "row").where("row_end IS NULL").join(col, "col").select("case_id", "row", "col", "v", "col_end"))
        load = entries.groupBy("case_id", "row").agg((-F.sum(F.col("v") * F.coalesce("col_end", F.lit(0.0)))).alias("v"))
        return entries.where("col_end IS NULL").select("case_id", "row", "col", "v"), load

    def summed(self, wide: DataFrame, values) -> DataFrame:
        """(case_id, node_id, v): sums of the corners' values over the cells around each node."""
        return wide.select("case_id", at_corners(values)).groupBy("case_id", "node_id").agg(F.sum("v").alias("v"))

    def on_free(self, rows: DataFrame) -> DataFrame:
        """(case_id, row, v) of (case_id, node_id, v) at free nodes."""
        return rows.join(self.nodes.where("end IS NULL").select("node_id"), "node_id").select("case_id", F.col("node_id").alias("row"), "v")

    def heat(self) -> list[Column]:
        """The load of Joule heat at the corners of cells with rise and phi."""
        e2 = inner(grad("phi"), grad("phi"))
        return mass(F.col(f"s{i}") * e2 for i in CORNERS)

    def everywhere(self, free: DataFrame, name: str) -> DataFrame:
        """(case_id, node_id, <name>) with zeros where ``free``(case_id, node_id, u) has no row."""
        every = self.corners.select("case_id", "node_id").distinct()
        return every.join(free.select("case_id", "node_id", F.col("u").alias(name)), ["case_id", "node_id"], "left").fillna(0.0, [name])

    def solve(self) -> DataFrame:
        """Writes and returns state(case_id, node_id, rise, phi, ...), and sets ``progress``(case_id, change, iterations, converged)."""
        volts = self.cases.select("case_id", "volts")
        n = self.tables.last("state")
        if n is None:
            n, every = 0, self.corners.select("case_id", "node_id").distinct().join(self.nodes, "node_id").join(volts, "case_id")
            held, null = F.coalesce(F.col("end") * F.col("volts"), F.lit(0.0)), F.lit(None).cast("double")
            self.tables.write("state-0", every.select("case_id", "node_id", "end", F.lit(0.0).alias("rise"), held.alias("phi"), null.alias("step"), F.lit(self.relax).alias("omega"), null.alias("change"), F.lit(0).alias("iterations")))
        state = self.tables.read(f"state-{n}")
        settled = (F.col("change") <= self.tolerance) | F.isnan("change")
        while n < self.most:
            active = state.where(~F.coalesce(settled, F.lit(False)))
            if active.isEmpty():
                break
            some = active.select("case_id").distinct()
            k, load = self.conduction(self.wide(active, ["rise"], some), f"K-{n}")
            load = load.join(volts, "case_id").select("case_id", "row", (F.col("v") * F.col("volts")).alias("v"))
            free = active.where("end IS NULL")
            phi = krylov.conjugate_gradients(k, load, POLICY, start=free.select("case_id", "node_id", F.col("phi").alias("u")), verify=False, direct=True)
            now = active.join(phi.select("case_id", "node_id", "u"), ["case_id", "node_id"], "left").withColumn("phi", F.coalesce("u", "phi")).drop("u")
            now = self.tables.write(f"potential-{n}", now)
            wide = self.wide(now, ["rise", "phi"], some)
            source = self.on_free(self.summed(wide.withColumn("area", F.col("area") / F.col("k")), self.heat()))
            rise = krylov.conjugate_gradients(self.unit, source, POLICY, start=free.select("case_id", "node_id", F.col("rise").alias("u")), verify=False, direct=True)
            moved = now.join(rise.select("case_id", "node_id", "u"), ["case_id", "node_id"], "left").fillna(0.0, ["u"])
            moved = self.tables.write(f"moved-{n}", moved.withColumn("now", F.col("u") - F.col("rise")))
            moved = relaxed(moved, [("rise", "now", "step")], "change", self.relax)
            moved = moved.withColumn("iterations", F.col("iterations") + 1).drop("u")
            rest = state.where(F.coalesce(settled, F.lit(False)))
            state = self.tables.write(f"state-{n + 1}", moved.select(*state.columns).unionByName(rest))
            self.tables.drop(f"K-{n}", f"potential-{n}", f"moved-{n}", f"state-{n}")
            n += 1
        self.state = state
        self.progress = state.groupBy("case_id").agg(F.max("change").alias("change"), F.max("iterations").alias("iterations"), F.min(F.coalesce((F.col("change") <= self.tolerance), F.lit(False))).alias("converged"))
        return state

    def report(self) -> DataFrame:
        """(case_id, rise_max, rise_mean, power, charge, heat, change, iterations, converged): charge and heat are relative
        imbalances, of the currents at both ends, and of the power and the heat that leaves."""
        wide = self.wide(self.state, ["rise", "phi"])
        mean = total(F.col(f"s{i}") for i in CORNERS) / 3.0
        current = [F.col("area") * mean * inner(grad("phi"), corner_gradient(i)) for i in CORNERS]
        leaves = [F.col("area") * F.col("k") * inner(grad("rise"), corner_gradient(i)) - q for i, q in zip(CORNERS, self.heat())]
        rows = wide.select("case_id", F.inline(F.array(*[F.struct(F.col(f"n{i}").alias("node_id"), c.alias("current"), g.alias("gone"), q.alias("power")) for i, c, g, q in zip(CORNERS, current, leaves, self.heat())])))
        rows = rows.groupBy("case_id", "node_id").agg(*[F.sum(c).alias(c) for c in ("current", "gone", "power")]).join(self.nodes, "node_id")
        at = lambda end: F.sum(F.when(F.col("end") == end, F.col("current")).otherwise(0.0))
        sums = rows.groupBy("case_id").agg(at(0.0).alias("one"), at(1.0).alias("other"), F.sum("power").alias("power"), F.sum(F.when(F.col("end").isNotNull(), F.col("gone")).otherwise(0.0)).alias("gone"))
        peak = self.state.groupBy("case_id").agg(F.max("rise").alias("rise_max"), F.avg("rise").alias("rise_mean"))
        off = lambda a, b: F.coalesce(F.try_divide(F.abs(F.col(a) + F.col(b)), F.abs(a) + F.abs(b)), F.lit(0.0))
        out = peak.join(sums, "case_id").join(self.progress, "case_id")
        return out.select("case_id", "rise_max", "rise_mean", "power", off("one", "other").alias("charge"), off("power", "gone").alias("heat"), "change", "iterations", "converged")

    def gradient(self) -> DataFrame:
        """(case_id, sigma, alpha, k, volts, t0): derivatives of the mean temperature over the nodes."""
        count = self.nodes.count()
        forward = self.tables.write("forward", self.state.join(self.nodes.select("node_id", F.coalesce("end", F.lit(0.0)).alias("right")), "node_id"))
        k, _ = self.conduction(self.wide(forward, ["rise"]), "K-adjoint")
        null = F.lit(None).cast("double")
        adjoint = forward.select("case_id", "node_id", "end", "rise", "phi", "right", F.lit(0.0).alias("lt"), F.lit(0.0).alias("lp"), null.alias("lt_step"), null.alias("lp_step"), F.lit(1.0).alias("omega"), null.alias("change"))
        adjoint = self.tables.write("adjoint-0", adjoint)
        names = ["rise", "phi", "lt", "lp", "right"]
        with krylov.Matrix(self.tables, k, "K-kept") as matrix:
            for n in range(self.most):
                wide = self.wide(adjoint, names)
                # w + M'lam_T - G'lam_phi over k, on free nodes
                direct = self.summed(wide, [(a - b) / F.col("k") for a, b in zip(self.load_by_rise(), self.flux_by_rise())])
                seed = self.nodes.select("node_id", F.lit(1.0 / count).alias("w")).crossJoin(F.broadcast(self.cases.select("case_id", "k")))
                seed = seed.select("case_id", "node_id", (F.col("w") / F.col("k")).alias("v"))
                right = self.on_free(direct.unionByName(seed).groupBy("case_id", "node_id").agg(F.sum("v").alias("v")))
                start = lambda c: adjoint.where("end IS NULL").select("case_id", "node_id", F.col(c).alias("u"))  # noqa: B023, E731
                lt = krylov.conjugate_gradients(self.unit, right, POLICY, start=start("lt"), verify=False, direct=True)
                half = self.tables.write(f"half-{n}", self.with_step(adjoint, lt, "lt"))
                tried = half.withColumn("lt", F.col("lt") + F.col("lt_now"))
                lp = krylov.conjugate_gradients(matrix, self.on_free(self.summed(self.wide(tried, names), self.load_by_phi())), POLICY, start=start("lp"), verify=False, direct=True)
                moved = self.tables.write(f"both-{n}", self.with_step(half, lp, "lp"))
                moved = relaxed(moved, [("lt", "lt_now", "lt_step"), ("lp", "lp_now", "lp_step")], "change", 1.0)
                moved = self.tables.write(f"adjoint-{n + 1}", moved.select(*adjoint.columns))
                self.tables.drop(f"adjoint-{n}", f"half-{n}", f"both-{n}")
                adjoint = moved
                if moved.where(f"NOT change <= {self.tolerance}").isEmpty():
                    break
            else:
                raise ValueError("the adjoint iteration doesn't settle")
        wide = self.wide(adjoint, names)
        e2, mean = inner(grad("phi"), grad("phi")), total(F.col(f"s{i}") for i in CORNERS) / 3.0
        by_alpha = [-F.col(f"s{i}") * F.col(f"rise{i}") / (1 + F.col("alpha") * F.col(f"rise{i}")) for i in CORNERS]
        lam_load = total(F.col(f"lt{i}") * q for i, q in zip(CORNERS, self.heat()))
        lam_alpha = total(F.col(f"lt{i}") * q for i, q in zip(CORNERS, mass(s * e2 for s in by_alpha)))
        d_alpha = lam_alpha - F.col("area") * total(by_alpha) / 3.0 * inner(grad("lp"), grad("phi"))
        lam_s = total(F.col(f"lt{i}") * q for i, q in zip(CORNERS, mass(F.col(f"s{i}") for i in CORNERS)))
        d_volts = 2 * lam_s * inner(grad("phi"), grad("right")) - F.col("area") * mean * inner(grad("lp"), grad("right"))
        sums = wide.groupBy("case_id").agg(F.sum(lam_load / F.col("sigma")).alias("sigma"), F.sum(d_alpha).alias("alpha"), F.sum(-lam_load / F.col("k")).alias("k"), F.sum(d_volts).alias("volts"))
        return sums.withColumn("t0", F.lit(1.0))  # both fields follow T - t0

    @staticmethod
    def with_step(rows: DataFrame, free: DataFrame, name: str) -> DataFrame:
        """Adds <name>_now, by how much the new values (zero at held nodes) differ from the old."""
        out = rows.join(free.select("case_id", "node_id", "u"), ["case_id", "node_id"], "left")
        return out.withColumn(f"{name}_now", F.coalesce("u", F.lit(0.0)) - F.col(name)).drop("u")

    def by_rise(self) -> list[Column]:
        """d s / d rise at the corners."""
        return [-F.col(f"s{i}") * F.col("alpha") / (1 + F.col("alpha") * F.col(f"rise{i}")) for i in CORNERS]

    def load_by_rise(self) -> list[Column]:
        """M'lam_T at the corners."""
        e2 = inner(grad("phi"), grad("phi"))
        return [m * d * e2 for m, d in zip(mass(F.col(f"lt{i}") for i in CORNERS), self.by_rise())]

    def flux_by_rise(self) -> list[Column]:
        """G'lam_phi at the corners."""
        return [F.col("area") * inner(grad("lp"), grad("phi")) * d / 3.0 for d in self.by_rise()]

    def load_by_phi(self) -> list[Column]:
        """L'lam_T at the corners."""
        lam = total(F.col(f"lt{i}") * q for i, q in zip(CORNERS, mass(F.col(f"s{i}") for i in CORNERS)))
        return [2 * lam * inner(grad("phi"), corner_gradient(i)) for i in CORNERS]
