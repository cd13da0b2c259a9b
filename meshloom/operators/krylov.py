"""Krylov solvers whose vectors are tables, for any number of systems at once.

A vector is a table (case_id, node_id, value), a matrix K(case_id, row, col, v), or K(row, col, v) shared by all cases. What
belongs to a case, such as a step size, is an aggregate by case_id, joined back; nothing of a system meets in one group
or on the driver. One iteration advances all cases, finished ones are masked, and leave the state when
they are more than half of it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substructure
from .mesh import ContractError
from .solve import CgPolicy
from .tables import Tables

#: Entries of a matrix in a partition.
ENTRIES = 200_000
#: Iterations between two looks at how many cases are left.
LOOK = 2
#: A solution whose recomputed residual is above the target is corrected, from where it stands, so often.
CORRECTIONS = 1


@contextmanager
def shuffles(spark: SparkSession, parts: int):
    """No more partitions of a shuffle than the matrix has, within: small systems don't pay for empty tasks."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), parts)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Matrix:
    """A matrix that is written, and kept in memory by the column that products join on: no product shuffles its entries. What
    an executor loses is read again."""

    def __init__(self, tables: Tables, k: DataFrame, name: str = "K"):
        self.shared = "case_id" not in k.columns
        self.keys = ["node_id"] if self.shared else ["case_id", "node_id"]
        ids = [] if self.shared else ["case_id"]
        written = tables.write(name, k.select(*ids, "row", F.col("col").alias("node_id"), "v"))
        self.parts = max(1, -(-written.count() // ENTRIES))
        self.entries = written.repartition(self.parts, *self.keys).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Matrix:
        return self

    def __exit__(self, *_) -> None:
        self.entries.unpersist()

    def times(self, x: DataFrame, name: str, out: str) -> DataFrame:
        """(case_id, node_id, <out>) of K x for x(case_id, node_id, <name>)."""
        rows = self.entries.join(x.select("case_id", "node_id", name), self.keys)
        return rows.groupBy("case_id", F.col("row").alias("node_id")).agg(F.sum(F.col("v") * F.col(name)).alias(out))

    def diagonal(self) -> DataFrame:
        """([case_id,] node_id, d)"""
        return self.entries.where("row = node_id").select(*self.keys, F.col("v").alias("d"))


def conjugate_gradients(k: DataFrame | Matrix, f: DataFrame, policy: CgPolicy = CgPolicy(relative=1e-11, most=400), start: DataFrame | None = None, precondition: Callable[[DataFrame], DataFrame] | None = None, verify: bool = True, direct: bool = False) -> DataFrame:
    """(case_id, node_id, u, iterations, backward_error, converged) of K u = f for every case of f(case_id, row, v).

    Preconditioned conjugate gradients with one product and one reduction an iteration: a step is one written state, from
    which the next one's step sizes are summed by case. ``precondition`` maps (case_id, node_id, r) to (case_id, node_id, z); the
    inverse diagonal where it is None. ``start``(case_id, node_id, u) is where the iteration begins. A solution counts if its
    recomputed residual is small against |K| |u| + |f|; else it is NaN. Without ``verify``, as
    inside an outer iteration that has its own test, the last state is returned as it is. Many solves with one matrix share a
    ``Matrix``. With ``direct`` the first solution is that of ``substructure`` where the numbering allows it, whose rounds don't
    grow with the condition; the iteration then corrects what isn't admitted.
    """
    tables = Tables(f.sparkSession, "cg")
    with nullcontext(k) if isinstance(k, Matrix) else Matrix(tables, k) as matrix, shuffles(f.sparkSession, matrix.parts):
        x = None if start is None else start.select("case_id", "node_id", F.col("u").alias("x"), F.lit(0).alias("steps"))
        for attempt in range(CORRECTIONS + 1):
            found = by_substructures(tables, matrix, f) if direct and not attempt else None
            x = found if found is not None else run(tables, matrix, unknowns(matrix, f), x, policy, precondition, attempt)
            good = F.col("backward_error") <= policy.backward
            out = x if not verify else x.join(F.broadcast(errors(matrix, x)), "case_id")
            u = F.col("x") if not verify else F.when(good, F.col("x")).otherwise(F.lit(float("nan")))
            told = [F.lit(None).cast("double").alias("backward_error"), F.lit(None).cast("boolean").alias("converged")] if not verify else ["backward_error", good.alias("converged")]
            out = out.select("case_id", "node_id", u.alias("u"), F.col("steps").alias("iterations"), *told)
            if not verify:
                return out
            out = tables.write(f"solution-{attempt}", out)
            if attempt == CORRECTIONS or not out.where("NOT converged").count():
                return out


def by_substructures(tables: Tables, matrix: Matrix, f: DataFrame) -> DataFrame | None:
    """(case_id, node_id, d, b, x, steps) by direct solution, None where the numbering doesn't allow it."""
    rows = tables.write("unknowns", unknowns(matrix, f))
    k = matrix.entries.withColumnRenamed("node_id", "col")
    u = substructure.solve(tables, "direct", k, rows.select("case_id", F.col("node_id").alias("row"), F.col("b").alias("v")), matrix.parts)
    if u is None:
        return None
    return rows.join(u.withColumnRenamed("u", "x"), ["case_id", "node_id"], "left").select("case_id", "node_id", "d", "b", "x", F.lit(0).alias("steps"))


def exact(tables: Tables, k: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A preconditioner for K(row, col, v): the solution by substructures, so that few steps are needed whatever the condition."""
    k, calls = tables.write("exact-K", k.select("row", "col", "v")), count()

    def apply(r: DataFrame) -> DataFrame:
        name = f"exact-{next(calls)}"
        r = tables.write(f"{name}-r", r.select("case_id", F.col("node_id").alias("row"), F.col("r").alias("v")))
        z = substructure.solve(tables, name, k, r)
        if z is None:
            raise ContractError("linked nodes' numbers are too far apart")
        return z.withColumnRenamed("u", "z")

    return apply


def unknowns(matrix: Matrix, f: DataFrame) -> DataFrame:
    """(case_id, node_id, d, b): a row for each row of the matrix, of a shared one in every case of f."""
    rows = matrix.diagonal()
    if matrix.shared:
        # cases of a shared matrix are right-hand sides, few enough to lie in one row
        cases = f.select("case_id").distinct().agg(F.collect_set("case_id").alias("cases"))
        rows = rows.crossJoin(F.broadcast(cases)).select(F.explode("cases").alias("case_id"), "node_id", "d")
    b = f.select("case_id", F.col("row").alias("node_id"), F.col("v").alias("b"))
    return rows.join(b, ["case_id", "node_id"], "left").select("case_id", "node_id", "d", F.coalesce("b", F.lit(0.0)).alias("b"))


def errors(matrix: Matrix, x: DataFrame) -> DataFrame:
    """(case_id, backward_error) of x(case_id, node_id, d, b, x): the recomputed residual against |K| |x| + |b|; infinite where
    the diagonal isn't positive."""
    both = matrix.entries.join(x.select("case_id", "node_id", "x"), matrix.keys).groupBy("case_id", F.col("row").alias("node_id"))
    both = both.agg(F.sum(F.col("v") * F.col("x")).alias("kx"), F.sum(F.abs(F.col("v") * F.col("x"))).alias("size"))
    rows = x.join(both, ["case_id", "node_id"], "left").fillna(0.0, ["kx", "size"])
    sums = rows.groupBy("case_id").agg(F.sqrt(F.sum(F.pow(F.col("b") - F.col("kx"), 2.0))).alias("off"), F.sqrt(F.sum(F.pow(F.col("size") + F.abs("b"), 2.0))).alias("of"), F.min("d").alias("d"))
    error = F.when(F.col("d") <= 0, float("inf")).when(F.col("of") > 0, F.col("off") / F.col("of")).otherwise(0.0)
    return sums.select("case_id", error.alias("backward_error"))


def run(tables: Tables, matrix: Matrix, rows: DataFrame, x: DataFrame | None, policy: CgPolicy, precondition, attempt: int) -> DataFrame:
    """(case_id, node_id, d, b, x, steps) from x(case_id, node_id, x, steps) or zero; rows: (case_id, node_id, d, b)."""
    name = lambda n: f"{attempt}-{n}"
    ids, kept = ["case_id", "node_id"], ["case_id", "node_id", "d", "b", "x", "steps"]

    def with_products(rows: DataFrame) -> DataFrame:
        """Adds u, the preconditioned residual, and w = K u."""
        if precondition is None:
            rows = rows.withColumn("u", F.col("r") / F.col("d"))
        else:
            rows = rows.join(precondition(rows.select(*ids, "r")).withColumnRenamed("z", "u"), ids)
        return rows.join(matrix.times(rows, "u", "w"), ids, "left").fillna(0.0, ["w"])

    if x is None:
        rows = rows.withColumns({"x": F.lit(0.0), "r": F.col("b"), "steps": F.lit(0)})
    else:
        rows = rows.join(x.select(*ids, "x", "steps"), ids, "left").fillna(0.0, ["x"]).fillna(0, ["steps"])
        rows = rows.join(matrix.times(rows, "x", "kx"), ids, "left").withColumn("r", F.col("b") - F.coalesce("kx", F.lit(0.0))).drop("kx")
    rows = rows.withColumns({"p": F.lit(0.0), "s": F.lit(0.0), "gamma0": F.lit(None).cast("double"), "alpha0": F.lit(None).cast("double")})
    state, done, n = tables.write(name(0), with_products(rows)), [], 0
    while True:
        sums = state.groupBy("case_id").agg(
            F.sum(F.col("r") * F.col("u")).alias("gamma"), F.sum(F.col("w") * F.col("u")).alias("delta"), F.sum(F.col("r") * F.col("r")).alias("rr"),
            F.sum(F.col("b") * F.col("b")).alias("bb"), F.max("gamma0").alias("before"), F.max("alpha0").alias("last"),
        )
        beta = F.coalesce(F.try_divide("gamma", "before"), F.lit(0.0))
        curve = F.col("delta") - F.coalesce(beta * F.try_divide("gamma", "last"), F.lit(0.0))
        # a case goes on while its residual is above its target and the matrix bends upwards along the step
        far = F.col("rr") > F.greatest(policy.relative**2 * F.col("bb"), F.lit(policy.absolute**2))
        sums = sums.select("case_id", beta.alias("beta"), F.when(far & (curve > 0), F.col("gamma") / curve).alias("alpha"), "gamma")
        if n >= policy.most:
            break
        if n % (LOOK if precondition is None else 1) == 0 and (n or x is not None):
            cases, left = sums.agg(F.count("*"), F.count("alpha")).first()
            if not left:
                break
            if 2 * left < cases:
                over = state.join(sums.where("alpha IS NULL"), "case_id", "left_semi")
                done.append(tables.write(name(f"done-{n}"), over.select(*kept)))
                sums = sums.where("alpha IS NOT NULL")
        going = F.col("alpha").isNotNull()
        moved = state.drop("gamma0", "alpha0").join(sums, "case_id")
        moved = moved.withColumns({"p": F.when(going, F.col("u") + F.col("beta") * F.col("p")).otherwise(F.col("p")), "s": F.when(going, F.col("w") + F.col("beta") * F.col("s")).otherwise(F.col("s"))})
        moved = moved.withColumns({"x": F.when(going, F.col("x") + F.col("alpha") * F.col("p")).otherwise(F.col("x")), "r": F.when(going, F.col("r") - F.col("alpha") * F.col("s")).otherwise(F.col("r"))})
        moved = moved.withColumns({"steps": F.col("steps") + going.cast("int"), "gamma0": F.col("gamma"), "alpha0": F.coalesce("alpha", F.lit(1.0))}).drop("u", "w", "alpha", "beta", "gamma")
        state = tables.write(name(n + 1), with_products(moved))
        tables.drop(name(n))
        n += 1
    out = state.select(*kept)
    for part in done:
        out = out.unionByName(part)
    return out


def solve_large(k: DataFrame, f: DataFrame, policy: CgPolicy = CgPolicy(relative=1e-10, most=500), precondition=None, direct: bool = False) -> tuple[DataFrame, dict]:
    """(node_id, u) of one system K(row, col, v), f(row, v), and a report of it."""
    out = conjugate_gradients(k, f.select(F.lit(0).cast("long").alias("case_id"), "row", "v"), policy, precondition=precondition, direct=direct)
    report = out.agg(F.max("iterations").alias("iterations"), F.max("backward_error").alias("backward_error"), F.min("converged").alias("converged")).first()
    return out.select("node_id", "u"), report.asDict()


def solved(k: DataFrame, f: DataFrame, policy: CgPolicy = CgPolicy(relative=1e-12, most=2000)) -> DataFrame:
    """(node_id, u) of one system by substructures, corrected by the iteration; NaN where it isn't admitted."""
    return solve_large(k, f, policy, direct=True)[0]


def iterated(k: DataFrame, f: DataFrame, policy: CgPolicy = CgPolicy(relative=1e-12, most=50)) -> DataFrame:
    """(node_id, u) of one system by conjugate gradients that substructures precondition; NaN where it isn't admitted."""
    return solve_large(k, f, policy, exact(Tables(k.sparkSession, "exact"), k))[0]
