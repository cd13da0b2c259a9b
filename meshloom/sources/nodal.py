"""Nodal results of a finite-element solver's ASCII output, and its logs, as checked tables.

A result declares scalar fields ("Name : size permutation-size dofs : equation"), then one time record, then a section a
field: a permutation (node and internal dof, both from 1, or "use previous") and the values in the order of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.operators.mesh import ContractError
from meshloom.operators.tables import Tables
from meshloom.sources.msh import lines_of, real, whole

FIELD = r"^([^:]+?)\s*:\s*(\d+)\s+(\d+)\s+(\d+)\s*:\s*(.+)$"


def declared(lines: DataFrame) -> list:
    """(name, size, nodes, dofs, line_no) of the declared fields, in order; names fold case and are unique."""
    rows = lines.select("line_no", F.lower(F.trim(F.regexp_extract("value", FIELD, 1))).alias("name"), *[F.regexp_extract("value", FIELD, i).alias(n) for i, n in ((2, "size"), (3, "nodes"), (4, "dofs"))]).where("name <> ''").orderBy("line_no").limit(1000).collect()
    if len({r["name"] for r in rows}) != len(rows) or not rows:
        raise ContractError("fields are missing or declared twice")
    return rows


def sections(lines: DataFrame, fields: list, nodes: int) -> DataFrame:
    """(field, line_no, k, value): lines of each field's section, numbered below its name."""
    names = {r["name"]: i for i, r in enumerate(fields)}
    times = [r.line_no for r in lines.where("value RLIKE '^Time:'").orderBy("line_no").limit(2).collect()]
    if len(times) != 1:
        raise ContractError("a result has one time record")
    heads = lines.where(F.col("line_no") > times[0]).where(F.lower("value").isin(*names)).orderBy("line_no").limit(len(names) + 1).collect()
    if [r.value.lower() for r in heads] != [r["name"] for r in fields]:
        raise ContractError("the sections aren't the declared fields, in their order")
    starts = F.array(*[F.lit(r.line_no) for r in heads])
    number = F.aggregate(starts, F.lit(-1), lambda a, s: a + F.when(s <= F.col("line_no"), 1).otherwise(0))
    rows = lines.where(F.col("line_no") > times[0]).withColumn("field", number).where("field >= 0")
    return rows.withColumn("k", F.col("line_no") - F.element_at(starts, F.col("field") + 1)).where("k > 0")


def read_fields(spark: SparkSession, path: str, nodes: int, expected: dict[str, DataFrame | None]) -> DataFrame:
    """(name, node_id, value) of all fields of a result; expected maps a name to its node ids(node_id), None for all nodes.

    The declarations, the node count, the bijection of every permutation and the nodes it names are checked.
    """
    lines = Tables(spark, "result").write("lines", lines_of(spark, path))
    fields = declared(lines)
    wanted = {k.lower(): v for k, v in expected.items()}
    if {r["name"] for r in fields} != set(wanted):
        raise ContractError("the declared fields aren't the expected ones")
    header = lines.where("value RLIKE '^Number Of Nodes:'").select(F.regexp_extract("value", r":\s*(\d+)", 1).cast("long").alias("n")).limit(2).collect()
    totals = lines.where("value RLIKE '^Total DOFs:'").select(F.regexp_extract("value", r":\s*(\d+)", 1).cast("long").alias("n")).limit(2).collect()
    if [r.n for r in header] != [nodes] or [r.n for r in totals] != [len(fields)]:
        raise ContractError("the numbers of nodes or dofs are wrong")
    rows = sections(lines, fields, nodes)
    out, previous = None, None
    for i, r in enumerate(fields):
        size = int(r["size"])
        if int(r["nodes"]) != nodes or int(r["dofs"]) != 1:
            raise ContractError(f"{r['name']}: declared for another mesh, or no scalar")
        part = rows.where(F.col("field") == i)
        perm = part.where("k = 1").first()
        if perm is None or not perm.value.startswith("Perm:"):
            raise ContractError(f"{r['name']}: no permutation")
        if perm.value.lower().endswith("use previous"):
            if previous is None or previous[1] != size:
                raise ContractError(f"{r['name']}: no previous permutation of its size")
            order, begin = previous[0], 2
        else:
            if perm.value.split()[1:] != [str(nodes), str(size)]:
                raise ContractError(f"{r['name']}: the permutation is of another size")
            pairs = part.where(F.col("k").between(2, size + 1)).select("k", F.split("value", r"\s+").alias("p")).select("k", (whole(F.col("p")[0]) - 1).alias("node_id"), whole(F.col("p")[1]).alias("dof"), F.size("p").alias("width"))
            found = pairs.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("a"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"), F.countDistinct("dof").alias("b"), F.min("dof").alias("least"), F.max("dof").alias("most"), F.max("width").alias("w")).first()
            if not found.n == found.a == found.b == size or found.least != 1 or found.most != size or found.lo < 0 or found.hi >= nodes or found.w != 2:
                raise ContractError(f"{r['name']}: the permutation is no bijection")
            order, begin = pairs.select("node_id"), size + 2
            previous = (order, size)
        if wanted[r["name"]] is not None:
            ids = wanted[r["name"]].select("node_id")
            if ids.exceptAll(order).limit(1).count() or order.exceptAll(ids).limit(1).count():
                raise ContractError(f"{r['name']}: other nodes than expected")
        elif size != nodes:
            raise ContractError(f"{r['name']}: not on all nodes")
        # values follow the nodes in rising order, whatever the internal dofs
        ranked = order.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(i)).orderBy("node_id")) - 1) if size != nodes else order.withColumn("i", F.col("node_id"))
        values = part.where(F.col("k").between(begin, begin + size - 1)).select((F.col("k") - begin).alias("i"), real(F.col("value")).alias("value"))
        if part.count() != begin - 1 + size:
            raise ContractError(f"{r['name']}: the number of values is wrong")
        rows_of = ranked.join(values, "i").select(F.lit(r["name"]).alias("name"), "node_id", "value")
        out = rows_of if out is None else out.unionByName(rows_of)
    return out


def read_scalars(spark: SparkSession, path: str, nodes: int, names: list[str]) -> DataFrame:
    """(name, node_id, value) of fields on all nodes."""
    return read_fields(spark, path, nodes, {n: None for n in names})


def read_scalar(spark: SparkSession, path: str, nodes: int, name: str) -> DataFrame:
    """(node_id, value) of the one field of a result."""
    return read_scalars(spark, path, nodes, [name]).select("node_id", "value")


def read_temperature(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    return read_scalar(spark, path, nodes, "temperature")


def read_potential(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    return read_scalar(spark, path, nodes, "potential")


def result_lines(fields: dict[str, DataFrame], nodes: int) -> DataFrame:
    """(part, line_no, value) of a result's text with fields(node_id, value)."""
    spark = next(iter(fields.values())).sparkSession
    sizes = {n: f.count() for n, f in fields.items()}
    head = ["ASCII 3", "Degrees of freedom:", *(f"{n} : {s} {nodes} 1 : {n} equation" for n, s in sizes.items()), f"Total DOFs: {len(fields)}", f"Number Of Nodes: {nodes}", "Time: 1 1 0.0"]
    head = ["ASCII 3", "!written by meshloom", *head[1:]]
    parts = [spark.createDataFrame([(0, i, v) for i, v in enumerate(head)], "part int, line_no long, value string")]
    for k, (name, f) in enumerate(fields.items()):
        parts.append(spark.createDataFrame([(3 * k + 1, 0, name), (3 * k + 1, 1, f"Perm: {nodes} {sizes[name]}")], "part int, line_no long, value string"))
        ranked = f.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy("node_id")))
        parts.append(ranked.select(F.lit(3 * k + 2).alias("part"), F.col("node_id").alias("line_no"), F.concat_ws(" ", F.col("node_id") + 1, sizes[name] + 1 - F.col("i")).alias("value")))
        parts.append(f.select(F.lit(3 * k + 3).alias("part"), F.col("node_id").alias("line_no"), F.col("value").cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- fields of ports --------------------------------------------------------------------------------------------------


def agreed(records: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row a key of repeated records, which must be identical."""
    spread = [F.when(F.min(n) == F.max(n), F.min(n)).otherwise(F.raise_error(F.lit("repeated records differ")).cast("double")).alias(n) for n in names]
    return records.groupBy(*keys).agg(*spread)


#: The components of a projected field in a result, real parts first.
COMPONENTS = tuple(f"ef2d {part} {axis}" for part in ("re", "im") for axis in (1, 2, 3))


def port_field(records: DataFrame, nodes: int) -> DataFrame:
    """(node_id, ex_re, ey_re, ez_re, ex_im, ey_im, ez_im) of records(record, component, node_id, value): each save holds
    every component of every node, and all saves agree."""
    names = [f"e{a}_{p}" for p in ("re", "im") for a in "xyz"]
    wide = records.groupBy("record", "node_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.lower("component") == c, F.col("value"))).alias(n) for c, n in zip(COMPONENTS, names)])
    out = agreed(wide, ["node_id"], names)
    found = wide.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.countDistinct("node_id").alias("d"), F.count("*").alias("rows"), F.countDistinct("record").alias("saves")).first()
    if found.a != 6 or found.b != 6 or found.d != nodes or found.rows != nodes * found.saves:
        raise ContractError("a save lacks components or nodes")
    return out


def port_vectors(records: DataFrame, nodes: int, edges: int, modes: int) -> DataFrame:
    """(mode, dof, re, im) of raw mixed eigenvectors(record, mode, dof, re, im): nodes first, then edges; a final record of
    zeros is dropped, the others must agree."""
    sizes = records.groupBy("record").agg(F.max(F.abs("re") + F.abs("im")).alias("top"))
    last = records.agg(F.max("record").alias("last"))
    kept = records.join(sizes, "record").crossJoin(F.broadcast(last)).where("NOT (record = last AND top = 0)")
    out = agreed(kept, ["mode", "dof"], ["re", "im"])
    found = out.agg(F.count("*").alias("n"), F.min("dof").alias("lo"), F.max("dof").alias("hi"), F.countDistinct("mode").alias("m")).first()
    if (found.n, found.lo, found.hi, found.m) != (modes * (nodes + edges), 0, nodes + edges - 1, modes):
        raise ContractError("modes or dofs are missing")
    return out


# --- logs -------------------------------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """A finite number, whose exponent may be written D."""
    return real(F.regexp_replace(F.upper(c), "D", "E"))


def only(lines: DataFrame, pattern: str, label: str, groups: int = 1) -> list[float]:
    """The values of the one line that matches."""
    hits = lines.where(F.col("value").rlike(pattern)).select(*[number(F.regexp_extract("value", pattern, i + 1)).alias(f"g{i}") for i in range(groups)]).limit(2).collect()
    if len(hits) != 1:
        raise ContractError(f"a log has one {label}")
    return list(hits[0])


def port_log(lines: DataFrame, selected: int) -> tuple[DataFrame, dict]:
    """(mode, re, im, residual) of the spectrum of lines(line_no, value), and tolerance, iterations, converged modes,
    propagation constant, power and impedance of the selected mode, each told once and consistent."""
    value = r"^EigenSolveComplex:\s+(\d+)\s+\(\s*([^,\s]+)\s*,\s*([^)\s]+)\s*\)\s*$"
    rest = r"^CheckResidualsComplex:\s+L\^2 Norm of the residual:\s+(\d+)\s+(\S+)\s*$"
    spectrum = lines.where(F.col("value").rlike(value)).select((F.regexp_extract("value", value, 1).cast("int") - 1).alias("mode"), number(F.regexp_extract("value", value, 2)).alias("re"), number(F.regexp_extract("value", value, 3)).alias("im"))
    residuals = lines.where(F.col("value").rlike(rest)).select((F.regexp_extract("value", rest, 1).cast("int") - 1).alias("mode"), number(F.regexp_extract("value", rest, 2)).alias("residual"))
    both = spectrum.join(residuals, "mode", "full")
    found = both.agg(F.count("*").alias("n"), F.countDistinct("mode").alias("d"), F.min("mode").alias("lo"), F.max("mode").alias("hi"), F.count("re").alias("v"), F.count("residual").alias("r"), F.min("residual").alias("least")).first()
    if not found.n or not found.n == found.d == found.v == found.r or (found.lo, found.hi) != (0, found.n - 1) or found.least < 0 or not 0 <= selected < found.n:
        raise ContractError("the spectrum and its residuals aren't complete")
    told = {
        "tolerance": only(lines, r"EigenSolveComplex:\s+Convergence criterion is:\s+(\S+)", "tolerance")[0],
        "iterations": only(lines, r"EigenSolveComplex:\s+Number of eigensystem iterations is:\s+(\d+)", "iteration count")[0],
        "converged": only(lines, r"EigenSolveComplex:\s+Number of converged Ritz values is:\s+(\d+)", "count of converged values")[0],
        "power": only(lines, r"res:\s+port power 1\s+(\S+)", "power")[0],
        "impedance": only(lines, r"res:\s+port impedance 1\s+(\S+)", "impedance")[0],
    }
    re, im = only(lines, r"EMPortSolver:\s+Propagation constant beta:\s+(\S+)\s+(\S+)", "propagation constant", 2)
    row = both.where(F.col("mode") == selected).first()
    beta = complex(-row.re, -row.im) ** 0.5
    if abs(beta - complex(re, im)) > 1e-6 * max(1.0, abs(beta)) or told["tolerance"] <= 0 or told["power"] <= 0 or told["impedance"] <= 0 or told["converged"] > found.n:
        raise ContractError("the log contradicts itself")
    return both, told | {"beta_re": re, "beta_im": im}


IDENTITY = r"(?i)version:?\s*([0-9][^\s,()]*)\s*\(?\s*rev(?:ision)?:?\s*([^\s,)]+)"


def identity(lines: DataFrame) -> DataFrame:
    """One row (version, revision): the first that a solver's output tells, or an error."""
    hits = lines.where(F.col("value").rlike(IDENTITY)).select("line_no", F.regexp_extract("value", IDENTITY, 1).alias("version"), F.regexp_extract("value", IDENTITY, 2).alias("revision"))
    out = hits.orderBy("line_no").limit(1)
    if out.isEmpty():
        raise ContractError("the output tells no version")
    return out.select("version", "revision")
