"""Registered queries of readers and writers: tables are written as the text or files in question, read back, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import mesh, specs
from meshloom.operators.tables import Tables
from meshloom.plans.registry import query, r9, sized, sized_square_sql, square_sql, table
from meshloom.sources import bundles, decks, materials, msh, nodal


def folder(spark, name: str) -> str:
    return Tables(spark, name).root


# --- meshes -----------------------------------------------------------------------------------------------------------


@query(f"WITH {sized_square_sql()} SELECT cell_id, n0, n1, n2, round(x0, 9) AS x0, round(y0, 9) AS y0 FROM raw")
def msh_cells(spark, sf):
    """A mesh that grows with the parts, written as MSH text and read back: cells with their first corner."""
    path = msh.write_lines(msh.msh_lines(mesh.unit_square(spark, sized(spark, sf))), folder(spark, "msh-text"))
    out = msh.read_msh(spark, path)
    g = mesh.gathered(out.cells, out.nodes)
    return g.select("cell_id", "n0", "n1", "n2", F.round("x0", 9).alias("x0"), F.round("y0", 9).alias("y0"))


@query("SELECT unnest(['bottom', 'domain', 'left', 'right', 'top']) AS name, unnest([6, 72, 6, 6, 6]) AS entities")
def msh_groups(spark, sf):
    """Named groups of a mesh file and how many cells or facets each has."""
    out = msh.read_msh(spark, msh.write_lines(msh.msh_lines(mesh.unit_square(spark, 6)), folder(spark, "msh-text")))
    return out.tags.groupBy("name").agg(F.count("*").cast("int").alias("entities"))


@query("SELECT 48 AS cells, 27 AS nodes, 1.0 AS volume")
def msh_volume(spark, sf):
    """A volume mesh through its text."""
    m = mesh.tet_box(spark, 2, 2, 2)
    rim = mesh.boundary_facets(m).select((F.col("cell_id") * 4 + F.col("local")).alias("old"), "nodes")
    facets = mesh.numbered(rim, ["old"], "facet_id").select("facet_id", "nodes")
    tags = facets.select(F.lit("skin").alias("name"), F.lit(2).alias("dim"), F.col("facet_id").alias("entity_id")).unionByName(m.cells.select(F.lit("block").alias("name"), F.lit(3).alias("dim"), F.col("cell_id").alias("entity_id")))
    out = msh.read_msh(spark, msh.write_lines(msh.msh_lines(mesh.Mesh(m.nodes, m.cells, facets, tags), 3), folder(spark, "msh-text")), dimension=3)
    g = mesh.geometry(out).agg(F.count("*").cast("int").alias("cells"), F.round(F.sum("volume"), 9).alias("volume"))
    return g.crossJoin(out.nodes.agg(F.count("*").cast("int").alias("nodes"))).select("cells", "nodes", "volume")


# --- nodal results ----------------------------------------------------------------------------------------------------


@query("""SELECT 'temperature' AS name, c_custkey AS node_id, c_acctbal AS value FROM customer
UNION ALL SELECT 'potential', c_custkey, c_nationkey / 8e0 FROM customer WHERE c_custkey % 3 = 1""")
def nodal_result(spark, sf):
    """A result file with a field on all nodes and one on a third of them: permutations checked, values in node order."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"), "c_custkey", "c_acctbal", "c_nationkey")
    fields = {"Temperature": c.select("node_id", F.col("c_acctbal").alias("value")), "Potential": c.where("c_custkey % 3 = 1").select("node_id", (F.col("c_nationkey") / 8.0).alias("value"))}
    path = msh.write_lines(nodal.result_lines(fields, c.count()), folder(spark, "result-text"))
    return nodal.read_fields(spark, path, c.count(), {"temperature": None, "potential": fields["Potential"]})


@query("SELECT s_suppkey AS node_id, s_acctbal AS value FROM supplier")
def temperature_result(spark, sf):
    """The one temperature field of a result."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("value"))
    return nodal.read_temperature(spark, msh.write_lines(nodal.result_lines({"Temperature": s}, s.count()), folder(spark, "result-text")), s.count())


@query("SELECT s_suppkey AS node_id, -s_acctbal AS value FROM supplier")
def potential_result(spark, sf):
    """The one potential field of a result."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node_id"), (-F.col("s_acctbal")).alias("value"))
    return nodal.read_potential(spark, msh.write_lines(nodal.result_lines({"Potential": s}, s.count()), folder(spark, "result-text")), s.count())


@query("SELECT c_custkey AS node_id, c_acctbal AS ex_re, c_acctbal + 1 AS ey_re, c_acctbal + 2 AS ez_re, c_acctbal + 3 AS ex_im, c_acctbal + 4 AS ey_im, c_acctbal + 5 AS ez_im FROM customer")
def port_field_result(spark, sf):
    """Six components of every node, saved three times, each time the same."""
    c = table(spark, sf, "customer")
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.lit(float(i)).alias("add")) for i, n in enumerate(nodal.COMPONENTS)]))
    records = c.select(F.explode(F.array(*map(F.lit, range(3)))).alias("record"), F.col("c_custkey").alias("node_id"), "c_acctbal").select("*", names.alias("c"))
    return nodal.port_field(records.select("record", "c.component", "node_id", (F.col("c_acctbal") + F.col("c.add")).alias("value")), c.count())


@query("SELECT m AS mode, r.id AS dof, round(sin(r.id + m), 9) AS re, round(cos(r.id + m), 9) AS im FROM range(30) r(id), (SELECT unnest([0, 1]) AS m)")
def port_vector_result(spark, sf):
    """Two mixed eigenvectors of 12 nodes and 18 edges, saved twice, then a save of zeros."""
    base = spark.range(30).withColumnRenamed("id", "dof").crossJoin(spark.createDataFrame([(0,), (1,)], "mode int"))
    full = base.select("mode", "dof", F.round(F.sin(F.col("dof") + F.col("mode")), 9).alias("re"), F.round(F.cos(F.col("dof") + F.col("mode")), 9).alias("im"))
    saves = full.withColumn("record", F.explode(F.array(F.lit(0), F.lit(1)))).unionByName(base.select("mode", "dof", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(2).alias("record")))
    return nodal.port_vectors(saves, 12, 18, 2)


def port_log_lines(spark):
    text = ["EigenSolveComplex: Convergence criterion is: 1.0E-12", "EigenSolveComplex: Number of eigensystem iterations is: 7", "EigenSolveComplex: Number of converged Ritz values is: 3"]
    text += [f"EigenSolveComplex: {i + 1} ( {v} , 0.0D+00 )" for i, v in enumerate(("-4.0D+00", "-1.0E+00", "2.25D+00"))]
    text += [f"CheckResidualsComplex: L^2 Norm of the residual: {i + 1} {1 + i}.5E-13" for i in range(3)]
    text += ["EMPortSolver: Propagation constant beta: 2.0 0.0", "SaveScalars: 2: res: port power 1 0.5", "SaveScalars: 3: res: port impedance 1 377.0"]
    return spark.createDataFrame(list(enumerate(text)), "line_no long, value string")


@query("SELECT unnest([0, 1, 2]) AS mode, unnest([-4.0, -1.0, 2.25]) AS re, 0.0 AS im, unnest([1.5e-13, 2.5e-13, 3.5e-13]) AS residual, 7.0 AS iterations, 2.0 AS beta, 0.5 AS power")
def port_log(spark, sf):
    """Spectrum, residuals and the selected mode of a log whose numbers write exponents with D or E."""
    rows, told = nodal.port_log(port_log_lines(spark), 0)
    return rows.select("mode", "re", "im", "residual", F.lit(told["iterations"]).alias("iterations"), F.lit(told["beta_re"]).alias("beta"), F.lit(told["power"]).alias("power"))


@query("SELECT '9.0' AS version, 'abc123' AS revision")
def solver_identity(spark, sf):
    """Version and revision that a solver's output tells."""
    return nodal.identity(spark.createDataFrame([(0, "MAIN: starting"), (1, "MAIN: Version: 9.0 (Rev: abc123, Compiled: today)"), (2, "MAIN: done")], "line_no long, value string"))


# --- materials --------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 148.0 ELSE 1.38 END, 9) AS k,
round(sqrt(1 + 0.6961663 * l * l / (l * l - 0.0684043 ** 2) + 0.4079426 * l * l / (l * l - 0.1162414 ** 2) + 0.8974794 * l * l / (l * l - 9.896161 ** 2)), 9) AS n FROM (SELECT *, 0.3 + p_size / 20.0 AS l FROM part)""")
def catalog_lookup(spark, sf):
    """Conductivities by alias and an index by dispersion from the built-in catalog, a row a part."""
    names, properties = materials.builtin_catalog(spark)
    parts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, " SI ").otherwise("SiO2").alias("name"), F.lit("thermal_conductivity").alias("property"), F.lit(300.0).alias("temperature_k"), F.lit(None).cast("double").alias("wavelength_m"), "p_size")
    k = materials.evaluated(parts, names, properties).select("p_partkey", F.round("value", 9).alias("k"))
    glass = parts.withColumns({"name": F.lit("Fused Silica"), "property": F.lit("refractive_index"), "temperature_k": F.lit(293.15), "wavelength_m": (0.3 + F.col("p_size") / 20.0) * 1e-6})
    n = materials.evaluated(glass, names, properties).select("p_partkey", F.round("value", 9).alias("n"))
    return k.join(n, "p_partkey").select("p_partkey", "k", "n")


TABLE = '{"id": "own", "version": "1", "sources": [{"id": "s", "text": "t"}], "materials": [{"id": "alloy", "aliases": ["A-1"], "properties": [{"id": "heat_capacity", "unit": "J/(kg K)", "model": "table", "at_k": [0, 10, 30, 50], "values": [1, 2, 8, 8.5], "sources": ["s"]}]}]}'


@query("SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 1 + p_size / 10.0 WHEN p_size <= 30 THEN 2 + 6 * (p_size - 10) / 20.0 ELSE 8 + 0.5 * (p_size - 30) / 20.0 END, 9) AS value FROM part")
def catalog_file(spark, sf):
    """A catalog file with a table model, read strictly; linear within the table, its right end included."""
    path = folder(spark, "catalog")
    spark.createDataFrame([(TABLE,)], "value string").coalesce(1).write.text(path)
    names, properties = materials.load_catalog(spark, path)
    wanted = table(spark, sf, "part").select("p_partkey", F.lit("a-1").alias("name"), F.lit("heat_capacity").alias("property"), F.col("p_size").cast("double").alias("temperature_k"), F.lit(None).cast("double").alias("wavelength_m"))
    return materials.evaluated(wanted, names, properties).select("p_partkey", F.round("value", 9).alias("value"))


@query("SELECT 'Steel' AS material, 'Density' AS parameter, '7800' AS raw, 7800.0 AS value UNION ALL SELECT 'Steel', 'Law', 'MATC \"tx + 1\"', -1.0 UNION ALL SELECT 'Gold', 'Density', '19300.0', 19300.0")
def legacy_library(spark, sf):
    """A legacy XML library: plain numbers become values, formulas stay text (-1 stands for no value)."""
    text = '<materiallibrary><material name="Steel"><parameter name="Density">7800</parameter><parameter name="Law">MATC "tx + 1"</parameter></material><material name="Gold"><parameter name="Density">19300.0</parameter></material><material name="Air"><parameter name="Density">1.2</parameter></material></materiallibrary>'
    path = folder(spark, "xml")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return materials.legacy_materials(spark, path, ["Steel", "Gold"]).withColumn("value", F.coalesce("value", F.lit(-1.0)))


# --- bundles, digests, decks ------------------------------------------------------------------------------------------


def event_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.element_at(F.array(*map(F.lit, ("Ex", "Ey", "Ez", "Hx", "Hy", "Hz"))), (F.col("event_id") % 6 + 1).cast("int")).alias("component"), F.col("event_id").alias("i"), (F.col("event_id") % 7).alias("j"), F.lit(0).cast("long").alias("k"), F.col("value").alias("re"), (-F.col("value") / 3).alias("im"))


@query("SELECT ['Ex', 'Ey', 'Ez', 'Hx', 'Hy', 'Hz'][event_id % 6 + 1] AS component, event_id AS i, event_id % 7 AS j, round(value, 9) AS re, round(-value / 3, 9) AS im FROM events")
def mode_bundle(spark, sf):
    """Fields written as a bundle and read back through their digests."""
    path = folder(spark, "bundle")
    bundles.write_bundle(event_fields(spark, sf), path, {"mode": 0})
    out, _ = bundles.read_bundle(spark, path)
    return out.select("component", "i", "j", F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


@query("SELECT true AS ok, true AS small FROM events LIMIT 1")
def single_precision(spark, sf):
    """Errors of the fields in single precision, within their bound."""
    _, report = bundles.lowered(event_fields(spark, sf))
    return report.select("ok", ((F.col("worst") < 1e-7) & (F.col("norm_error") > 0)).alias("small"))


@query("SELECT c_custkey, sha256(c_name) AS sha256, octet_length(encode(c_name)) AS size FROM customer WHERE c_custkey <= 12")
def file_digests(spark, sf):
    """SHA-256 of files: twelve customers' names, a file each."""
    path = folder(spark, "files")
    some = table(spark, sf, "customer").where("c_custkey <= 12").select("c_custkey", "c_name")
    some.write.option("lineSep", "~").partitionBy("c_custkey").format("text").save(path)
    found = bundles.file_digests(spark, path).where("path LIKE '%c_custkey=%' AND path LIKE '%.txt'")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path LIKE '%.txt'")
    read = read.select("path", F.expr("rtrim('~', cast(content AS string))").alias("text"))
    key = F.regexp_extract("path", r"c_custkey=(\d+)", 1).cast("long").alias("c_custkey")
    whole = found.join(read, "path").select(key, F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    return whole


@query(f"WITH {square_sql(3)} SELECT cell_id AS line_no, (cell_id + 1) || ' ' || CASE WHEN cell_id % 2 = 0 THEN 1 ELSE 2 END || ' 303 ' || (n0 + 1) || ' ' || (n1 + 1) || ' ' || (n2 + 1) AS value FROM cells")
def tagged_deck(spark, sf):
    """Element lines of a deck with two tagged bodies."""
    m = mesh.unit_square(spark, 3)
    tags = m.tags.where("dim = 1").unionByName(m.cells.select(F.when(F.col("cell_id") % 2 == 0, "even").otherwise("odd").alias("name"), F.lit(2).alias("dim"), F.col("cell_id").alias("entity_id")))
    return decks.tagged_deck(mesh.Mesh(m.nodes, m.cells, m.facets, tags), ["even", "odd"], ["bottom", "right", "top", "left"])["elements"].select("line_no", "value")


@query("SELECT r.id AS cell_id, CASE WHEN r.id % 2 = 0 THEN CASE WHEN r.id < 9 THEN 1 ELSE 2 END ELSE CASE WHEN r.id < 9 THEN 3 ELSE 4 END END AS body FROM range(18) r(id)")
def joint_bodies(spark, sf):
    """One body for each pair of regions that two partitions of the cells make."""
    cells = spark.range(18).withColumnRenamed("id", "cell_id")
    one = cells.withColumn("region", F.when(F.col("cell_id") % 2 == 0, "a").otherwise("b"))
    other = cells.withColumn("region", F.when(F.col("cell_id") < 9, "c").otherwise("d"))
    return decks.joint_bodies(one, other).select("cell_id", "body")


@query("SELECT unnest(['heat', 'current', 'coupled', 'port', 'tetra', 'waveguide', 'ring']) AS deck, true AS complete, true AS numbers")
def rendered_decks(spark, sf):
    """Every deck and recipe: blocks are closed, and all numbers given are in it."""
    made = {
        "heat": (decks.heat_deck([(2.5, 3.5)], [(1, 300.5)], [(2, 4.5)], "/lib/HeatSolve"), (2.5, 3.5, 300.5, 4.5)),
        "current": (decks.current_deck([2e3], [(1, 0.25)], [(3, 1.5)], "/lib/StatCurrentSolve"), (2e3, 0.25, 1.5)),
        "coupled": (decks.coupled_deck([{"sigma": 2e3, "k": 120.0, "alpha": 3e-3, "t_ref": 301.0}, {"sigma": 2e5, "k": 130.0}], [(1, 0.25)], [(1, 300.5)], "/lib/A", "/lib/B"), (2e3, 2e5, 120.0, 130.0, 3e-3, 301.0, 0.25, 300.5)),
        "port": (decks.port_deck([(12.25, 1.125)], [1, 2], 1e14, 4, 1, "/lib/EMPortSolver"), (12.25, 1.125, 6.283185307179586e14)),
        "tetra": (decks.tetra_deck([(2.5, 4.5), (None, 1.38)], [(1, 0.75)], [(2, 300.5)], [(3, 6.5, 301.5)], "/lib/A", "/lib/B"), (2.5, 4.5, 1.38, 0.75, 300.5, 6.5, 301.5)),
        "waveguide": (decks.waveguide_recipe(), (0.4, 0.08, 2.0, 0.25)),
        "ring": (decks.ring_recipe("medium"), (0.14, 0.64)),
    }
    rows = []
    for name, (text, numbers) in made.items():
        lines = text.split("\\n")
        opened = sum(bool(x) and x[0] not in " E" and "=" not in x and not x.endswith(";") for x in lines)
        complete = opened == lines.count("End") if "Header" in text else text.count("{") == text.count("}")
        rows.append((name, complete, all(decks.real(v) in text for v in numbers)))
    return spark.createDataFrame(rows, "deck string, complete boolean, numbers boolean")


# --- problems ---------------------------------------------------------------------------------------------------------


@query(f"WITH {square_sql(6)} SELECT node_id, round(300 + 10 * x + 2 * x * (1 - x), 9) AS u FROM nodes")
def heat_backend(spark, sf):
    """A typed heat problem with a parameter, solved by the Spark backend."""
    from meshloom.operators.contracts import Parameter, Reference

    problem = specs.SteadyHeat({"domain": {"k": Reference("k"), "q": 8.0}}, {"left": 300.0, "right": 310.0})
    m = mesh.unit_square(spark, 6)
    return specs.SparkHeat().solve(problem, m, {"k": Parameter("k", "W/(m K)", 2.0, "design")}).select("node_id", r9(F.col("u")).alias("u"))


@query("SELECT 0.75 AS power, true AS balanced, true AS solved")
def current_backend(spark, sf):
    """A typed current problem: Joule power, its balance with the power given, and the backward error."""
    problem = specs.SteadyCurrent({"domain": {"sigma": 3.0}}, {"left": 0.0, "right": 0.5})
    out = specs.SparkCurrent().report(problem, mesh.unit_square(spark, 6), {})
    return out.select(r9(F.col("power")).alias("power"), (F.col("imbalance") < 1e-10).alias("balanced"), (F.col("backward_error") < 1e-10).alias("solved"))


@query("SELECT 0.000556 AS relative_error, 2 AS modes")
def port_backend(spark, sf):
    """A typed port problem on a guide of 6 intervals: error of its first propagation constant."""
    from meshloom.plans.ports import EXACT, HZ, guide

    problem = specs.PortEigenmode({"domain": {"eps_r": 1.0, "mu_r": 1.0}}, ["bottom", "right", "top", "left"], HZ, 2)
    out = specs.SparkPort().solve(problem, guide(spark, 6), {})
    return out.agg(F.round(F.abs(F.max("beta_re") / EXACT - 1), 6).alias("relative_error"), F.count("*").cast("int").alias("modes"))


@query("SELECT o_orderkey, epoch(CAST(o_orderdate AS TIMESTAMP)) - 7200 AS seconds FROM orders")
def zoned_instants(spark, sf):
    """ISO-8601 times with a zone, as instants."""
    o = table(spark, sf, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return o.select("o_orderkey", F.unix_timestamp(bundles.iso_instant(text)).cast("double").alias("seconds"))
