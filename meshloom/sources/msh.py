"""Reader of ASCII MSH 4.1 text: numbered lines become node, cell, facet and tag tables by joins and windows.

Lines are numbered without one task seeing all: each block of the file numbers its own, and the blocks' counts (one row
each) give the offsets. Only section marks and block headers, a few rows each, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshloom.functions import elements as el
from meshloom.operators.mesh import ContractError, Mesh, gathered, numbered
from meshloom.operators.tables import Tables

#: Element types that are read, with their dimension and corners.
TYPES = {1: (1, 2), 2: (2, 3), 4: (3, 4)}
SECTIONS = ("MeshFormat", "PhysicalNames", "Entities", "Nodes", "Elements")
#: Blocks of nodes or elements (one an entity) that are read at most.
BLOCKS = 100_000


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines of one file that aren't blank, trimmed, numbered 0, 1, .. in order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("value"))
    raw = Tables(spark, "lines").write("raw", raw.where("value <> ''"))
    sizes = raw.groupBy("block").agg(F.count("*").alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    own = raw.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1)
    return own.join(F.broadcast(before), "block").select((F.col("before") + F.col("k")).cast("long").alias("line_no"), "value")


def marks(lines: DataFrame) -> dict[str, tuple[int, int]]:
    """First and last line (inclusive) of each section; missing, repeated, nested, unknown or unclosed ones fail."""
    rows = lines.where("value LIKE '$%'").orderBy("line_no").limit(2 * len(SECTIONS) + 1).collect()
    found: dict[str, tuple[int, int]] = {}
    for begin, end in zip(rows[::2], rows[1::2]):
        name = begin.value[1:]
        if name not in SECTIONS or name in found or end.value != f"$End{name}":
            raise ContractError(f"section {name} is nested, repeated, unknown or not closed")
        found[name] = (begin.line_no + 1, end.line_no - 1)
    if len(rows) % 2 or set(found) != set(SECTIONS):
        raise ContractError("sections are missing or not closed")
    inside = sum(b - a + 1 for a, b in found.values())
    if lines.count() != inside + 2 * len(SECTIONS):
        raise ContractError("text outside of sections")
    return found


def within(lines: DataFrame, span: tuple[int, int]) -> DataFrame:
    """(k, p): lines of a section numbered from 0, split at white space."""
    return lines.where(F.col("line_no").between(*span)).select((F.col("line_no") - span[0]).alias("k"), "value", F.split("value", r"\s+").alias("p"))


def whole(p: Column) -> Column:
    """An exact integer, or an error."""
    return F.when(p.rlike(r"^[+-]?\d+$"), p.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no integer: "), p)).cast("long"))


def real(p: Column) -> Column:
    """A finite number, or an error."""
    v = p.cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(ok, v).otherwise(F.raise_error(F.concat(F.lit("no finite number: "), p)).cast("double"))


def physical_names(section: DataFrame) -> DataFrame:
    """(dim, tag, name), unique both ways."""
    rows = section.where("k > 0").select(whole(F.col("p")[0]).cast("int").alias("dim"), whole(F.col("p")[1]).alias("tag"), F.regexp_extract("value", r'"(.*)"', 1).alias("name"))
    told = section.where("k = 0").select(whole(F.col("p")[0]).alias("n")).first()
    found = rows.agg(F.count("*").alias("n"), F.countDistinct("dim", "tag").alias("keys"), F.countDistinct("name").alias("names"), F.min(F.length("name")).alias("short")).first()
    if told is None or not found.n == found.keys == found.names == told.n or not found.short:
        raise ContractError("physical names must be unique, named and as many as told")
    return rows


def entity_groups(section: DataFrame, names: DataFrame) -> DataFrame:
    """(dim, entity, name) of each entity's named groups; a tag's sign is its orientation and goes."""
    sizes = section.where("k = 0").first()
    counts = [int(x) for x in sizes.p]
    ends = [sum(counts[: i + 1]) for i in range(len(counts))]
    if len(counts) != 4 or section.count() != 1 + ends[-1]:
        raise ContractError("the number of entities is wrong")
    dim = F.lit(3)
    for d in (2, 1, 0):
        dim = F.when(F.col("k") <= ends[d], F.lit(d)).otherwise(dim)
    rows = section.where("k > 0").select(dim.alias("dim"), "p").withColumn("skip", F.when(F.col("dim") == 0, 4).otherwise(7))
    tags = F.transform(F.slice("p", F.col("skip") + 2, whole(F.element_at("p", F.col("skip") + 1)).cast("int")), lambda t: F.abs(whole(t)))
    return rows.select("dim", whole(F.col("p")[0]).alias("entity"), F.explode(tags).alias("tag")).join(names, ["dim", "tag"]).select("dim", "entity", "name")


def with_block(section: DataFrame, headers: list) -> DataFrame:
    """Lines below the section's first with the header (number, size, values) of their block and their place in it."""
    spark = section.sparkSession
    table = spark.createDataFrame([(i, h.k, *(int(x) for x in h.p)) for i, h in enumerate(headers)], "block int, start long, b0 long, b1 long, b2 long, n long")
    starts = F.array(*[F.lit(h.k) for h in headers])
    rows = section.where("k > 0").withColumn("block", F.aggregate(starts, F.lit(-1), lambda a, s: a + F.when(s <= F.col("k"), 1).otherwise(0)))
    return rows.join(F.broadcast(table), "block").withColumn("at", F.col("k") - F.col("start") - 1).where("at >= 0")


def nodes_of(section: DataFrame, dimension: int) -> DataFrame:
    """(tag, x, y[, z]) of the section, whose headers alone have four values; parametric ones and wrong totals fail."""
    first = section.where("k = 0").first()
    blocks, total, low, high = (int(x) for x in first.p)
    headers = section.where((F.size("p") == 4) & (F.col("k") > 0)).orderBy("k").limit(BLOCKS + 1).collect()
    if len(headers) != blocks or blocks > BLOCKS or any(int(h.p[2]) for h in headers) or sum(int(h.p[3]) for h in headers) != total:
        raise ContractError("node blocks are parametric, or not as many as told")
    rows = with_block(section, headers)
    tags = rows.where("at < n").select("block", "at", whole(F.col("p")[0]).alias("tag"))
    points = rows.where("at >= n").select("block", (F.col("at") - F.col("n")).alias("at"), *[real(F.col("p")[i]).alias(a) for i, a in enumerate("xyz"[:dimension])])
    out = tags.join(points, ["block", "at"]).drop("block", "at")
    found = out.agg(F.count("*").alias("n"), F.countDistinct("tag").alias("d"), F.min("tag").alias("low"), F.max("tag").alias("high")).first()
    if (found.n, found.d, found.low, found.high) != (total, total, low, high) or section.count() != 1 + blocks + 2 * total:
        raise ContractError("node tags are repeated or missing, or their bounds are wrong")
    return out


def elements_of(section: DataFrame, groups: DataFrame, dimension: int) -> DataFrame:
    """(dim, entity, tag, corners of node tags); only simplices of the dimension and its boundary, all in named groups."""
    first = section.where("k = 0").first()
    blocks, total, *_ = (int(x) for x in first.p)
    kinds = {d: t for t, (d, _) in TYPES.items()}
    like = F.lit(False)
    for d, t in kinds.items():
        like = like | ((F.col("p")[0] == str(d)) & (F.col("p")[2] == str(t)))
    some = {r.k: r for r in section.where((F.size("p") == 4) & (F.col("k") > 0) & like).orderBy("k").limit(BLOCKS + 8).collect()}
    at, headers = 1, []
    for _ in range(blocks):  # a header tells where the next one stands; lines that look like one but aren't are passed by
        if at not in some or int(some[at].p[0]) not in (dimension, dimension - 1):
            raise ContractError("an element block is missing or of a type that isn't read")
        headers.append(some[at])
        at += 1 + int(some[at].p[3])
    if sum(int(h.p[3]) for h in headers) != total or section.count() != at:
        raise ContractError("the number of elements is wrong")
    rows = with_block(section, headers)
    corners = F.when(F.col("b0") == 1, 2).when(F.col("b0") == 2, 3).otherwise(4)
    width = F.when(F.size("p") == corners + 1, F.col("p")).otherwise(F.raise_error(F.lit("an element has a wrong number of corners")).cast("array<string>"))
    out = rows.select(F.col("b0").cast("int").alias("dim"), F.col("b1").alias("entity"), width.alias("p")).select("dim", "entity", whole(F.col("p")[0]).alias("tag"), F.transform(F.slice("p", 2, 4), whole).alias("corners"))
    if out.select("tag").distinct().count() != total or out.join(groups, ["dim", "entity"], "left_anti").limit(1).count():
        raise ContractError("element tags are repeated, or an element has no named group")
    return out


def read_msh(spark: SparkSession, path: str, scale: float = 1.0, dimension: int = 2) -> Mesh:
    """The mesh of a file: nodes numbered 0, 1, .. by tag, cells and facets by element tag, cells positively oriented."""
    tables = Tables(spark, "msh")
    lines = tables.write("lines", lines_of(spark, path))
    spans = marks(lines)
    part = {name: within(lines, span) for name, span in spans.items()}
    if [r.value for r in part["MeshFormat"].collect()] != ["4.1 0 8"]:
        raise ContractError("only ASCII MSH 4.1 with 8-byte numbers is read")
    groups = tables.write("groups", entity_groups(part["Entities"], physical_names(part["PhysicalNames"])))
    nodes = tables.write("nodes", numbered(nodes_of(part["Nodes"], dimension), ["tag"], "node_id"))
    axes = "xyz"[:dimension]
    raw = tables.write("elements", elements_of(part["Elements"], groups, dimension))
    spots = raw.select("dim", "entity", "tag", F.posexplode("corners").alias("i", "corner")).join(nodes.select(F.col("tag").alias("corner"), "node_id"), "corner", "left")
    spots = spots.withColumn("node_id", F.when(F.col("node_id").isNotNull(), F.col("node_id")).otherwise(F.raise_error(F.lit("an element names a node that is missing")).cast("long")))
    joined = spots.groupBy("dim", "entity", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node_id"))), lambda s: s["node_id"]).alias("nodes"))
    cells = tables.write("cells", numbered(joined.where(F.col("dim") == dimension), ["tag"], "cell_id"))
    facets = tables.write("facets", numbered(joined.where(F.col("dim") == dimension - 1), ["tag"], "facet_id"))
    points = nodes.select("node_id", *[(scale * F.col(a)).alias(a) for a in axes])
    g = gathered(cells, points)
    det = (el.triangle(g) if dimension == 2 else el.tetrahedron(g)).select("cell_id", "det")
    last = F.size("nodes")
    flipped = F.concat(F.slice("nodes", F.lit(1), last - 2), F.reverse(F.slice("nodes", last - 1, F.lit(2))))
    oriented = cells.join(det, "cell_id").select("cell_id", F.when(F.col("det") < 0, flipped).otherwise(F.col("nodes")).alias("nodes"))
    tags = cells.select(F.col("cell_id").alias("entity_id"), "dim", "entity").unionByName(facets.select(F.col("facet_id").alias("entity_id"), "dim", "entity"))
    return Mesh(points, tables.write("oriented", oriented), facets.select("facet_id", "nodes"), tags.join(groups, ["dim", "entity"]).select("name", "dim", "entity_id"))


def msh_lines(mesh: Mesh, dimension: int = 2) -> DataFrame:
    """(line_no, value) of the text of a mesh: one entity a group, tags numbered from 1 in the order of the ids."""
    spark = mesh.cells.sparkSession
    names = [(r.name, r.dim) for r in mesh.tags.select("name", "dim").distinct().orderBy("dim", "name").limit(BLOCKS).collect()]
    by_dim = {d: [n for n, e in names if e == d] for d in (dimension - 1, dimension)}
    head = ["$MeshFormat", "4.1 0 8", "$EndMeshFormat", "$PhysicalNames", str(len(names)), *(f'{d} {k + 1} "{n}"' for k, (n, d) in enumerate(names)), "$EndPhysicalNames", "$Entities"]
    head.append(" ".join(str(len(by_dim.get(d, []))) for d in range(4)))
    entity = {}
    for d in (dimension - 1, dimension):
        for n in by_dim[d]:
            entity[n, d] = len([x for x in entity if x[1] == d]) + 1
            tag = names.index((n, d)) + 1
            head.append(f"{entity[n, d]} 0 0 0 1 1 1 1 {tag} 0")
    head.append("$EndEntities")
    count = mesh.nodes.count()
    head += ["$Nodes", f"1 {count} 1 {count}", f"{dimension} 1 0 {count}"]
    parts = [spark.createDataFrame([(0, k, v) for k, v in enumerate(head)], "part int, line_no long, value string")]
    parts.append(mesh.nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("line_no"), (F.col("node_id") + 1).cast("string").alias("value")))
    axes = [F.col(a).cast("string") if a in mesh.nodes.columns else F.lit("0") for a in "xyz"]
    parts.append(mesh.nodes.select(F.lit(2).alias("part"), F.col("node_id").alias("line_no"), F.concat_ws(" ", *axes).alias("value")))
    sides = {dimension - 1: mesh.facets.select(F.col("facet_id").alias("id"), "nodes"), dimension: mesh.cells.select(F.col("cell_id").alias("id"), "nodes")}
    total = sum(t.count() for t in sides.values())
    parts.append(spark.createDataFrame([(3, 0, "$EndNodes"), (3, 1, "$Elements"), (3, 2, f"{len(entity)} {total} 1 {total}")], "part int, line_no long, value string"))
    number, offset = 4, 1
    for (n, d), e in entity.items():
        rows = mesh.tags.where((F.col("name") == n) & (F.col("dim") == d)).join(sides[d], F.col("entity_id") == F.col("id"))
        base = offset if d == dimension - 1 else offset
        parts.append(rows.agg(F.count("*").alias("c")).select(F.lit(number).alias("part"), F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", F.lit(d), F.lit(e), F.lit({1: 1, 2: 2, 3: 4}[d]), "c").alias("value")))
        shift = 0 if d == dimension - 1 else sides[dimension - 1].count()
        parts.append(rows.select(F.lit(number + 1).alias("part"), F.col("id").alias("line_no"), F.concat_ws(" ", (F.col("id") + 1 + shift).cast("string"), F.array_join(F.transform("nodes", lambda x: (x + 1).cast("string")), " ")).alias("value")))
        number += 2
        offset = base
    parts.append(spark.createDataFrame([(number, 0, "$EndElements")], "part int, line_no long, value string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, path: str) -> str:
    """The lines(part, line_no, value) as one text file; returns the folder."""
    lines.orderBy("part", "line_no").select("value").coalesce(1).write.mode("errorifexists").text(path)
    return path
