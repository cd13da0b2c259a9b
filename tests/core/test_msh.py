import pytest
from pyspark.sql import functions as F

from meshloom.operators import mesh
from meshloom.operators.tables import Tables
from meshloom.sources import msh


def plate(spark, n=4):
    """A square without its middle: the rim is the outer edge and the hole, cells are in two layers."""
    m = mesh.unit_square(spark, n)
    g = mesh.gathered(m.cells, m.nodes)
    mid = g.select("cell_id", ((F.col("x0") + F.col("x1") + F.col("x2")) / 3).alias("cx"), ((F.col("y0") + F.col("y1") + F.col("y2")) / 3).alias("cy"))
    kept = mid.where("NOT (cx > 0.25 AND cx < 0.75 AND cy > 0.25 AND cy < 0.75)")
    cells = m.cells.join(kept, "cell_id").select("cell_id", "nodes", "cy")
    used = cells.select(F.explode("nodes").alias("node_id")).distinct()
    number = {r.node_id: k for k, r in enumerate(used.orderBy("node_id").collect())}
    nodes = [(number[r.node_id], r.x, r.y) for r in m.nodes.join(used, "node_id").collect()]
    cells = [(k, [number[x] for x in r.nodes], r.cy) for k, r in enumerate(cells.orderBy("cell_id").collect())]
    nodes = spark.createDataFrame(nodes, "node_id long, x double, y double")
    layers = spark.createDataFrame(cells, "cell_id long, nodes array<long>, cy double")
    bare = mesh.Mesh(nodes, layers.select("cell_id", "nodes"))
    rim = [(k, r.nodes) for k, r in enumerate(mesh.boundary_facets(bare).orderBy("cell_id", "local").collect())]
    at = {r.node_id: (r.x, r.y) for r in nodes.collect()}
    outer = lambda f: any(all(at[x][a] == v for x in f) for a in (0, 1) for v in (0.0, 1.0))
    tags = [("outer edge" if outer(f) else "hole", 1, k) for k, f in rim] + [("lower layer" if c < 0.5 else "upper layer", 2, k) for k, _, c in cells]
    return mesh.Mesh(nodes, bare.cells, spark.createDataFrame(rim, "facet_id long, nodes array<long>"), spark.createDataFrame(tags, "name string, dim int, entity_id long"))


def text_of(lines):
    return "\n".join(r.value for r in lines.orderBy("part", "line_no").collect()) + "\n"


def saved(tmp_path, text, name="plate.msh"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


def test_a_plate_with_a_hole_comes_back(spark, tmp_path):
    m = plate(spark)
    out = msh.read_msh(spark, saved(tmp_path, text_of(msh.msh_lines(m))), scale=2.0)
    mesh.validate(out)
    assert rows(out.cells, "cell_id", "nodes") == rows(m.cells, "cell_id", "nodes")
    assert rows(out.nodes, "node_id", "x", "y") == rows(m.nodes.selectExpr("node_id", "2 * x AS x", "2 * y AS y"), "node_id", "x", "y")
    assert rows(out.tags, "name", "dim", "entity_id") == rows(m.tags, "name", "dim", "entity_id")
    assert {r.name for r in out.tags.collect()} == {"outer edge", "hole", "lower layer", "upper layer"}


def test_negative_cells_are_turned(spark, tmp_path):
    m = plate(spark)
    turned = mesh.Mesh(m.nodes, m.cells.select("cell_id", F.reverse("nodes").alias("nodes")), m.facets, m.tags)
    out = msh.read_msh(spark, saved(tmp_path, text_of(msh.msh_lines(turned))))
    assert mesh.geometry(out).where("det <= 0").count() == 0


def test_a_volume(spark, tmp_path):
    m = mesh.tet_box(spark, 2, 1, 1)
    rim = mesh.boundary_facets(m).select((F.col("cell_id") * 4 + F.col("local")).alias("old"), "nodes")
    facets = mesh.numbered(rim, ["old"], "facet_id").select("facet_id", "nodes")
    tags = facets.select(F.lit("skin").alias("name"), F.lit(2).alias("dim"), F.col("facet_id").alias("entity_id")).unionByName(m.cells.select(F.lit("block").alias("name"), F.lit(3).alias("dim"), F.col("cell_id").alias("entity_id")))
    out = msh.read_msh(spark, saved(tmp_path, text_of(msh.msh_lines(mesh.Mesh(m.nodes, m.cells, facets, tags), 3))), dimension=3)
    mesh.validate(out)
    assert out.cells.count() == 12 and out.facets.count() == facets.count()


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t.replace("4.1 0 8", "2.2 0 8"),
        lambda t: t.replace("$EndNodes\n", ""),
        lambda t: t.replace("$Nodes", "$Nodez"),
        lambda t: "stray\n" + t,
        lambda t: t.replace('"hole"', '"outer edge"'),
        lambda t: t.replace("$Nodes\n1 24 1 24", "$Nodes\n1 24 1 25"),
        lambda t: t.replace("2 1 0 24", "2 1 1 24"),
        lambda t: t.replace("\n0.25 0.0 0\n", "\nnan 0.0 0\n"),
        lambda t: t.replace("\n3\n4\n5\n", "\n3\n3\n5\n"),
    ],
)
def test_malformed_files_fail(spark, tmp_path, change):
    text = text_of(msh.msh_lines(plate(spark)))
    assert change(text) != text
    with pytest.raises(Exception):
        out = msh.read_msh(spark, saved(tmp_path, change(text)))
        out.nodes.count(), mesh.validate(out)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    path = saved(tmp_path, "".join(f"line {i}\n\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r.line_no: r.value for r in msh.lines_of(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"line {i}" for i in range(5000)}
    assert Tables(spark, "x").root
