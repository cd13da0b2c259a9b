import math

import pytest
from pyspark.sql import functions as F

from meshloom.operators import contracts as ct
from meshloom.operators import mesh
from meshloom.sources import results
from meshloom.streaming.sources import cell_sources


def test_parameters_resolve_and_reject():
    p = {"k": ct.Parameter("k", "W/m/K", 2.0, "design", 0.0, 5.0)}
    assert ct.resolve(ct.Reference("k"), p, positive=True) == 2.0 and ct.active(list(p.values()))[0].name == "k"
    for bad in (ct.Reference("x"), math.nan, -1.0, True):
        with pytest.raises(ct.ContractError):
            ct.resolve(bad, p, positive=True)
    with pytest.raises(ct.ContractError):
        ct.Parameter("k", "W", 9.0, "design", 0.0, 5.0)


def test_regions_and_constraints(spark):
    m = mesh.unit_square(spark, 2)
    assert ct.on_cells(m, {"domain": 3.0}, "k").agg(F.sum("k")).first()[0] == 24
    assert ct.constraints(m, {"left": 1.0, "right": 2.0}).count() == 6
    with pytest.raises(ct.ContractError):
        ct.constraints(m, {"left": 1.0, "top": 2.0})
    with pytest.raises(ct.ContractError):
        ct.on_cells(m, {}, "k") if False else ct.on_cells(m, {"other": 1.0}, "k")


def test_unanchored_components(spark):
    comps = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 5)], "node_id long, root long")
    fixed = spark.createDataFrame([(1,)], "node_id long")
    assert [r.root for r in ct.unanchored(comps, fixed).collect()] == [5]


def test_backends_and_workflows():
    has = ct.Capabilities(analyses=frozenset({"steady"}), gradients=frozenset({"adjoint"}))
    known = ct.Backends()
    known.add("spark", has, lambda: 1)
    assert known.names() == ["spark"] and known.get("spark", has)() == 1
    for name, needs in (("spark", ct.Capabilities(analyses=frozenset({"transient"}))), ("other", has)):
        with pytest.raises(ct.ContractError):
            known.get(name, needs)
    edges = [ct.Edge("current", "heat", "power", "W"), ct.Edge("heat", "optics", "temperature", "K")]
    assert ct.ordered(["optics", "heat", "current", "a"], edges) == ["a", "current", "heat", "optics"]
    with pytest.raises(ct.ContractError):
        ct.ordered(["a", "b"], [ct.Edge("a", "b", "x", "W"), ct.Edge("b", "a", "y", "W")])


def test_nodal_fields_logs_and_decks(spark, tmp_path):
    good = tmp_path / "f.txt"
    good.write_text("t 2 1.5\nt 1 0.5\n\nphi 1 0\nphi 2 1\n")
    assert results.nodal_fields(spark, str(good), 2).where("name = 't' and node_id = 0").first().value == 0.5
    good.write_text("t 1 1.5\nt 1 0.5\n")
    with pytest.raises(ct.ContractError):
        results.nodal_fields(spark, str(good), 2)
    log = spark.createDataFrame([(0, "NRM,RELC): ( 1.0 2.0 ) :: heat"), (1, "NRM,RELC): ( 1.5 1e-9 ) :: heat"), (2, "NRM,RELC): ( 7 7 ) :: other")], "line_no long, value string")
    assert results.last_change(log, "heat").first() == (1.5, 1e-9)
    m = mesh.unit_square(spark, 1)
    deck = results.deck_lines(m, m.cells.select("cell_id", F.lit(1).alias("body")))
    assert deck["header"].first().value == "4 2 4" and deck["elements"].orderBy("line_no").first().value == "1 1 303 1 2 4"
    assert deck["boundary"].count() == 4 and deck["nodes"].count() == 4


def test_checkpoints_refuse_other_sources(spark, tmp_path):
    state = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "owner int, node_id long, u double")
    path = str(tmp_path / "c")
    results.write_checkpoint(state, path, "s", "c")
    assert results.restore_checkpoint(spark, path, "s", "c", 2).count() == 2
    for args in (("x", "c", 2), ("s", "x", 2), ("s", "c", 3)):
        with pytest.raises(ct.ContractError):
            results.restore_checkpoint(spark, path, *args)
    with pytest.raises(Exception, match="already exists"):
        results.write_checkpoint(state, path, "s", "c")


def test_stream_of_cell_sources_equals_the_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = cell_sources(stream, 8).writeStream.format("memory").queryName("cells").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.cell_id): r.n for r in spark.table("cells").collect()}
    want = {(r.window.start, r.cell_id): r.n for r in cell_sources(batch, 8).collect()}
    assert got == want
