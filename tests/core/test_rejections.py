"""What the readers, problems and layouts must refuse."""

import json

import pytest
from pyspark.sql import functions as F

from meshloom import __main__ as cli
from meshloom.operators import mesh, partition, port, ring, specs, tet4
from meshloom.operators.contracts import Capabilities, Parameter, Reference
from meshloom.operators.mesh import ContractError
from meshloom.operators.tables import Tables
from meshloom.sources import bundles, decks, materials, nodal

RESULT = """ASCII 3
!when
Degrees of freedom:
flow : 2 4 1 : flow equation
heat : 4 4 1 : heat equation
Total DOFs: 2
Number Of Nodes: 4
Time: 1 1 0.0
flow
Perm: 4 2
2 2
4 1
7.5
8.5
heat
Perm: 4 4
1 1
2 2
3 3
4 4
1.0
2.0
3.0
4.0
"""


def saved(tmp_path, text):
    p = tmp_path / "result.txt"
    p.write_text(text)
    return str(p)


def fields(spark, path):
    some = spark.createDataFrame([(1,), (3,)], "node_id long")
    return sorted(tuple(r) for r in nodal.read_fields(spark, path, 4, {"Flow": some, "heat": None}).collect())


def test_result_values_follow_the_nodes(spark, tmp_path):
    assert fields(spark, saved(tmp_path, RESULT)) == [("flow", 1, 7.5), ("flow", 3, 8.5), ("heat", 0, 1.0), ("heat", 1, 2.0), ("heat", 2, 3.0), ("heat", 3, 4.0)]


@pytest.mark.parametrize("old, new", [("2 2\n4 1", "2 2\n4 2"), ("2 2\n4 1", "2 2\n5 1"), ("4 1\n", "3 1\n"), ("Number Of Nodes: 4", "Number Of Nodes: 5"), ("Total DOFs: 2", "Total DOFs: 3"), ("8.5\n", "8.5\n9.5\n"), ("8.5\n", "nan\n"), ("heat : 4 4 1", "flow : 4 4 1"), ("Time: 1 1 0.0\n", ""), ("Perm: 4 2", "Perm: use previous")])
def test_malformed_results_fail(spark, tmp_path, old, new):
    assert old in RESULT
    with pytest.raises(Exception):
        fields(spark, saved(tmp_path, RESULT.replace(old, new)))


def test_port_log_must_agree_with_itself(spark):
    from meshloom.plans.sources import port_log_lines

    rows = port_log_lines(spark)
    nodal.port_log(rows, 0)
    for change in (("beta: 2.0 0.0", "beta: 2.1 0.0"), ("residual: 3", "residual: 4"), ("power 1 0.5", "power 1 -0.5"), ("iterations is: 7", "iterations: 7")):
        with pytest.raises(Exception):
            nodal.port_log(rows.withColumn("value", F.replace("value", F.lit(change[0]), F.lit(change[1]))), 0)
    with pytest.raises(ContractError):
        nodal.port_log(rows, 3)


def test_catalogs(spark):
    good = materials.BUILTIN
    materials.checked(good)
    names, properties = materials.builtin_catalog(spark)
    ask = lambda *row: materials.evaluated(spark.createDataFrame([row], "name string, property string, temperature_k double, wavelength_m double"), names, properties).first().value
    assert ask("silica", "refractive_index", 293.15, 1.55e-6) == pytest.approx(1.4440236217032607, abs=1e-12)
    for row in (("silica", "refractive_index", 300.0, 1.55e-6), ("silica", "refractive_index", 293.15, 5e-6), ("silica", "refractive_index", 293.15, None), ("gold", "x", 300.0, None), ("silicon", "colour", 300.0, None)):
        with pytest.raises(Exception):
            ask(*row)
    twin = json.loads(json.dumps(good))
    twin["materials"][1]["aliases"].append("SILICON")
    lost = json.loads(json.dumps(good))
    lost["materials"][0]["properties"][0]["sources"] = ["nowhere"]
    table = json.loads(json.dumps(good))
    table["materials"][0]["properties"][0] |= {"model": "table", "at_k": [1, 1], "values": [1, 2]}
    for bad in (twin, lost, table):
        with pytest.raises(ContractError):
            materials.checked(bad)


def test_bundles_notice_changes_and_are_never_overwritten(spark):
    path = Tables(spark, "bundle").root
    rows = spark.createDataFrame([("Ex", 0, 0, 0, 1.0, 2.0), ("Ey", 1, 0, 0, 3.0, 4.0)], "component string, i long, j long, k long, re double, im double")
    bundles.write_bundle(rows, path, {"mode": 1})
    out, manifest = bundles.read_bundle(spark, path)
    assert out.count() == 2 and manifest["metadata"] == {"mode": 1}
    with pytest.raises(Exception):
        bundles.write_bundle(rows, path, {})
    with pytest.raises(ContractError):
        bundles.read_bundle(spark, path, most_rows=1)
    rows.withColumn("re", F.col("re") + 1).write.mode("overwrite").parquet(f"{path}/fields")
    with pytest.raises(ContractError):
        bundles.read_bundle(spark, path)


def test_run_manifests(tmp_path):
    good = dict(run_id="r", created_at="2024-01-01T00:00:00+00:00", backend="b", version="1", problem="0" * 64, authorized=False)
    m = bundles.RunManifest(**good, artifacts=(("a/b", "log", "1" * 64, 3),), metadata={"x": [1]})
    assert bundles.RunManifest.of(m.json()).digest() == m.digest()
    for change in ({"run_id": " r"}, {"created_at": "2024-01-01T00:00:00"}, {"problem": "0" * 63}, {"process": "maybe"}, {"convergence": "converged"}, {"artifacts": (("/a", "log", "1" * 64, 3),)}):
        with pytest.raises(ContractError):
            bundles.RunManifest(**{**good, **change})
    p = tmp_path / "f"
    p.write_bytes(b"abc" * 999)
    import hashlib

    assert bundles.sha256_file(str(p), 100) == hashlib.sha256(b"abc" * 999).hexdigest()
    with pytest.raises(ContractError):
        bundles.sha256_file(str(tmp_path))


def test_problems(spark):
    m = mesh.unit_square(spark, 3)
    heat = lambda **kw: specs.SteadyHeat(**{"regions": {"domain": {"k": 1.0, "q": 0.0}}, "held": {"left": 1.0}, **kw})
    heat().validate(m)
    assert heat().digest() == heat().digest() != heat(held={"left": 2.0}).digest()
    for kw in ({"held": {}}, {"regions": {"domain": {"k": -1.0, "q": 0.0}}}, {"regions": {"domain": {"k": 1.0}}}, {"fluxes": {"left": 1.0}}, {"held": {"left": float("nan")}}):
        with pytest.raises(ContractError):
            heat(**kw)
    for kw in ({"held": {"left": 1.0, "bottom": 2.0}}, {"held": {"nowhere": 1.0}}, {"held": {"left": 1.0, "right": 1.0, "top": 1.0, "bottom": 1.0, "x": 1.0}}, {"regions": {"other": {"k": 1.0, "q": 0.0}}}):
        with pytest.raises(ContractError):
            heat(**kw).validate(m)
    with pytest.raises(ContractError):
        specs.PortEigenmode({"domain": {"eps_r": 1.0, "mu_r": 1.0}}, ["left"], 1e14, 2).validate(m)
    assert not heat().requirements().missing(Capabilities()) and specs.SparkHeat().capabilities().missing(heat().requirements()) == {}
    assert specs.SparkPort().capabilities().missing(heat().requirements())


def test_parameters():
    ps = (Parameter("a", "m", 1.0, "design", 0.0, 2.0), Parameter("b", "m", 5.0), Parameter("c", "m", 3.0, "control"))
    bound = specs.ActiveBinding(ps)
    assert bound.project([1.0, 5.0, 3.0]) == [1.0, 3.0] and bound.embed([2.0, 9.0]) == [2.0, 5.0, 9.0]
    assert all(x != x for x in bound.embed([2.5, 9.0]))
    assert specs.coefficient_from_vector(Reference("b"), ["a", "b"], [1.0, 7.0]) == 7.0
    assert specs.full_vector(list(ps), {"c": 3, "a": 1, "b": 2}) == [1.0, 2.0, 3.0]
    with pytest.raises(ContractError):
        specs.full_vector(list(ps), {"a": 1})
    assert specs.shape_of([[1, 2], [3, 4]]) == (2, 2)
    with pytest.raises(ContractError):
        specs.shape_of([[1], [2, 3]])
    with pytest.raises(ContractError):
        specs.ExecutionPolicy(True).require("network")


def test_layouts(spark):
    m = mesh.unit_square(spark, 3)
    dofs = partition.node_dofs(m)
    t = partition.prepare(dofs, mesh.cell_owners(m, 3))
    partition.require_owners(t, 3)
    for parts in (2, 4):
        with pytest.raises(ContractError):
            partition.require_owners(t, parts)
    other = partition.prepare(dofs.repartition(7), mesh.cell_owners(m, 3).repartition(5))
    assert partition.layout_digest(t) == partition.layout_digest(other) != partition.layout_digest(partition.prepare(dofs, mesh.cell_owners(m, 2)))
    with pytest.raises(ContractError):
        partition.reduced(dofs, spark.createDataFrame([(999,)], "dof long"))
    twice = spark.createDataFrame([(0, 5, 1.0), (1, 5, 1.0)], "owner int, dof long, u double")
    with pytest.raises(Exception):
        partition.assemble_vector(twice).collect()
    with pytest.raises(ContractError):
        partition.replicated(spark.range(20), 10)
    with pytest.raises(Exception):
        partition.require_finite(spark.createDataFrame([(1, float("nan"))], "dof long, v double"), "v").collect()


def test_volumes(spark):
    m = mesh.tet_box(spark, 1, 1, 1)
    rim = mesh.boundary_facets(m).select((F.col("cell_id") * 4 + F.col("local")).alias("facet_id"), "nodes")
    assert tet4.oriented_boundary(m, rim).count() == 12
    with pytest.raises(ContractError):
        tet4.oriented_boundary(m, rim.limit(11))
    two = spark.createDataFrame([(1, 2.0), (1, 3.0)], "node_id long, value double")
    with pytest.raises(ContractError):
        tet4.canonical_fixed(two, "x")
    with pytest.raises(ContractError):
        tet4.require_anchored(m.cells, spark.createDataFrame([(99,)], "node_id long"), "x")
    with pytest.raises(ContractError):
        tet4.disjoint_terminals(two, two)
    with pytest.raises(ContractError):
        ring.Surroundings(lateral="transfer")
    with pytest.raises(ContractError):
        ring.operating_point("other")


def test_decks_and_recipes():
    for bad in (lambda: decks.heat_deck([(0.0, 1.0)], [], [], "/lib"), lambda: decks.heat_deck([(1.0, 1.0)], [], [], "lib"), lambda: decks.heat_deck([(1.0, 1.0)], [], [], '/a "b'), lambda: decks.waveguide_recipe(core_width=5e-6), lambda: decks.ring_recipe("finest"), lambda: decks.port_deck([], [], 1e14, 2, 2, "/lib")):
        with pytest.raises(ContractError):
            bad()


def test_ports():
    import numpy as np

    with pytest.raises(ContractError):
        port.simple_pair(np.eye(3), np.eye(3), 0)
    with pytest.raises(ContractError):
        port.normalized(np.ones((2, 3)), np.ones((2, 3)), -1.0, 1.0)


def test_command_line(capsys):
    assert cli.main(["doctor", "--json"]) == 0
    assert any(c["name"] == "pyspark" and c["available"] for c in json.loads(capsys.readouterr().out))
    assert cli.main(["queries"]) == 0 and "heat_solve" in capsys.readouterr().out
