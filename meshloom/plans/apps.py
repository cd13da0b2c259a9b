"""Registered queries of applications: the ring heater, evidence of process sets, thermo-optic routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions import scalars as sc
from meshloom.operators import evidence, mesh, ring, tet4, transfer
from meshloom.plans.registry import query, r9, sized, sized_square_sql, table


@query("SELECT name, value FROM (VALUES " + ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in ring.CONSTANTS.items()) + ") t(name, value)")
def ring_constants(spark, sf):
    """The public example's constants."""
    return ring.constants(spark)


@query("SELECT s_suppkey, point, round(i / g, 9) AS volts, round(i * (i / g), 9) AS watts FROM (SELECT s_suppkey, (1 + abs(s_acctbal)) / 1e4 AS g FROM supplier), (VALUES ('source_reproduction', 0.015), ('low_temperature_projection', 0.005)) p(point, i)")
def operating_points(spark, sf):
    """Both operating points of every supplier's conductance."""
    s = table(spark, sf, "supplier").select("s_suppkey", ((1 + F.abs("s_acctbal")) / 1e4).alias("g"))
    out = None
    for name in ring.OPERATING:
        at = ring.projected(F.col("g"), name)
        rows = s.select("s_suppkey", F.lit(name).alias("point"), F.round(at["volts"], 9).alias("volts"), F.round(at["watts"], 9).alias("watts"))
        out = rows if out is None else out.unionByName(rows)
    return out


def small_ring(spark):
    """A stand-in for a meshed ring: a box with a heater along x in the middle of its upper half, in oxide over silicon."""
    m = mesh.tet_box(spark, 2, 4, 4)
    g = mesh.gathered(m.cells, m.nodes)
    mid = lambda a: (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 4
    inside = (mid("y") > 0.25) & (mid("y") < 0.75) & (mid("z") > 0.5) & (mid("z") < 0.75)
    regions = g.select("cell_id", F.when(inside, "heater").when(mid("z") < 0.25, "silicon").otherwise("oxide").alias("region"))
    materials = spark.createDataFrame([("heater", 28.0, 2.3e6), ("silicon", 148.0, None), ("oxide", 1.38, None)], "region string, k double, sigma double")
    nodes = m.cells.join(regions.where("region = 'heater'"), "cell_id", "left_semi").select(F.explode("nodes").alias("node_id")).distinct().join(m.nodes, "node_id")
    return m, regions, materials, (nodes.where("x = 1").select("node_id"), nodes.where("x = 0").select("node_id"))


@query("SELECT side AS \"lateral\", true AS ok, 287500.0 AS power, true AS warmer FROM (SELECT unnest(['adiabatic', 'isothermal']) AS side)")
def ring_forward(spark, sf):
    """The heater's forward plan with free and with held side walls: balances, power at 1 V, and that held walls cool."""
    m, regions, materials, ends = small_ring(spark)
    found = []
    for lateral in ("adiabatic", "isothermal"):
        out = tet4.solve_plan(ring.forward_plan(m, regions, materials, ends, ring.Surroundings(lateral=lateral)))
        b = tet4.admitted(out["balances"], tet4.Admission(1e-8, 1e-8, 1e-12, 1e-8)).first()
        found.append((lateral, b.ok, round(b.power, 6), out["temperature"].agg(F.max("u")).first()[0]))
    return spark.createDataFrame([(n, bool(ok), p, found[0][3] > found[1][3] > 300) for n, ok, p, _ in found], "lateral string, ok boolean, power double, warmer boolean")


@query("SELECT region, cells, volume, true AS ok FROM (VALUES ('heater', 24, 0.125), ('oxide', 120, 0.625), ('silicon', 48, 0.25)) t(region, cells, volume)")
def ring_mesh_report(spark, sf):
    """Quality and volume of each region against what its geometry says."""
    m, regions, _, _ = small_ring(spark)
    expected = spark.createDataFrame([("heater", 0.125), ("oxide", 0.625), ("silicon", 0.25)], "region string, volume double")
    return ring.mesh_report(m, regions, expected).select("region", F.col("cells").cast("int").alias("cells"), F.round("volume", 9).alias("volume"), "ok")


@query("""WITH c AS (SELECT w, d, 'adiabatic' AS side, CASE WHEN w = 20 AND d = 0.5 THEN 'baseline' WHEN w = 20 THEN 'substrate_depth' WHEN d = 0.5 THEN 'lateral_extent' ELSE 'depth_extent_interaction' END AS axis
FROM (VALUES (20.0), (40.0), (80.0)) a(w), (VALUES (0.5), (5.0), (50.0)) b(d) UNION ALL SELECT 40.0, 5.0, 'isothermal', 'sidewall_boundary')
SELECT CAST(w AS DOUBLE) AS width_um, CAST(d AS DOUBLE) AS depth_um, side AS "lateral", axis, round((16 - w / 400.0) / (1 + d / 100.0) / 1.0, 9) AS k_per_mw, round((16 - w / 400.0) / (1 + d / 100.0) / ((16 - 20 / 400.0) / (1 + 0.5 / 100.0)), 9) AS ratio FROM c""")
def sensitivity_report(spark, sf):
    """Ten cases with stated rises at 1 mW: rise per milliwatt, and its ratio to the baseline."""
    from meshloom.plans.registry import QUERIES

    cases = QUERIES["sensitivity_cross"](spark, sf)
    rise = (16 - F.col("width_um") / 400.0) / (1 + F.col("depth_um") / 100.0)
    runs = cases.select("width_um", "depth_um", "lateral", F.lit(1e-3).alias("watts"), rise.alias("rise"))
    return ring.sensitivity_plan(cases, runs).select("width_um", "depth_um", "lateral", "axis", F.round("k_per_mw", 9).alias("k_per_mw"), F.round("ratio", 9).alias("ratio"))


# --- evidence ---------------------------------------------------------------------------------------------------------

PROCESSES, DEVICES = 4, 8


def evidence_sql(kind: str) -> str:
    k = evidence.KINDS[kind]
    metrics = " UNION ALL ".join(f"SELECT 'metric' AS section, '{m}' AS name, {v!r} * m / 100.0 AS value, m <= 100 AS ok FROM worst" for m, v in k.limits.items())
    paths = " UNION ALL ".join(f"SELECT 'path', '{e}', (SELECT median(v) FROM slow) + {i}, true" for i, e in enumerate(k.executables))
    return f"""WITH worst AS (SELECT max(user_id % 97) AS m FROM events),
slow AS (SELECT event_id % {k.runs} AS ordinal, max(value) AS v FROM events GROUP BY 1)
SELECT section, name, round(CAST(value AS DOUBLE), 9) AS value, ok FROM ({metrics} UNION ALL {paths}
UNION ALL SELECT 'set', unnest(['complete', 'covered_once', 'one_identity']), -1.0, true)"""


def evidence_rows(spark, sf, kind: str):
    """Records of four processes made of the events: each metric at a share of its limit, each executable a second slower."""
    k = evidence.KINDS[kind]
    e = table(spark, sf, "events").select((F.col("event_id") % PROCESSES).cast("int").alias("process"), "event_id", "user_id", "value")
    records = spark.range(PROCESSES).select(F.col("id").cast("int").alias("process"), F.concat(F.lit("worker-"), F.col("id").cast("string")).alias("worker"), F.lit("run-1").alias("identity"))
    partitions = spark.range(DEVICES).select((F.col("id") % PROCESSES).cast("int").alias("process"), F.col("id").alias("device"))
    metrics = e.select("process", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (v * (F.col("user_id") % 97) / 100.0).alias("value")) for m, v in k.limits.items()])).alias("m")).select("process", "m.*")
    seconds = e.select("process", (F.col("event_id") % k.runs).alias("ordinal"), F.explode(F.array(*[F.struct(F.lit(x).alias("executable"), (F.col("value") + i).alias("value")) for i, x in enumerate(k.executables)])).alias("s")).select("process", "ordinal", "s.*")
    out = evidence.aggregated(kind, records, partitions, metrics, seconds, PROCESSES, DEVICES)
    return out.select("section", "name", F.round(F.coalesce("value", F.lit(-1.0)), 9).alias("value"), "ok")


def evidence_query(kind: str):
    def run(spark, sf):
        return evidence_rows(spark, sf, kind)

    run.__name__ = f"evidence_{kind}"
    run.__doc__ = f"Verdict on a set of process records of the sort {kind}."
    return query(evidence_sql(kind))(run)


for _kind in evidence.KINDS:
    evidence_query(_kind)


@query("SELECT false AS complete, false AS one_identity, false AS covered_once")
def evidence_incomplete(spark, sf):
    """A set without one process, with two identities and a device held twice."""
    records = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (3, "c", "y")], "process int, worker string, identity string")
    partitions = spark.createDataFrame([(0, 0), (1, 1), (3, 1), (3, 3)], "process int, device long")
    return evidence.process_set(records, partitions, PROCESSES, 4)


# --- thermo-optics on a mesh ------------------------------------------------------------------------------------------


@query(f"""WITH {sized_square_sql()}, p AS (SELECT event_id, (event_id * 37 % 1000 + 0.5) / 1000.0 AS u, (event_id * 91 % 1000 + 0.25) / 1000.0 AS v FROM events),
t AS (SELECT event_id, u, 2 + 1e-2 * ((300 + 20 * u + 3 * v) - 300) AS n FROM p)
SELECT event_id AS point_id, CAST(floor(u * 4) AS INTEGER) AS shard, round(n, 9) AS index, round((n * n - 3.5) / 3.5, 9) AS fraction FROM t""")
def thermo_optic_routing(spark, sf):
    """Temperatures of a mesh that grows with the parts at a point per event, sampled, turned to permittivity fractions and
    placed by the point's shard along x."""
    m = mesh.unit_square(spark, sized(spark, sf))
    points = table(spark, sf, "events").select(F.col("event_id").alias("point_id"), ((F.col("event_id") * 37 % 1000 + 0.5) / 1000.0).alias("u"), ((F.col("event_id") * 91 % 1000 + 0.25) / 1000.0).alias("v"))
    field = m.nodes.select("node_id", (300 + 20 * F.col("x") + 3 * F.col("y")).alias("u"))
    rows = transfer.sampled(transfer.located(m, points), field).join(points, "point_id")
    rows = rows.withColumn("shard", F.floor(F.col("u") * 4).cast("int")).repartitionById(4, F.col("shard"))
    state = sc.thermo_optic(F.col("value"), 300.0, 2.0, 1e-2, 3.5, 7.0)
    return rows.select("point_id", "shard", r9(state["index"]).alias("index"), r9(state["fraction"]).alias("fraction"))
