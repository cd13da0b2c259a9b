"""The ring heater: constants, operating points, thermal surroundings, and the sensitivity plan as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mesh import ContractError, Mesh
from .tet4 import Plan, faces_at, prepare

#: The public example's constants in SI units.
CONSTANTS = {
    "ambient_temperature_k": 300.0,
    "target_current_a": 0.015,
    "convection_w_per_m2_k": 10.0,
    "silicon_thermal_conductivity_w_per_m_k": 148.0,
    "silica_thermal_conductivity_w_per_m_k": 1.38,
    "tin_thermal_conductivity_w_per_m_k": 28.0,
    "tin_electrical_conductivity_s_per_m": 2.3e6,
    "aluminum_thermal_conductivity_w_per_m_k": 237.0,
    "aluminum_electrical_conductivity_s_per_m": 37.73e6,
}
#: Currents of the operating points in amperes.
OPERATING = {"source_reproduction": 0.015, "low_temperature_projection": 0.005}


def constants(spark: SparkSession) -> DataFrame:
    """(name, value)."""
    return spark.createDataFrame(list(CONSTANTS.items()), "name string, value double")


def operating_point(name: str) -> float:
    if name not in OPERATING:
        raise ContractError(f"an operating point is one of {sorted(OPERATING)}")
    return OPERATING[name]


def calibrated(unit_power: Column, current: float) -> dict[str, Column]:
    """At unit voltage the power is the conductance G: voltage I / G, power I^2 / G, and the factor of rises, V^2."""
    ok = F.when(unit_power > 0, unit_power).otherwise(F.raise_error(F.lit("a conductance must be positive")).cast("double"))
    volts = current / ok
    return {"volts": volts, "watts": current * volts, "rise_scale": volts * volts}


def projected(unit_power: Column, point: str) -> dict[str, Column]:
    return calibrated(unit_power, operating_point(point))


@dataclass(frozen=True)
class Surroundings:
    """Heat transfer at the top, the bottom held, and side walls without or with transfer, or held."""

    ambient: float = 300.0
    top: float = 10.0
    lateral: str = "adiabatic"
    lateral_transfer: float = 0.0

    def __post_init__(self):
        if self.lateral not in ("adiabatic", "isothermal", "transfer") or (self.lateral == "transfer") != (self.lateral_transfer > 0) or not self.top > 0 or not self.ambient > 0:
            raise ContractError("thermal surroundings out of their bounds")


@dataclass(frozen=True)
class MeshAdmission:
    """Bounds of a mesh's quality."""

    least_ratio: float = 0.05
    region_volume: float = 1e-4
    whole_volume: float = 1e-10


def mesh_report(mesh: Mesh, regions: DataFrame, expected: DataFrame, policy: MeshAdmission = MeshAdmission()) -> DataFrame:
    """(region, cells, volume, error, least, p1, median, ok) of regions(cell_id, region) against expected(region, volume)."""
    from meshloom.functions import elements as el

    from .mesh import geometry

    g = geometry(mesh)
    g = g.withColumn("ratio", el.mean_ratio(g)).join(regions, "cell_id")
    out = g.groupBy("region").agg(F.count("*").alias("cells"), F.sum("volume").alias("volume"), F.min("ratio").alias("least"), F.percentile("ratio", F.lit(0.01)).alias("p1"), F.percentile("ratio", F.lit(0.5)).alias("median"))
    out = out.join(expected.withColumnRenamed("volume", "wanted"), "region").withColumn("error", F.abs(F.col("volume") / F.col("wanted") - 1))
    return out.withColumn("ok", (F.col("least") >= policy.least_ratio) & (F.col("error") <= policy.region_volume)).drop("wanted")


def forward_plan(mesh: Mesh, regions: DataFrame, materials: DataFrame, terminals: tuple[DataFrame, DataFrame], around: Surroundings = Surroundings(), volts: float = 1.0) -> Plan:
    """The electrothermal plan of a meshed ring: regions(cell_id, region), materials(region, k, sigma or null); the first
    terminal (nodes) is at ``volts``, the second grounded; the lowest plane is held at the ambient temperature."""
    low, high = mesh.nodes.agg(F.min("z"), F.max("z")).first()
    cells = regions.join(F.broadcast(materials), "region")
    conductor = cells.where("sigma IS NOT NULL").select("cell_id", F.col("cell_id").alias("parent_cell_id"), "sigma")
    one, other = terminals
    if one.select("node_id").intersect(other.select("node_id")).limit(1).count():
        raise ContractError("terminals share a node")
    potential = one.select("node_id", F.lit(float(volts)).alias("value")).unionByName(other.select("node_id", F.lit(0.0).alias("value")))
    held = mesh.nodes.where(F.abs(F.col("z") - low) < 1e-12).select("node_id")
    faces = faces_at(mesh, "z", high).select("facet_id", "nodes", F.lit(around.top).alias("h"))
    if around.lateral != "adiabatic":
        ends = mesh.nodes.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in ("x", "y") for f in (F.min, F.max)]).first()
        if around.lateral == "isothermal":
            side = mesh.nodes.where((F.col("x") == ends.min_x) | (F.col("x") == ends.max_x) | (F.col("y") == ends.min_y) | (F.col("y") == ends.max_y))
            held = held.union(side.select("node_id")).distinct()
        else:
            for a in ("x", "y"):
                for v in (ends[f"min_{a}"], ends[f"max_{a}"]):
                    faces = faces.unionByName(faces_at(mesh, a, v).select("facet_id", "nodes", F.lit(around.lateral_transfer).alias("h")))
    robin = faces.withColumn("ambient", F.lit(around.ambient))
    temperature = held.withColumn("value", F.lit(around.ambient))
    return prepare(Plan(mesh, conductor, cells.select("cell_id", "k", F.lit(0.0).alias("q")), potential, temperature, robin))


def sensitivity_plan(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds to each case(width_um, depth_um, lateral, axis) its rise per milliwatt and the ratio to the baseline, of
    runs(width_um, depth_um, lateral, watts, rise); a case without a run is an error."""
    rows = cases.join(runs, ["width_um", "depth_um", "lateral"], "left")
    per = F.when(F.col("watts") > 0, F.col("rise") / (F.col("watts") * 1e3)).otherwise(F.raise_error(F.lit("a case has no run")).cast("double"))
    rows = rows.withColumn("k_per_mw", per)
    base = rows.where("axis = 'baseline'").select(F.col("k_per_mw").alias("base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("ratio", F.col("k_per_mw") / F.col("base")).drop("base")
