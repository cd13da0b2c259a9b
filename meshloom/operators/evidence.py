"""Evidence: process-set roll-ups, checks and manifests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(records: DataFrame, processes: int) -> DataFrame:
    """One row: ordinals, median and maximum over ordinals of the slowest process, and whether every ordinal has every
    process; records(process, ordinal, value). Values meet as maxima per process first."""
    each = records.groupBy("process", "ordinal").agg(F.max("value").alias("v"))
    path = each.groupBy("ordinal").agg(F.max("v").alias("path"), F.count("*").alias("n"))
    return path.agg(F.count("*").alias("ordinals"), F.median("path").alias("median_path"), F.max("path").alias("worst"), F.bool_and(F.col("n") == processes).alias("complete"))


def publishable(checks: DataFrame) -> DataFrame:
    """One row: publishable if every required check passed; checks(name, required, passed)."""
    return checks.agg(F.bool_and(~F.col("required") | F.col("passed")).alias("publishable"), F.count("*").alias("checks"))


def canonical(value) -> str:
    """Sorted, compact JSON."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Kind:
    """What a set of process records of one sort must show: greatest value of each metric, the executables that were timed,
    and timed runs of each."""

    limits: dict[str, float]
    executables: tuple[str, ...]
    runs: int = 5


#: Greatest admitted values by sort of evidence.
KINDS = {
    "scalar_h1": Kind({"solution_relative_difference": 4e-4, "rhs_relative_difference": 2e-6, "vjp_relative_difference": 2e-3, "host_precision_relative_difference": 2e-3}, ("current_forward", "current_vjp", "heat_forward", "heat_vjp")),
    "scalar_h1_multilevel": Kind({"solution_relative_difference": 4e-4, "coarse_symmetry_error": 2e-6, "coarse_condition_number": 1e8}, ("forward", "vjp")),
    "collective": Kind({"matvec_relative_difference": 2e-5, "vjp_relative_difference": 2e-5}, ("matvec", "vjp")),
    "distributed_electrothermal": Kind(
        {"potential_relative_difference": 5e-4, "temperature_relative_difference": 2e-4, "gradient_relative_difference": 5e-3, "native_explicit_gradient_relative_difference": 1e-3, "objective_relative_difference": 5e-4, "transfer_relative_error": 2e-5},
        ("forward", "explicit_vjp", "native_reverse"),
    ),
    "thermo_optic": Kind(
        {"potential_relative_difference": 5e-4, "temperature_relative_difference": 2e-4, "parameter_relative_difference": 2e-4, "material_relative_difference": 2e-4, "finite_difference_relative_error": 2e-2, "transfer_relative_error": 2e-5},
        ("reference_phasor", "forward", "explicit_vjp", "native_reverse"),
    ),
    "mode_source": Kind({"source_relative_l2_error": 2e-5}, ("run",)),
    "waveguide_source": Kind({"source_relative_l2_error": 2e-5, "downstream_relative_l2_error": 2e-5}, ("native", "imported")),
    "ring_heater": Kind(
        {"charge_balance_relative_error": 2e-4, "electrical_energy_relative_error": 2e-4, "joule_transfer_relative_error": 2e-6, "thermal_balance_relative_error": 2e-4, "potential_relative_l2_difference": 1e-3, "temperature_rise_relative_l2_difference": 1e-3},
        ("forward",),
        runs=1,
    ),
}


def process_set(records: DataFrame, partitions: DataFrame, processes: int, devices: int) -> DataFrame:
    """One row of checks: records(process, worker, identity) are of every process 0 .. n - 1 once, of as many workers, with
    one identity; partitions(process, device) cover every device once."""
    own = records.agg(
        F.count("*").alias("n"), F.countDistinct("process").alias("d"), F.min("process").alias("lo"), F.max("process").alias("hi"), F.countDistinct("worker").alias("w"), F.countDistinct("identity").alias("ids")
    )
    cover = partitions.agg(F.count("*").alias("c"), F.countDistinct("device").alias("cd"), F.min("device").alias("clo"), F.max("device").alias("chi"))
    complete = (F.col("n") == processes) & (F.col("d") == processes) & (F.col("lo") == 0) & (F.col("hi") == processes - 1) & (F.col("w") == processes)
    once = (F.col("c") == devices) & (F.col("cd") == devices) & (F.col("clo") == 0) & (F.col("chi") == devices - 1)
    return own.crossJoin(cover).select(complete.alias("complete"), (F.col("ids") == 1).alias("one_identity"), once.alias("covered_once"))


def worst_metrics(metrics: DataFrame, kind: str) -> DataFrame:
    """(metric, worst, most, ok) of metrics(process, metric, value): the greatest over processes against its limit; a metric
    that a limit names and no process tells isn't ok."""
    limits = metrics.sparkSession.createDataFrame(list(KINDS[kind].limits.items()), "metric string, most double")
    worst = metrics.groupBy("metric").agg(F.max("value").alias("worst"), F.max(F.isnan("value").cast("int")).alias("bad"))
    out = limits.join(worst, "metric", "left")
    return out.select("metric", "worst", "most", F.coalesce((F.col("worst") <= F.col("most")) & (F.col("bad") == 0), F.lit(False)).alias("ok"))


def critical_paths(seconds: DataFrame, kind: str) -> DataFrame:
    """(executable, runs, least, median, most, ok) of seconds(process, executable, ordinal, value): the slowest process of
    each run, then over runs; the executables and the number of runs must be those of the sort."""
    want = KINDS[kind]
    slow = seconds.groupBy("executable", "ordinal").agg(F.max("value").alias("v"))
    found = slow.groupBy("executable").agg(F.count("*").alias("runs"), F.min("v").alias("least"), F.median("v").alias("median"), F.max("v").alias("most"))
    names = seconds.sparkSession.createDataFrame([(n,) for n in want.executables], "executable string")
    out = names.join(found, "executable", "full")
    known = F.col("executable").isin(*want.executables)
    return out.withColumn("ok", F.coalesce(known & (F.col("runs") == want.runs), F.lit(False)))


def aggregated(kind: str, records: DataFrame, partitions: DataFrame, metrics: DataFrame, seconds: DataFrame, processes: int, devices: int) -> DataFrame:
    """(section, name, value, ok): the whole verdict on a set of process records; every step sums in tasks before it shuffles,
    so the records may be many."""
    checks = process_set(records, partitions, processes, devices)
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in ("complete", "one_identity", "covered_once")])
    out = checks.select(F.inline(named)).select(F.lit("set").alias("section"), "name", F.lit(None).cast("double").alias("value"), "ok")
    out = out.unionByName(worst_metrics(metrics, kind).select(F.lit("metric").alias("section"), F.col("metric").alias("name"), F.col("worst").alias("value"), "ok"))
    return out.unionByName(critical_paths(seconds, kind).select(F.lit("path").alias("section"), F.col("executable").alias("name"), F.col("median").alias("value"), "ok"))
