"""Checked nodal tables from text, solver logs, decks and checkpoints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.mesh import ContractError, Mesh


def nodal_fields(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """(name, node_id, value) of a text with lines "name node value" (nodes from 1). Every field must list each node
    once, so that its node numbers are a permutation."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = rows.select(F.col("p")[0].alias("name"), (F.col("p")[1].cast("long") - 1).alias("node_id"), F.col("p")[2].cast("double").alias("value"))
    bad = rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("d"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"), F.count("value").alias("v"))
    if bad.where((F.col("n") != nodes) | (F.col("d") != nodes) | (F.col("lo") != 0) | (F.col("hi") != nodes - 1) | (F.col("v") != nodes)).limit(1).count():
        raise ContractError("a field does not list every node once")
    return rows


def consistent(records: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated records must agree: one row per key, or an error."""
    out = records.groupBy(*keys).agg(F.min("value").alias("value"), F.max("value").alias("other"))
    return out.withColumn("value", F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(F.raise_error(F.lit("repeated records differ")).cast("double"))).drop("other")


def last_change(lines: DataFrame, equation: str) -> DataFrame:
    """(norm, change) of the last record of an equation in a solver log(line_no, value)."""
    number = r"([-+0-9.Ee]+)"
    pattern = rf"NRM,RELC\)\s*:?\s*\(\s*{number}\s+{number}\s*\)\s*::\s*{re.escape(equation)}"
    hits = lines.select("line_no", F.regexp_extract("value", pattern, 1).alias("norm"), F.regexp_extract("value", pattern, 2).alias("change")).where("norm <> ''")
    return hits.agg(F.max_by(F.struct("norm", "change"), "line_no").alias("r")).select(F.col("r.norm").cast("double").alias("norm"), F.col("r.change").cast("double").alias("change"))


def deck_lines(mesh: Mesh, bodies: DataFrame) -> dict[str, DataFrame]:
    """Ordered text lines (line_no, value) of a triangle or tetrahedron deck: header, nodes, elements, boundary;
    bodies(cell_id, body). Numbers start at 1."""
    from meshloom.operators.contracts import facet_cells

    kind, rim = (504, 303) if mesh.corners == 4 else (303, 202)
    third = F.col("z") if mesh.corners == 4 else F.lit(0.0)
    text = lambda c: F.transform(c, lambda n: (n + 1).cast("string"))
    nodes = mesh.nodes.select(F.col("node_id").alias("line_no"), F.concat_ws(" ", (F.col("node_id") + 1).cast("string"), F.lit("-1"), F.col("x").cast("string"), F.col("y").cast("string"), third.cast("string")).alias("value"))
    elements = mesh.cells.join(bodies, "cell_id").select(F.col("cell_id").alias("line_no"), F.concat_ws(" ", (F.col("cell_id") + 1).cast("string"), F.col("body").cast("string"), F.lit(str(kind)), text("nodes")).alias("value"))
    facets = mesh.facets.join(facet_cells(mesh), "facet_id").select(F.col("facet_id").alias("line_no"), F.concat_ws(" ", (F.col("facet_id") + 1).cast("string"), F.lit("1"), (F.col("cell_id") + 1).cast("string"), F.lit("0"), F.lit(str(rim)), text("nodes")).alias("value"))
    counts = mesh.nodes.agg(F.count("*").alias("n")).crossJoin(mesh.cells.agg(F.count("*").alias("c"))).crossJoin(mesh.facets.agg(F.count("*").alias("f")))
    header = counts.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "n", "c", "f").alias("value"))
    return {"header": header, "nodes": nodes, "elements": elements, "boundary": facets}


def write_checkpoint(state: DataFrame, path: str, source: str, config: str) -> None:
    """State by owner, never over an existing checkpoint, with the digests that a restore must match."""
    state.withColumns({"source": F.lit(source), "config": F.lit(config)}).write.mode("errorifexists").partitionBy("owner").parquet(path)


def restore_checkpoint(spark: SparkSession, path: str, source: str, config: str, owners: int) -> DataFrame:
    state = spark.read.parquet(path)
    other = state.where((F.col("source") != source) | (F.col("config") != config)).limit(1).count()
    if other or state.select("owner").distinct().count() != owners:
        raise ContractError("the checkpoint is of another source, configuration or topology")
    return state.drop("source", "config")
