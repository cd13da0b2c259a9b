"""Material catalogs: JSON and legacy XML become tables of properties; values are looked up and evaluated per row.

A catalog is a JSON object with ``id``, ``version``, ``sources`` (id, text) and ``materials`` (id, aliases, properties); a
property has id, unit, model (constant, sellmeier, table, reference), its numbers, the sources it cites, and the ranges of
temperature and wavelength that it holds in. Lookups are exact up to case and outer blanks; outside its ranges, or where a
range is given but the variable isn't, a property is an error.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.mesh import ContractError

MODELS = {"constant": {"value"}, "sellmeier": {"strength", "resonance_um"}, "table": {"at_k", "values"}, "reference": set()}
SCHEMA = "material string, property string, unit string, model string, value double, a array<double>, b array<double>, t_low double, t_high double, w_low double, w_high double"

#: Textbook constants of common materials, and the dispersion of fused silica.
BUILTIN = {
    "id": "meshloom",
    "version": "1",
    "sources": [{"id": "handbook", "text": "rounded textbook values near 300 K"}, {"id": "malitson", "text": "Malitson 1965, fused silica at 20 C"}],
    "materials": [
        {"id": "silicon", "aliases": ["Si"], "properties": [{"id": "thermal_conductivity", "unit": "W/(m K)", "model": "constant", "value": 148.0, "sources": ["handbook"]}]},
        {"id": "silica", "aliases": ["SiO2", "fused silica"], "properties": [{"id": "thermal_conductivity", "unit": "W/(m K)", "model": "constant", "value": 1.38, "sources": ["handbook"]}, {"id": "refractive_index", "unit": "1", "model": "sellmeier", "strength": [0.6961663, 0.4079426, 0.8974794], "resonance_um": [0.0684043, 0.1162414, 9.896161], "temperature_k": [293.15, 293.15], "wavelength_m": [0.21e-6, 3.71e-6], "sources": ["malitson"]}]},
        {"id": "titanium nitride", "aliases": ["TiN"], "properties": [{"id": "thermal_conductivity", "unit": "W/(m K)", "model": "constant", "value": 28.0, "sources": ["handbook"]}, {"id": "electrical_conductivity", "unit": "S/m", "model": "constant", "value": 2.3e6, "sources": ["handbook"]}]},
        {"id": "aluminium", "aliases": ["Al", "aluminum"], "properties": [{"id": "thermal_conductivity", "unit": "W/(m K)", "model": "constant", "value": 237.0, "sources": ["handbook"]}, {"id": "electrical_conductivity", "unit": "S/m", "model": "constant", "value": 37.73e6, "sources": ["handbook"]}]},
    ],
}


class Strict(json.JSONDecoder):
    """JSON whose objects have no key twice and whose numbers are finite."""

    def __init__(self):
        super().__init__(object_pairs_hook=self.of_pairs, parse_constant=self.refused)

    @staticmethod
    def of_pairs(pairs):
        keys = [k for k, _ in pairs]
        for k in keys:
            if keys.count(k) > 1:
                raise ContractError(f"key {k} stands twice")
        return dict(pairs)

    @staticmethod
    def refused(name):
        raise ContractError(f"{name} is no number here")


def fold(name: str) -> str:
    return name.strip().casefold()


def checked(catalog: dict) -> dict:
    """The catalog, or an error on repeated ids, shared names, unknown sources or models, or numbers that don't fit."""
    sources = [s["id"] for s in catalog["sources"]]
    if len(set(sources)) != len(sources):
        raise ContractError("source ids must be unique")
    owner: dict[str, str] = {}
    for m in catalog["materials"]:
        for name in (m["id"], *m.get("aliases", [])):
            if owner.setdefault(fold(name), m["id"]) != m["id"]:
                raise ContractError(f"two materials are called {name}")
        ids = [p["id"] for p in m["properties"]]
        if len(set(ids)) != len(ids) or sum(x["id"] == m["id"] for x in catalog["materials"]) != 1:
            raise ContractError(f"{m['id']}: ids must be unique")
        for p in m["properties"]:
            if p["model"] not in MODELS or not MODELS[p["model"]] <= set(p):
                raise ContractError(f"{m['id']}.{p['id']}: the model lacks its numbers")
            if set(p.get("sources", [])) - set(sources):
                raise ContractError(f"{m['id']}.{p['id']}: an unknown source")
            first, second = numbers(p)
            if first is not None and (len(first) != len(second) or not all(map(math.isfinite, [*first, *second]))):
                raise ContractError(f"{m['id']}.{p['id']}: lists of unequal length")
            if p["model"] == "table" and (len(first) < 2 or any(b <= a for a, b in zip(first, first[1:]))):
                raise ContractError(f"{m['id']}.{p['id']}: a table needs two rising points")
    return catalog


def numbers(p: dict) -> tuple:
    names = {"sellmeier": ("strength", "resonance_um"), "table": ("at_k", "values")}.get(p["model"])
    return tuple([float(x) for x in p[n]] for n in names) if names else (None, None)


def catalog_tables(spark: SparkSession, catalog: dict) -> tuple[DataFrame, DataFrame]:
    """names(name folded, material) and properties (SCHEMA)."""
    names = [(fold(n), m["id"]) for m in catalog["materials"] for n in {fold(x) for x in (m["id"], *m.get("aliases", []))}]
    rows = []
    for m in catalog["materials"]:
        for p in m["properties"]:
            t, w = p.get("temperature_k", [None, None]), p.get("wavelength_m", [None, None])
            rows.append((m["id"], p["id"], p["unit"], p["model"], p.get("value"), *numbers(p), *t, *w))
    return spark.createDataFrame(names, "name string, material string"), spark.createDataFrame(rows, SCHEMA)


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    text = spark.read.text(path, wholetext=True).first().value
    return catalog_tables(spark, checked(Strict().decode(text)))


def builtin_catalog(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return catalog_tables(spark, checked(BUILTIN))


def evaluated(wanted: DataFrame, names: DataFrame, properties: DataFrame) -> DataFrame:
    """Adds ``value`` to wanted(name, property, temperature_k, wavelength_m); unknown names or properties, reference models
    and variables outside a property's ranges are errors."""
    fail = lambda text: F.raise_error(F.concat(F.lit(text + ": "), F.col("name"))).cast("double")
    keyed = wanted.withColumn("_fold", F.lower(F.trim("name")))
    rows = keyed.join(F.broadcast(names.withColumnRenamed("name", "_fold")), "_fold", "left").join(F.broadcast(properties), ["material", "property"], "left")
    outside = lambda x, a, b: F.col(a).isNotNull() & (F.col(x).isNull() | ~F.col(x).between(F.col(a), F.col(b)))
    square = F.pow(F.col("wavelength_m") * 1e6, F.lit(2.0))
    terms = F.aggregate(F.zip_with("a", "b", lambda s, r: s * square / (square - r * r)), F.lit(1.0), lambda x, y: x + y)
    t = F.col("temperature_k")
    upper = F.aggregate("a", F.lit(0), lambda n, x: n + F.when(x <= t, 1).otherwise(0))
    upper = F.when(upper == F.size("a"), F.when(F.element_at("a", -1) == t, upper - 1)).otherwise(upper)
    lo = lambda c: F.element_at(c, upper)
    hi = lambda c: F.element_at(c, upper + 1)
    table = lo("b") + (t - lo("a")) / (hi("a") - lo("a")) * (hi("b") - lo("b"))
    value = (
        F.when(F.col("model").isNull(), fail("no such property"))
        .when(outside("temperature_k", "t_low", "t_high") | outside("wavelength_m", "w_low", "w_high"), fail("outside the range of validity"))
        .when(F.col("model") == "constant", F.col("value"))
        .when(F.col("model") == "sellmeier", F.when(terms > 0, F.sqrt(terms)).otherwise(fail("no real index")))
        .when((F.col("model") == "table") & (upper > 0), table)
        .otherwise(fail("nothing to evaluate, or outside of its table"))
    )
    return rows.select(*wanted.columns, "unit", value.alias("value"))


def legacy_materials(spark: SparkSession, path: str, selected: list[str] | None = None) -> DataFrame:
    """(material, parameter, raw, value) of an XML library: value is null where the text is no plain number; formulas are
    kept as text and never evaluated."""
    schema = "_name string, parameter array<struct<_name: string, _VALUE: string>>"
    rows = spark.read.format("xml").option("rowTag", "material").option("mode", "FAILFAST").schema(schema).load(path)
    rows = rows.select(F.trim("_name").alias("material"), F.explode_outer("parameter").alias("p")).select("material", F.trim("p._name").alias("parameter"), F.trim("p._VALUE").alias("raw"))
    found = rows.agg(F.count("*").alias("n"), F.countDistinct("material", "parameter").alias("d"), F.count(F.nullif("raw", F.lit(""))).alias("v")).first()
    if not found.n or not found.n == found.d == found.v:
        raise ContractError("materials or parameters are repeated, nameless or empty")
    if selected is not None:
        if len(set(selected)) != len(selected) or not selected:
            raise ContractError("selected materials must be named once")
        rows = rows.where(F.col("material").isin(*selected))
        if rows.select("material").distinct().count() != len(selected):
            raise ContractError("a selected material is missing")
    return rows.withColumn("value", F.expr("try_cast(raw AS double)")).withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))
