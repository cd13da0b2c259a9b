import duckdb
import pytest
from pyspark.sql import functions as F

from meshloom.llm import mixing
from meshloom.llm.common import Scratch


@pytest.mark.parametrize("keep", [0.75, 0.3])
def test_equals_sql(spark, sf, keep):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, "src1", 0), (9002, "w " * 90_000, "en", None, 180_000), (9002, "w " * 90_000, "en", None, 180_000)], docs.schema)
    docs = docs.unionByName(extra)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    out = mixing.mixed(docs, keep=keep).select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_probability", 6).alias("probability"))
    want = con.execute(mixing.mixing_sql(keep=keep)).fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_marginals_and_budget_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.with_cells(docs)
    names = list(mixing.TARGETS)
    cells = rows.where("mix_tokens > 0").groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"))
    scratch = Scratch(spark, "test-mixing")
    weighted = scratch.write("w", mixing.raked(cells, scratch))
    pdf = weighted.toPandas()
    for name, power in mixing.TARGETS.items():
        observed = pdf.groupby(name).tokens.sum().astype(float) ** power
        assert abs(pdf.groupby(name).w.sum() - observed / observed.sum()).max() < 1e-6
    p = mixing.probabilities(weighted).toPandas()
    assert (p.tokens * p.probability).sum() == pytest.approx(mixing.KEEP * p.tokens.sum(), rel=1e-9)
    kept = mixing.mixed(docs)
    assert kept.agg(F.sum("mix_tokens")).first()[0] / p.tokens.sum() == pytest.approx(mixing.KEEP, abs=0.03)


def test_native_plan_and_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.withColumn("tokens", F.lit("x")).withColumn("w", F.lit(1))).count() > 0


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "mix_source string, mix_lang string, mix_topic string, tokens long")


def test_slow_marginals_are_met(spark):
    """A nearly diagonal table, whose marginals take some 100 rounds."""
    rows = [(f"s{i}", f"l{j}", "t", 3 + i if i == j else 1) for i in range(4) for j in range(4)]
    rows = [(a, b, "u" if (a[1], b[1]) in ("01", "10", "23") else t, 10**4 * n if n > 1 else n) for a, b, t, n in rows]
    targets = {"mix_source": 0.0, "mix_lang": 1.5, "mix_topic": 0.9}
    scratch = Scratch(spark, "test-mixing")
    errors = [mixing.raked(cells_of(spark, rows), scratch, targets, most=k).agg(F.max("error")).first()[0] for k in (4, mixing.MOST)]
    assert errors[0] > mixing.TOLERANCE >= errors[1]  # 16 rounds aren't enough


def test_contradicting_targets_are_reported(spark):
    rows = [("a", "x", "t", 90), ("b", "y", "t", 10)]  # source and language are the same, their targets aren't
    out = mixing.raked(cells_of(spark, rows), Scratch(spark, "test-mixing"), {"mix_source": 0.0, "mix_lang": 1.0, "mix_topic": 1.0}).collect()
    assert all(r.error == pytest.approx(0.4) for r in out)
    docs = spark.createDataFrame([(i, "w " * (90 if i % 2 else 10), "xy"[i % 2], "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string, source string")
    kept = mixing.mixed(docs, {"mix_source": 0.0, "mix_lang": 1.0, "mix_topic": 1.0}).collect()
    assert kept and all(r.mix_error == pytest.approx(0.4) for r in kept)
