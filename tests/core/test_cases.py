import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import cases, mesh, tables
from meshloom.plans import registry

registry.queries()


@pytest.mark.parametrize("name", ["layered_heat", "cell_heat"])
def test_cases_of_a_small_mesh_write_no_tables(spark, sf, monkeypatch, name):
    """Before, entries of all cases' matrices were written five times and shuffled: what filled the disk."""

    def write(self, name, df):
        raise AssertionError(f"{name} is written")

    monkeypatch.setattr(tables.Tables, "write", write)
    out = registry.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert out.count() == con.execute(f"select count(*) from ({registry.SQL[name]})").fetchone()[0]


def test_cases_without_a_solution_are_nan_and_leave_the_others(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, None), (4, -1.0), (5, float("inf"))], "case_id int, k double")
    held = lambda x, y: F.lit(1.0) if x == 0 else F.lit(3.0) if x == 1 else None
    out = cases.heat(mesh.unit_square(spark, 4), rows, lambda cell: F.col("k") + 0 * cell, F.lit(0.0), held).collect()
    assert len(out) == 5 * 15
    for r in out:
        assert abs(r.u - 1 - r.node_id % 5 / 2) < 1e-12 and abs(r.ku - r.f) < 1e-12 if r.case_id == 1 else np.isnan(r.u)
