"""Every registered query with SQL equals DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from meshloom.plans import registry

registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([v.item() if hasattr(v, "item") else v for v in r]) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf, con, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def test_plans_have_no_python_and_no_cartesian_product(spark, sf):
    for name in ("p1_stiffness", "p1_load", "dirichlet_eliminate", "boundary_facets", "point_location", "thermo_optic"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
