"""Meshes aren't collected on the driver to be broadcast, whatever Spark takes their size for."""

import re

import pytest

from meshloom.operators import krylov
from meshloom.plans import partitions, registry, solvers

registry.queries()


def test_parts_of_a_mesh_are_joined_by_shuffles(spark, sf, monkeypatch):
    """Before, 27 broadcasts of a plan held whole node tables and corners of cells."""
    plans = []
    write = partitions.Tables.write

    def seen(self, name, df):
        if name == "ghost_reduction":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, name, df)

    monkeypatch.setattr(partitions.Tables, "write", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    registry.QUERIES["ghost_reduction"](spark, sf)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold


class Enough(Exception):
    pass


def test_levels_of_a_multilevel_step_are_joined_by_shuffles(spark, monkeypatch):
    """Before, every step broadcast the transfers and diagonals of all levels, which added up on the driver."""
    plans = []
    write = krylov.Tables.write

    def seen(self, name, df):
        if re.fullmatch(r"\d+-\d+|[pk]\d*", name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        if name == "0-1":  # later steps have the same joins
            raise Enough
        return write(self, name, df)

    monkeypatch.setattr(krylov.Tables, "write", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Enough):
        solvers.multilevel_solution(spark, 8, 50.0)
    assert len(plans) == 5 and not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold


def test_rounds_of_a_coupled_problem_are_joined_by_shuffles(spark, sf, monkeypatch):
    """Before, states and corners of all cases were broadcast: files of some MB, whose equal and empty columns take no room,
    of millions of rows."""
    plans = []
    write = krylov.Tables.write

    def seen(self, name, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(self, name, df)
        if name == "state-1":  # later rounds have the same joins
            raise Enough
        return out

    monkeypatch.setattr(krylov.Tables, "write", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Enough):
        registry.QUERIES["coupled_tables"](spark, sf)
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold
