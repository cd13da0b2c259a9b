"""Queries whose job once was made smaller do all of it."""

import duckdb

from meshloom.plans import registry

registry.queries()


def test_port_shifts_cover_the_first_eight(spark, sf):
    """The eight shifts that the query began with, and every other nation's."""
    con = duckdb.connect()
    con.execute(f"create view nation as select * from '{sf}/nation.parquet'")
    cases = {r[0] for r in con.execute(registry.SQL["port_shift_solve"]).fetchall()}
    assert set(range(8)) <= cases
    out = registry.QUERIES["port_shift_solve"](spark, sf).collect()
    assert {r.case_id for r in out} == cases and all(r.solved and r.plain and r.inverted for r in out)


def test_source_cotangent_has_the_whole_mesh(spark, sf):
    """Every cell of the mesh that grows with the parts, not of one with a power of two of intervals, halved."""
    n = registry.sized(spark, sf)
    row = registry.QUERIES["source_cotangent"](spark, sf).first()
    assert (row.cells, row.ratio) == (2 * n * n, 1.0)
