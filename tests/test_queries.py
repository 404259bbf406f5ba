"""Every registered query of the reference's operators against its SQL."""

import pytest

from logweave import lineage_queries, queries
from tests.compare import duck_rows, spark_rows

ALL = {**queries.queries(), **lineage_queries.QUERIES}
SQL = {**queries.oracle_sql(), **lineage_queries.SQL}


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_sql(spark, sf, name):
    names, rows = spark_rows(ALL[name](spark, sf))
    assert rows == duck_rows(SQL[name], sf, names)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["action"] for r in e.entry(spark).collect()} == {"ALLOW", "BLOCK", "UNKNOWN_ACTION"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_only_what_is_needed(spark, sf):
    plan = queries.route_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan and "props" not in plan.split("ReadSchema")[1]
    assert "Python" not in plan and "BatchEval" not in plan
