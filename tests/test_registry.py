"""Every registered query against its SQL, and plan rules they all keep."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks import compare, oracle, queries



@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(oracle.statements()) == set(queries.REGISTRY)
    assert set(queries.REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["category"] for r in rows] == ["mobile"] * 5 + ["tablet"] * 5
    assert rows[0]["change_pct"] <= rows[4]["change_pct"] and rows[5]["change_pct"] <= rows[9]["change_pct"]


def _keeps_plan_rules(plan: str) -> None:
    assert "Python" not in plan
    assert "CartesianProduct" not in plan
    # A window without a partition would pull its input into one task.
    for line in plan.splitlines():
        if "Window [" in line:
            assert not line.rstrip().endswith("], []"), line


@pytest.mark.parametrize("name", list(oracle.BODIES))
def test_against_sql_and_plan_rules(spark, connection, sf_dir, name):
    frame = queries.run(name, spark, sf_dir)
    _keeps_plan_rules(frame._jdf.queryExecution().executedPlan().toString())
    assert compare.difference(name, frame, connection) is None
