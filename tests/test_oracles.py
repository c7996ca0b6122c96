"""Every core query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import importlib

import pytest

from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"tessera.plans.{x}") for x in ("trial_queries", "join_queries", "window_queries", "aggregate_queries", "model_queries", "source_queries", "numeric_sql")]
SQL = {n: sql for m in MODULES for n, sql in m.SQL.items()}
QUERIES = {n: (q, SQL.get(n)) for m in MODULES for n, q in m.Q.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, con, name):
    assert_same(spark, con, *QUERIES[name], SF)


def test_queries_without_sql_have_values_to_meet():
    """What SQL can't say is compared with a plain numpy version by value."""
    from tests.test_plain import PLAIN

    assert {n for n, (_, sql) in QUERIES.items() if not sql} == set(PLAIN)
