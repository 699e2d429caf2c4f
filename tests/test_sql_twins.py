"""Every registered query against its SQL twin on the smallest tables, and the operators it must not use."""

import pytest
from check import difference, twin_tables
from conftest import SMALL

from __spark_entry__ import entry
from tallyhouse.plans import QUERIES


# all pairs of two tables, and batches handed to Python
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def twin():
    return twin_tables(SMALL)


def test_every_query_has_a_twin():
    assert not [name for name, query in QUERIES.items() if query.sql is None]


# the replay of status events composes state maps in Arrow batches; what is made of it carries that step
REPLAYED = {
    "status_history", "status_history_long", "status_changes", "final_states", "inventory_movements", "inventory_position",
    "payment_requests", "notification_outbox", "enrich_notifications",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, twin, name):
    df = QUERIES[name](spark, SMALL)
    if not name.startswith("stream_"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [operator for operator in FORBIDDEN if operator in plan and not (operator == "InArrow" and name in REPLAYED)]
    assert difference(df, twin, name) is None


def test_entry(spark):
    assert entry(spark).count() == 25
