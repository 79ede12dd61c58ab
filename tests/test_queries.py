"""Every registered query of the plans against its SQL, on the smallest test data."""

from __future__ import annotations

import pytest

from tests.compare import difference
from tidemark.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    assert difference(queries()[name](spark, DATA), oracle_sql()[name], DATA) is None


def test_scores_are_probabilities(spark):
    rows = queries()["logistic_scores"](spark, DATA).collect()
    assert rows and all(0 <= r["score"] <= 1 for r in rows)


def test_logistic_scores_compute_the_rows_once(spark):
    from __spark_entry__ import queries

    plan = queries()["logistic_scores"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
