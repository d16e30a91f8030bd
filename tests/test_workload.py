"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import pytest

from tests.conftest import SMALL
from workload import ORACLES, QUERIES
from workload.check import compare


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = compare(spark, SMALL, name)
    assert not result.startswith("FAIL"), result
    assert "types" not in result, result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"cache_refresh_stream", "keyed_refresh_stream", "validate_stream", "dead_letters", "conformance_windows"}))
def test_plan_has_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
