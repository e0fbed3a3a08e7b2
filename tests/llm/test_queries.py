import pytest

from spanwise.llm import queries as q
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, small, name):
    same(spark, small, q.queries()[name], q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_runs(spark, small, name):
    assert q.queries()[name](spark, small).count() >= 0
