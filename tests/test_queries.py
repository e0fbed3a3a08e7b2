import pytest

from spanwise.plans import queries as q
from tests.oracle import same

NAMES = sorted(q.queries())


def test_every_query_has_sql():
    assert set(q.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, small, name):
    same(spark, small, q.queries()[name], q.oracle_sql()[name])
