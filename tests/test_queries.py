import pytest
from oracle import DATA, both

from lodestone.plans import catalogue, registry  # noqa: F401

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_the_oracle(spark, name):
    own, want = both(spark, QUERIES[name], SQL[name])
    assert own[0] == want[0]
    assert own[1] == want[1]


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
