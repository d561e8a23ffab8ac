import pytest
from compare_rows import normal

from tidemark.plans import detection, exact, market, routes, streams, venues  # noqa: F401  they register with market


@pytest.mark.parametrize("name", sorted(market.QUERIES))
def test_equals_sql(spark, sf, duck, name):
    got, want = market.QUERIES[name](spark, sf).toPandas(), duck.sql(market.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(market.QUERIES) <= set(__spark_entry__.queries())
