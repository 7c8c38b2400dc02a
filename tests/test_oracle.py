"""Every core query against independent SQL on the same tables."""

import pytest

from tidewell import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.SQL[name]))


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ts_ms", "value"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
