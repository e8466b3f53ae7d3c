"""Every registered query against DuckDB."""

import compare
import pytest

from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, connection, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert result.columns[:2] == ["customer_state", "product_category"]
    assert result.count() == 30
