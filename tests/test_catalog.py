"""Every query with an oracle equals DuckDB; the others run and give rows."""

import pytest

from framelight import catalog
from tests.compare import assert_same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
