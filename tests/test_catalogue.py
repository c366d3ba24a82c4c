"""Every query against its SQL in DuckDB."""

import pytest
from oracle import compare, data_dir

from docloom.catalogue import ORACLES, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    ours, theirs = compare(spark, QUERIES[name], ORACLES[name], data_dir("sf0.001"))
    assert ours == theirs
    assert ours or name == "wildcard_bare"
