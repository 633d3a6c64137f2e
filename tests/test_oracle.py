"""Every query with an oracle statement matches DuckDB exactly on sf0.001."""

import pytest

from revcast import plans
from revcast.plans.check import compare, duckdb_connection

from .conftest import SF_SMALL

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duckdb_connection(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_duckdb(spark, name):
    r = compare(spark, SF_SMALL, name, _con())
    assert r["status"] == "OK", r


def test_every_query_has_a_docstring_or_oracle():
    for name, fn in plans.QUERIES.items():
        assert name in plans.ORACLE or fn.__doc__, name
