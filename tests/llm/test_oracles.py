import pytest

from revcast.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import oracle_rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_duckdb(spark, name):
    names, want = oracle_rows(ORACLE[name], SF_SMALL)
    frame = QUERIES[name](spark, SF_SMALL)
    assert sorted(frame.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
