"""The operators that SQL can express, against DuckDB on the smallest tables."""

import pytest

from lakehook.llm import registry
from tests.conftest import SMOKE_DIR
from tests.test_oracle import _rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, rows) == _rows(names, cur.fetchall())
