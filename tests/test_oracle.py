"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import decimal
import math

import pytest

import __spark_entry__ as E
from lakehook.plans import acceptance, oracle
from tests.conftest import SMOKE_DIR

QUERIES = acceptance.QUERIES
ORACLES = oracle.ORACLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMOKE_DIR)
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_names)
    assert _rows(sdf.columns, s_rows) == _rows(d_names, d_rows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["log_id", "user_id", "node_id", "transform_id", "out_node_id"]
    assert df.count() == 17

