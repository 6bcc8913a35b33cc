"""Property tests: compiled column expressions against plain-Python models."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lakehook.functions import predicates as P
from lakehook.functions import scalars as S


def _python_size(n: int) -> str:
    """The size text as Python formats it (the behaviour to reproduce)."""
    if n < 1024:
        return f"{n} bytes"
    if n < 1024 ** 2:
        return f"{n / 1024:.2f} KB"
    if n < 1024 ** 3:
        return f"{n / 1024 ** 2:.2f} MB"
    return f"{n / 1024 ** 3:.2f} GB"


# values around the rounding ties of every unit, plus arbitrary ones
_ties = st.builds(lambda unit, k, d: max(0, unit * k // 8 + d),
                  st.sampled_from([1024, 1024 ** 2, 1024 ** 3]),
                  st.integers(0, 8 * 1023), st.integers(-2, 2))
sizes = st.lists(st.one_of(st.integers(0, 1 << 42), _ties), min_size=1, max_size=200)


@settings(max_examples=15, deadline=None)
@given(sizes)
def test_human_size_matches_python_formatting(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r[0] for r in df.select(S.human_size("n")).collect()]
    assert got == [_python_size(n) for n in ns]


_values = st.one_of(st.none(), st.integers(-3, 3))
_pred = st.tuples(st.sampled_from(["a", "b"]),
                  st.one_of(_values, st.lists(st.integers(-3, 3), max_size=3)),
                  st.booleans())


def _python_where(row, preds):
    """SQL three-valued logic of the predicate list, row by row."""
    result = True
    for col, value, neg in preds:
        x = row[col]
        if value is None:
            r = (x is not None) if neg else (x is None)
        elif isinstance(value, list):
            if not value:
                continue
            r = None if x is None else ((x not in value) if neg else (x in value))
        else:
            r = None if x is None else ((x != value) if neg else (x == value))
        if r is False:
            return False
        if r is None:
            result = None
    return result is True


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(_values, _values), min_size=1, max_size=30),
       st.lists(_pred, min_size=1, max_size=4))
def test_predicate_compiler_matches_sql_semantics(spark, rows, preds):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a int, b int")
    cond = P.where([(c, v) for c, v, _ in preds], [n for _, _, n in preds])
    got = sorted(r[0] for r in df.filter(cond).select("id").collect())
    want = [i for i, (a, b) in enumerate(rows) if _python_where({"a": a, "b": b}, preds)]
    assert got == want
