"""Predicate compiler (P1-P4) and clause slots (P10).

A predicate list is a sequence of ``(column, value)`` pairs, optionally with
a parallel list of negation flags:

* ``None`` (or the text ``'Null'``) -> ``IS NULL`` / ``IS NOT NULL``
* a list or tuple -> ``IN`` / ``NOT IN``; an empty list drops the predicate
* anything else -> ``=`` / ``!=``

All pairs are AND-ed. The result is one Column, so Catalyst can push it into
the Parquet scan like any hand-written filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TEXT = "Null"


def _is_null_value(value: Any) -> bool:
    return value is None or (isinstance(value, str) and value == NULL_TEXT)


def compile_predicate(column: str, value: Any, negate: bool = False) -> Column | None:
    col = F.col(column)
    if _is_null_value(value):
        return col.isNotNull() if negate else col.isNull()
    if isinstance(value, (list, tuple, set, frozenset)):
        values = list(value)
        if not values:
            return None
        member = col.isin(values)
        return ~member if negate else member
    return (col != F.lit(value)) if negate else (col == F.lit(value))


def where(pairs: Sequence[tuple[str, Any]] | dict[str, Any],
          negate: Sequence[bool] | None = None) -> Column:
    """Conjunction of the compiled predicates (``lit(True)`` when none remain)."""
    items = list(pairs.items()) if isinstance(pairs, dict) else list(pairs)
    flags = list(negate) if negate is not None else [False] * len(items)
    if len(flags) != len(items):
        raise ValueError("negate must have one flag per predicate")
    parts = [p for (c, v), n in zip(items, flags)
             if (p := compile_predicate(c, v, n)) is not None]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b, parts)


def filter_rows(df: DataFrame, pairs, negate=None) -> DataFrame:
    """P1-P4 applied to a DataFrame."""
    return df.filter(where(pairs, negate))


def project(df: DataFrame, columns: Iterable[str], distinct: bool = False) -> DataFrame:
    """Projection of named columns, optionally distinct."""
    out = df.select(*columns)
    return out.distinct() if distinct else out


def exclude(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """P9 with a literal exclusion list (``~isin``; empty list keeps all)."""
    return filter_rows(df, [(column, list(values))], [True])


def apply_slots(df: DataFrame, group_by: Sequence[str] | None = None,
                aggregations: Sequence[Column] | None = None,
                order_by: Sequence[Column | str] | None = None,
                limit: int | None = None) -> DataFrame:
    """P10: the optional GROUP BY / ORDER BY / LIMIT clauses of a lookup."""
    out = df
    if group_by:
        out = out.groupBy(*group_by).agg(*(aggregations or [F.count(F.lit(1)).alias("n")]))
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out
