"""Lookups, existence tests, listings and per-key picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehook.schemas import MISSING_ID


def name_to_id(requests: DataFrame, request_col: str, dim: DataFrame, key_col: str,
               value_col: str, out_col: str, one_result: bool = True,
               sentinel=MISSING_ID) -> DataFrame:
    """Resolve ``requests[request_col]`` through ``dim`` (``key_col`` ->
    ``value_col``), for name->id or id->name alike.

    ``one_result`` keeps one answer per key (the smallest value, i.e. a
    deterministic "first") and fills misses with ``sentinel``; otherwise every
    match is returned and misses get NULL. The dimension is reduced to one row
    per key before the join (partial aggregation, so a repeated name cannot
    fan out the request side). Whether the reduced side is broadcast is left to
    the planner, which knows its size in bytes.
    """
    if one_result:
        d = dim.groupBy(F.col(key_col).alias("__k")).agg(F.min(value_col).alias("__v"))
    else:
        d = dim.select(F.col(key_col).alias("__k"), F.col(value_col).alias("__v"))
    joined = requests.join(d, requests[request_col] == d["__k"], "left").drop("__k")
    value = F.coalesce(F.col("__v"), F.lit(sentinel)) if (one_result and sentinel is not None) \
        else F.col("__v")
    return joined.withColumn(out_col, value).drop("__v")


def resolve_owned(requests: DataFrame, catalog: DataFrame, keys: Sequence[tuple[str, str]],
                  found_col: str = "found") -> DataFrame:
    """Resolve a request only when every ownership key matches.

    One left join on the composite key: matched rows carry the catalog
    columns, misses carry NULLs and ``found = false`` (the "not found"
    answer), so found and missing requests need no second join. A
    composite key held by several catalog rows resolves to one of them
    (deterministically).
    """
    from lakehook.operators.mutate import one_per_key

    # one catalog row per composite key (grouped on the join keys, so the
    # join reuses that partitioning): a request is never duplicated
    marker = one_per_key(catalog, [c for _, c in keys]).withColumn("__hit", F.lit(True))
    cond = [requests[r] == marker[c] for r, c in keys]
    out = requests.join(marker, cond, "left")
    out = out.drop(*[marker[c] for _, c in keys])
    return out.withColumn(found_col, F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


def has_row(df: DataFrame, condition: Column) -> bool:
    """P7 for a single key: does any row satisfy ``condition``?
    ``limit(1)`` lets every task stop at its first match."""
    return df.filter(condition).limit(1).count() > 0


def exists_in(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows of ``df`` with a match in ``other`` (SQL EXISTS / IN)."""
    return df.join(other, on, "left_semi")


def not_exists_in(df: DataFrame, other: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows of ``df`` without a match in ``other`` (NOT EXISTS)."""
    return df.join(other, on, "left_anti")


def list_members(df: DataFrame, owner_col: str, owner_value, member_col: str,
                 exclude: Sequence | None = None) -> DataFrame:
    """P8 (+P9): names held by one owner, minus an exclusion list."""
    out = df.filter(F.col(owner_col) == F.lit(owner_value))
    if exclude:
        out = out.filter(~F.col(member_col).isin(list(exclude)))
    return out.select(member_col)


def count_per_key(df: DataFrame, key: str | Sequence[str], out_col: str = "n") -> DataFrame:
    """A1: row count per key (partial counts are combined map-side)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out_col))


def first_per_key(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str],
                  payload: Sequence[str] | None = None) -> DataFrame:
    """A2: the first row of every key under an explicit ascending order.

    Written as ``min(struct(order..., payload...))`` rather than
    ``row_number() == 1``: the aggregate is combined inside each map task, so a
    key holding a large share of all rows never has to be sorted in one task.
    Spark plans aggregates over structs sort-based: each task sorts its own
    rows (spillable) and ships one row per key -- cheaper than a hash
    aggregate of the order column followed by a join of the full table back
    to it. NULLs in order columns sort first, as in Spark's default
    ascending order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (payload if payload is not None else df.columns)
            if c not in keys and c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in list(order_by) + rest])
