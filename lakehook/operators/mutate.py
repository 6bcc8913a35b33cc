"""Snapshot-style table mutation.

Plain Parquet has no UPDATE, so each operator takes the current snapshot and
returns the next one as a DataFrame; the caller writes it to a new location
(never over the path being read). Joins are equi-joins on the table key: the
change side is usually small and AQE broadcasts it once measured; when it is
not, both sides shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_rows(base: DataFrame, new_rows: DataFrame) -> DataFrame:
    """M1: append rows (by column name; missing columns become NULL)."""
    return base.unionByName(new_rows, allowMissingColumns=True)


def one_per_key(df: DataFrame, keys: Sequence[str], rank: Sequence[str] = ()) -> DataFrame:
    """Reduce a change set to one row per key, deterministically: the row
    with the largest ``rank`` columns (then the largest remaining columns)
    wins. A grouped ``max(struct)``, combined map-side; unique keys pass
    through unchanged."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = [c for c in rank if c in rest] + [c for c in rest if c not in rank]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def _tag(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else f"{prefix}{c}") for c in df.columns])


def update_rows(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                assignments: dict[str, Column | str | object]) -> DataFrame:
    """M2: ``UPDATE base SET col = value WHERE key IN changes``.

    ``changes`` holds the keys of the rows to update (plus any columns the
    assignments refer to as ``new.<col>``). Each assignment is a Column over
    the change row's columns prefixed ``new_`` or a literal. Several changes
    for one key are reduced to one first (:func:`one_per_key`).
    """
    ch = _tag(one_per_key(changes, keys), "new_", keys).withColumn("__matched", F.lit(True))
    joined = base.join(ch, list(keys), "left")
    matched = F.coalesce(F.col("__matched"), F.lit(False))
    out = []
    for c in base.columns:
        if c in assignments:
            v = assignments[c]
            v = v if isinstance(v, Column) else F.lit(v)
            out.append(F.when(matched, v).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def patch_rows(base: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M6: only the non-NULL fields of a patch override the stored value.
    Several patches for one key are reduced to one first, so a stored row is
    never duplicated."""
    patch_cols = [c for c in patches.columns if c not in keys and c in base.columns]
    p = _tag(one_per_key(patches.select(*keys, *patch_cols), keys), "patch_", keys)
    joined = base.join(p, list(keys), "left")
    return joined.select(*[
        F.coalesce(F.col(f"patch_{c}"), F.col(c)).alias(c) if c in patch_cols else F.col(c)
        for c in base.columns
    ])


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str],
           bump: Sequence[str] = ("last_modified",)) -> DataFrame:
    """M3: insert incoming rows whose key is absent; for keys already present
    keep the stored row and only take the ``bump`` columns from the incoming
    one (re-uploading a file updates its modification time only).

    Several incoming rows for one key are reduced to the latest (largest
    ``bump`` values) first. Two joins with the incoming side, which the planner
    broadcasts when it is small: the catalog is then neither shuffled nor sorted.
    Applying it twice equals applying it once.
    """
    latest = one_per_key(incoming.select(*base.columns), keys, rank=list(bump))
    fresh = latest.select(*base.columns).join(base.select(*keys), list(keys), "left_anti")
    bumps = _tag(latest.select(*keys, *bump), "in_", keys).withColumn("__in", F.lit(True))
    joined = base.join(bumps, list(keys), "left")
    kept = joined.select(*[
        F.when(F.col("__in").isNotNull(), F.col(f"in_{c}")).otherwise(F.col(c)).alias(c)
        if c in bump else F.col(c) for c in base.columns])
    return kept.unionByName(fresh.select(*base.columns))


def delete_rows(base: DataFrame, doomed: DataFrame, keys: Sequence[str] | Column) -> DataFrame:
    """M4: remove rows whose key appears in ``doomed`` (anti join)."""
    return base.join(doomed, keys, "left_anti")


def cascade_delete(tables: Sequence[tuple[DataFrame, Sequence[str], Sequence[str]]],
                   doomed_root: DataFrame) -> list[DataFrame]:
    """ON DELETE CASCADE down a chain of parent -> child tables.

    ``tables`` lists ``(child, child_fk_cols, child_pk_cols)`` from the top of
    the chain down; ``doomed_root`` holds the deleted keys of the root parent,
    named like the first child's foreign key. Each level's deleted keys are the
    child rows matching the parent's deleted keys (semi join), which become the
    next level's doomed set; every child keeps only rows without a deleted
    parent (anti join). Returns the surviving child tables in order.
    """
    survivors = []
    doomed = doomed_root
    for child, fk, pk in tables:
        cond = [child[f] == doomed[d] for f, d in zip(fk, doomed.columns)]
        survivors.append(child.join(doomed, cond, "left_anti"))
        doomed = child.join(doomed, cond, "left_semi").select(*pk)
    return survivors
