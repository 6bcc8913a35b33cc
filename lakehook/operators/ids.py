"""Stable surrogate ids for new catalog and event-log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehook.session import checkpoint_root


def with_ids(df: DataFrame, starts: dict[str, int]) -> DataFrame:
    """Add id columns (``name -> first id``): unique, increasing and dense.

    The rows are checkpointed first (reliable, shared folder): after a shuffle
    their partitioning depends on the plan, on checkpointed data it is fixed, so
    every later plan sees the same ids. A row's id is its place in its partition
    after the rows of the partitions before, which are counted (one number per
    partition). Meant for new files, datasets, registrations and events.
    """
    checkpoint_root(df.sparkSession)
    fixed = df.checkpoint(eager=True).withColumn("__pid", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before, starts_at = 0, []
    for r in sorted(fixed.groupBy("__pid").count().collect()):
        starts_at.append((r["__pid"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts_at, "__pid int, __before long")
    out = fixed.join(F.broadcast(offsets), "__pid")  # a row per partition
    for name, start in starts.items():
        out = out.withColumn(name, (F.lit(start) + F.col("__before") + F.col("__at")).cast("long"))
    return out.drop("__pid", "__at", "__before")
