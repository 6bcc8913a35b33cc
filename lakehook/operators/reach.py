"""Which datasets a change reaches through registrations.

A registration leads from its input to its output dataset; what is reached is the
closure of these steps. Each round joins the pairs found last with the steps and
keeps the new ones, so cycles end by themselves and a pair is extended once; the
rounds follow the longest chain. Rounds are stored tables, removed with the scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehook.session import stored


def reach(steps: DataFrame, source: str = "in_dataset_id", target: str = "out_dataset_id", max_rounds: int = 10_000) -> DataFrame:
    """(source, target, hops): every pair with the smallest number of registrations between."""
    edges = stored(steps.where(F.col(source).isNotNull() & F.col(target).isNotNull())
                   .select(F.col(source).alias("s"), F.col(target).alias("t")).distinct(), "reach-steps")
    found = fresh = stored(edges.withColumn("hops", F.lit(1)), "reach-1")
    for hops in range(2, max_rounds + 2):
        more = (fresh.select("s", F.col("t").alias("m")).join(edges.select(F.col("s").alias("m"), "t"), "m")
                .select("s", "t").distinct().join(found.select("s", "t"), ["s", "t"], "left_anti"))
        fresh = stored(more.withColumn("hops", F.lit(hops)), f"reach-{hops}")
        if fresh.isEmpty():
            break
        found = stored(found.union(fresh), f"reach-all-{hops}")
    else:
        raise RuntimeError(f"chains of registrations did not end after {max_rounds} steps")
    return found.select(F.col("s").alias(source), F.col("t").alias(target), "hops")
