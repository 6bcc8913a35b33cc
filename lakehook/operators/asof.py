"""As-of join: each left row with the latest right row at or before it.

Both sides are put together and a running last value carries right rows forward
(one shuffle, no pair of rows is ever made). A key is cut into buckets of the
ordering column, so that a key with a third of all rows is many window groups; the
last right row of every bucket, a small table, is carried on to the buckets after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, bucket: Column,
              prefix: str = "right_") -> DataFrame:
    """Left rows with the columns of the right row of the same ``by`` whose ``on`` is the
    largest not above theirs, prefixed; NULLs where there is none.

    ``bucket`` is an expression over ``on`` that never falls as ``on`` rises (a day, a
    quotient). Of right rows with equal ``on``, the one with the largest other columns
    counts. NULL keys match nothing and a NULL ``on`` neither; such left rows stay.
    """
    values = [c for c in right.columns if c not in by]
    payload = F.struct(F.col(on), *[F.col(c) for c in values if c != on])
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    usable = F.col(on).isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    marks = right.where(usable).select(*keys, F.col(on).alias("__on"), bucket.alias("__bucket"), payload.alias("__value"))
    # one right row for each point, so that ties do not depend on an order
    marks = marks.groupBy(*names, "__on", "__bucket").agg(F.max("__value").alias("__value"))
    rows = left.select(*keys, F.col(on).alias("__on"), bucket.alias("__bucket"), F.struct("*").alias("__row"), usable.alias("__usable"))
    both = rows.where("__usable").drop("__usable").unionByName(marks, allowMissingColumns=True)
    # a right row comes before the left rows of its point
    running = (Window.partitionBy(*names, "__bucket").orderBy("__on", F.col("__row").isNotNull())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = both.withColumn("__found", F.last("__value", ignorenulls=True).over(running)).where("__row is not null")
    # what each bucket hands on: a row per key and bucket
    lasts = both.groupBy(*names, "__bucket").agg(F.max("__value").alias("__last"))
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*names, "__bucket", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = within.join(carried, [*names, "__bucket"]).select("__row", F.coalesce("__found", "__carried").alias("__found"))
    rest = rows.where("not __usable").select("__row", F.lit(None).cast(marks.schema["__value"].dataType).alias("__found"))
    return joined.union(rest).select("__row.*", *[F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in values])
