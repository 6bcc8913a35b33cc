"""Stored sketches that are merged instead of scanning the data again.

A sketch of distinct values (HLL) and one of quantiles (KLL) per group and day are a
small table; any set of days is answered by merging its rows. A new day adds rows and
leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Registers of an HLL sketch are 2 ** LG_K: its standard error is 0.83 / sqrt(2 ** LG_K).
LG_K = 14
ERROR = 0.0065
# A KLL sketch of this size is off by at most this share of the rows in rank (99 %).
KLL_K = 400
RANK_ERROR = 0.0075


def sketch(df: DataFrame, groups: Sequence[str], distinct: str, measure: str) -> DataFrame:
    """One row per group: its number of rows and the two sketches (binary)."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"),
        F.expr(f"kll_sketch_agg_double(CAST(`{measure}` AS DOUBLE), {KLL_K})").alias("quantile_sketch"))


def merged(sketches: DataFrame, groups: Sequence[str], quantile: float = 0.5) -> DataFrame:
    """Estimates per group over stored sketches: n, distinct_values and the quantile."""
    out = sketches.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"),
        F.expr("kll_merge_agg_double(quantile_sketch)").alias("q"))
    return out.select(*groups, "n", F.hll_sketch_estimate("d").alias("distinct_values"),
                      F.expr(f"kll_sketch_get_quantile_double(q, {quantile}D)").alias("quantile"))
