"""Row quality checks (Q1): declarative rules evaluated as boolean columns.

Rules are evaluated in one projection; the summary is one aggregation pass
(partial sums per task), unpivoted to one row per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds used by the lake's own validators.
DATASET_NAME_LENGTH = (3, 63)
USER_NAME_LENGTH = (8, 32)
TRANSFORM_NAME_LENGTH = (1, 64)
MIN_DISTINCT_CHARS = 5
MAX_TIMEOUT = 1500


@dataclass(frozen=True)
class Rule:
    name: str
    expr: Column

    def passed(self) -> Column:
        """NULL (a rule that cannot be evaluated) counts as a failure."""
        return F.coalesce(self.expr, F.lit(False))


def length_between(name: str, col: str, lo: int, hi: int) -> Rule:
    return Rule(name, F.length(F.col(col)).between(lo, hi))


def min_distinct_chars(name: str, col: str, n: int) -> Rule:
    chars = F.array_distinct(F.split(F.col(col), ""))
    return Rule(name, F.size(chars) >= n)


def not_contained(name: str, needle: str, haystack: str) -> Rule:
    """``needle`` must not occur inside ``haystack`` (case-insensitive)."""
    return Rule(name, ~F.lower(F.col(haystack)).contains(F.lower(F.col(needle))))


def at_most(name: str, col: str, bound) -> Rule:
    return Rule(name, F.col(col) <= F.lit(bound))


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Input rows plus one boolean ``check_<rule>`` column per rule and
    ``passed_all``."""
    checks = [r.passed().alias(f"check_{r.name}") for r in rules]
    all_ok = F.lit(True)
    for r in rules:
        all_ok = all_ok & r.passed()
    return df.select("*", *checks, all_ok.alias("passed_all"))


def summarize(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n_pass, n_fail), one row per rule, from a single scan."""
    sums = []
    for i, r in enumerate(rules):
        sums.append(F.coalesce(F.sum(F.when(r.passed(), 1).otherwise(0)), F.lit(0)).cast("long").alias(f"p{i}"))
        sums.append(F.coalesce(F.sum(F.when(r.passed(), 0).otherwise(1)), F.lit(0)).cast("long").alias(f"f{i}"))
    wide = df.agg(*sums)
    stack = ", ".join(f"'{r.name}', p{i}, f{i}" for i, r in enumerate(rules))
    return wide.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, n_pass, n_fail)")
