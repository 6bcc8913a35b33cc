"""Age-based storage-class transitions (J4 + M7).

A dataset follows one lifecycle; an enabled rule of that lifecycle lists
transitions "after N days move to class X". A file whose age in whole days
equals N moves to X. Datasets, rules and transitions are catalog-sized; files
are the large side and are joined once, on the equi-key (dataset, age).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def due_transitions(datasets: DataFrame, rules: DataFrame, transitions: DataFrame,
                    dataset_key: str = "dataset") -> DataFrame:
    """(dataset, days, target class) for every enabled rule.

    A rule holds for its own user and dataset: every rule column besides
    ``rule_enabled`` that ``datasets`` has too (``user_id``, ``dataset_id``,
    ``lifecycle_id``) must agree.

    One target per (dataset, days): if a lifecycle lists two transitions for
    the same day count, the alphabetically first class wins, deterministically.
    """
    keys = [c for c in rules.columns if c != "rule_enabled" and c in datasets.columns]
    enabled = rules.filter(F.col("rule_enabled")).select(*keys).distinct()
    due = (datasets.select(dataset_key, *[k for k in keys if k != dataset_key])
           .join(enabled, keys)
           .join(transitions, "lifecycle_id")
           .groupBy(dataset_key, "days_till_transition")
           .agg(F.min("transition_to").alias("transition_to")))
    return due


def apply_transitions(files: DataFrame, due: DataFrame, as_of: Column | str,
                      created_col: str = "created", dataset_key: str = "dataset",
                      class_col: str = "storage_class") -> DataFrame:
    """M7: new storage class of every file (unchanged when nothing is due)."""
    as_of_col = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    aged = files.withColumn("__age", F.datediff(as_of_col, F.col(created_col)))
    # ``due`` is derived (joins + an aggregate); AQE measures it after its
    # shuffle and broadcasts it then if it is small, so no probe re-runs it.
    d = due.select(
        F.col(dataset_key).alias("__ds"), F.col("days_till_transition").alias("__days"),
        F.col("transition_to").alias("__to"))
    joined = aged.join(d, (aged[dataset_key] == d["__ds"]) & (aged["__age"] == d["__days"]), "left")
    return (joined.withColumn(class_col, F.coalesce(F.col("__to"), F.col(class_col)))
            .drop("__age", "__ds", "__days", "__to"))
