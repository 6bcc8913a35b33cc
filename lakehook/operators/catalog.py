"""Catalog actions on datasets and files, composed from the operators.

Each action takes the current catalog snapshots plus a DataFrame of
requests and returns the next snapshots, the event-log rows it produces and,
where requests can be refused, the refused ones with a reason -- all as
DataFrames, so a batch of a million requests is one Spark job like a batch
of one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehook.functions import scalars as S
from lakehook.operators import lookup as L
from lakehook.operators import mutate as M
from lakehook.operators.ids import with_ids
from lakehook.operators.quality import DATASET_NAME_LENGTH
from lakehook.sources.files import log_rows

REASON_NAME_LENGTH = "name_length"
REASON_NAME_TAKEN = "name_taken"


def _events(rows: DataFrame, action: str, description: str, next_log_id: int, now) -> DataFrame:
    rows = with_ids(rows, {"log_id": next_log_id})
    return log_rows(rows.select(
        "log_id",
        "user_id", F.lit(action).alias("action"), "dataset_id",
        F.lit(description).alias("description"),
        F.col("host_details")), created=now)


def create_datasets(datasets: DataFrame, requests: DataFrame, now: datetime,
                    next_dataset_id: int, next_log_id: int):
    """Create datasets from ``requests`` (``user_id, name, tags_text``).

    A name must be 3-63 characters and unused by any user. Among requests
    for the same new name, the one of the lowest user id wins (a grouped
    ``min``, not a sort of all requests). Returns ``(snapshot, events,
    refused)``; ``refused`` carries ``reason``.
    """
    lo, hi = DATASET_NAME_LENGTH
    ok_len = F.length("name").between(lo, hi)
    too_short = requests.filter(~F.coalesce(ok_len, F.lit(False)))
    valid = requests.filter(ok_len)
    winners = L.first_per_key(valid, "name", ["user_id"], payload=["tags_text"])
    free = L.not_exists_in(winners, datasets.select("name"), ["name"])
    taken = valid.join(free.select("name", "user_id"), ["name", "user_id"], "left_anti")
    new = with_ids(free, {"dataset_id": next_dataset_id}).select(
        F.col("user_id").cast("long"), "dataset_id",
        "name", S.resource_name("name").alias("resource_name"),
        S.split_tags(F.coalesce(F.col("tags_text"), F.lit(""))).alias("tags"),
        F.lit(None).cast("long").alias("lifecycle_id"))
    snapshot = M.insert_rows(datasets, new.select(*datasets.columns))
    events = _events(new.withColumn("host_details", S.to_json_object("name", "resource_name", "tags")),
                     "POST", "datasetCreate", next_log_id, now)
    refused = (too_short.select("user_id", "name", F.lit(REASON_NAME_LENGTH).alias("reason"))
               .unionByName(taken.select("user_id", "name", F.lit(REASON_NAME_TAKEN).alias("reason"))))
    return snapshot, events, refused


def delete_datasets(datasets: DataFrame, files: DataFrame, doomed: DataFrame, now: datetime,
                    next_log_id: int):
    """Delete datasets (``user_id, dataset_id``) and, by cascade, their files.
    Only a dataset's owner can delete it: the key includes the user.
    Returns ``(datasets_snapshot, files_snapshot, events)``."""
    keys = ["user_id", "dataset_id"]
    hit = datasets.join(doomed.select(*keys), keys, "left_semi")
    kept_datasets = M.delete_rows(datasets, doomed.select(*keys), keys)
    kept_files = M.delete_rows(files, hit.select(*keys), keys)
    events = _events(hit.withColumn("host_details", S.to_json_object("name", "resource_name")),
                     "DELETE", "datasetDelete", next_log_id, now)
    return kept_datasets, kept_files, events


def delete_files(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """Delete files by (user, dataset, path)."""
    return M.delete_rows(files, doomed.select("user_id", "dataset_id", "path"),
                         ["user_id", "dataset_id", "path"])


def update_datasets(datasets: DataFrame, patches: DataFrame, now: datetime, next_log_id: int):
    """Patch datasets (``user_id, dataset_id`` + fields to change; NULL keeps
    the stored value, M6) and log one PUT event per updated dataset.
    Returns ``(snapshot, events)``."""
    keys = ["user_id", "dataset_id"]
    snapshot = M.patch_rows(datasets, patches, keys)
    hit = snapshot.join(patches.select(*keys).distinct(), keys, "left_semi")
    events = _events(hit.withColumn("host_details", S.to_json_object("name", "resource_name", "tags")),
                     "PUT", "datasetUpdate", next_log_id, now)
    return snapshot, events


def delete_users(users: DataFrame, tables: dict[str, DataFrame], doomed: DataFrame) -> dict:
    """Delete users (``user_id``) with ON DELETE CASCADE to every table that
    carries ``user_id`` -- datasets, files, transforms and the event log
    (including the user's own delete event). Registrations have no key to
    datasets, so they go with their user, not with a deleted dataset.
    Returns the surviving ``users`` and each table under its name."""
    ids = doomed.select("user_id").distinct()
    out = {"users": M.delete_rows(users, ids, ["user_id"])}
    for name, df in tables.items():
        out[name] = M.delete_rows(df, ids, ["user_id"])
    return out
