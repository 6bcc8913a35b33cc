"""Lake catalog views derived from the test tables.

The test tables are mapped onto the lake's catalog once, here, so every query
(and its DuckDB oracle) starts from the same derivation:

* event log  <- ``events``: action by event type, dataset = props.k % 10,
  already-processed = every third event id;
* transforms <- the distinct (user, dataset) pairs of that log;
* files      <- ``documents`` (one file per document, dataset = source);
* users      <- ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.functions import scalars as S
from lakehook.schemas import OBJECT_FILE, SERVICE_DATASETS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def action_of(event_type: str = "event_type"):
    t = F.col(event_type)
    return (F.when(t == "click", "PUT").when(t == "error", "DELETE")
            .when(t == "view", "GET").otherwise("POST"))


def event_log(events: DataFrame) -> DataFrame:
    """Event log rows (lake schema) from the ``events`` table."""
    k = S.json_field("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("created_timestamp"),
        F.col("event_type").alias("description"),
        F.col("user_id"),
        F.lit(SERVICE_DATASETS).alias("service"),
        action_of().alias("action"),
        (k % 10).cast("long").alias("dataset_id"),
        F.lit(OBJECT_FILE).alias("object"),
        F.lit(False).alias("is_transform_output"),
        (F.col("event_id") % 3 == 0).alias("processed"),
    )


def registrations(log: DataFrame) -> DataFrame:
    """Transform registrations derived from the log's (user, dataset) pairs.

    Every fourth pair (by user + dataset) registers a transform reading
    POSTs and writing to the next dataset; even datasets output POST, odd ones
    PUT; users divisible by five have it disabled. Datasets divisible by three
    get a second, always-enabled registration with a higher id.
    """
    base = (log.select("user_id", "dataset_id")
            .filter((F.col("user_id") + F.col("dataset_id")) % 4 == 0)
            .distinct())
    u, d = F.col("user_id"), F.col("dataset_id")

    def shape(tid, out_ds, out_action, enabled):
        return F.struct(
            tid.cast("long").alias("transform_id"),
            u.alias("user_id"),
            F.concat(F.lit("t"), tid.cast("string")).alias("name"),
            F.lit(SERVICE_DATASETS).alias("in_service"),
            d.alias("in_dataset_id"),
            F.lit("POST").alias("in_action"),
            F.lit(OBJECT_FILE).alias("in_object"),
            F.lit(SERVICE_DATASETS).alias("out_service"),
            out_ds.cast("long").alias("out_dataset_id"),
            out_action.alias("out_action"),
            F.lit(OBJECT_FILE).alias("out_object"),
            F.lit("identity.sql").alias("src_file"),
            F.lit(200).cast("decimal(4,0)").alias("timeout"),
            enabled.alias("enabled"),
        )

    primary = shape(u * 10 + d, (d + 1) % 10,
                    F.when(d % 2 == 0, F.lit("POST")).otherwise(F.lit("PUT")), u % 5 != 0)
    secondary = F.when(d % 3 == 0, shape(F.lit(1000000) + u * 10 + d, (d + 2) % 10,
                                          F.lit("POST"), F.lit(True)))
    # both registrations of a pair come from one pass over the distinct pairs
    both = F.filter(F.array(primary, secondary), lambda r: r.isNotNull())
    return base.select(F.explode(both).alias("r")).select("r.*")


def files_from_documents(documents: DataFrame, root: str = "/lake") -> DataFrame:
    """File catalog rows, one per document."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".txt"))
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("dataset"),
        F.col("lang"),
        name.alias("name"),
        S.dataset_path(root, F.col("lang"), F.col("source"), name).alias("path"),
        F.col("n_chars").alias("size_bytes"),
        created_date().alias("created"),
    )


def created_date(doc_id: str = "doc_id"):
    """Creation date of a document's file: spread over ten days from
    2024-01-01 in blocks of twenty ids."""
    offset = F.expr(f"CAST(({doc_id} div 20) % 10 AS INT)")
    return F.date_add(F.lit("2024-01-01").cast("date"), offset)


def activity(events: DataFrame) -> DataFrame:
    """Lake data the events point at: every event row belongs to the file of
    its (user, dataset) -- the user's activity file in that dataset."""
    k = S.json_field("props", "$.k").cast("int")
    return events.select("event_id", "user_id", (k % 10).cast("long").alias("dataset_id"),
                         "event_type", "value", "ts")


ACTIVITY_FILE_KEYS = ["user_id", "dataset_id"]


def activity_file_name():
    """Output file name of an activity file: same base name, .parquet."""
    return F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_d"),
                    F.col("dataset_id").cast("string"), F.lit(".parquet"))
