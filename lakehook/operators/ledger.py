"""Processed events as a ledger of id ranges beside the event log (M5).

Flagging a batch's events in the log itself rewrites the log for every batch. Here
the log is append-only and two small tables stand beside it:

* ``<log>-days``: for every append, the days that it wrote to with their first and
  last event id, noted before the events are written;
* ``<log>-ledger``: the id range that each batch has processed.

An event is processed when its own flag says so or a range covers it. A batch reads
the days whose noted ids are not all covered, late events in old days too, and
nothing else of the log; then it appends one range. :func:`compact` brings the flags
into the days touched since the last compaction, and leaves other days as they are.

Every step may be repeated after a failure: a day noted without events is read once
in vain, a range appended twice merges into one, and an append with a ``writer`` name
(a batch's own output events) replaces what its earlier attempt has left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakehook.schemas import EVENT_LOG
from lakehook.session import scratch_scope, stored

LOWEST = -(1 << 63)
RANGES = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("from_id", T.LongType()),
                       T.StructField("to_id", T.LongType()), T.StructField("compacted", T.BooleanType())])
DAYS = T.StructType([T.StructField("day", T.DateType()), T.StructField("first_id", T.LongType()),
                     T.StructField("last_id", T.LongType())])
LOG = T.StructType([*EVENT_LOG.fields, T.StructField("day", T.DateType()), T.StructField("writer", T.StringType())])
UPLOADS = "upload"


def _beside(log_path: str, what: str) -> str:
    return f"{log_path.rstrip('/')}-{what}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A small table that may not exist yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, log_path: str, writer: str = UPLOADS) -> None:
    """Append event-log rows, noting the days they fall on.

    With a ``writer`` of its own, a repeated append replaces the earlier one.
    """
    spark = rows.sparkSession
    with scratch_scope(spark):
        rows = stored(rows.select(*EVENT_LOG.fieldNames(), F.to_date("created_timestamp").alias("day")), "log-append")
        (rows.groupBy("day").agg(F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"))
         .coalesce(1).write.mode("append").parquet(_beside(log_path, "days")))
        out = rows.withColumn("writer", F.lit(writer)).hint("rebalance", "day").write.partitionBy("day", "writer")
        if writer == UPLOADS:
            out.mode("append").parquet(log_path)
        else:
            out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The log as stored, with its partition columns ``day`` and ``writer``."""
    return spark.read.schema(LOG).parquet(log_path)


def covered_ranges(spark: SparkSession, log_path: str) -> list[tuple[int, int]]:
    """The batches' ranges merged; batches that follow one another leave a single one."""
    ranges: list[tuple[int, int]] = []
    rows = _read(spark, _beside(log_path, "ledger"), RANGES).where("from_id is not null").groupBy("from_id").agg(
        F.max("to_id").alias("to_id"))
    for r in sorted(rows.collect()):  # a row per batch at most
        if ranges and r["from_id"] <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], r["to_id"]))
        else:
            ranges.append((r["from_id"], r["to_id"]))
    return ranges


def _covered(ranges: list[tuple[int, int]], first: str = "log_id", last: str = "log_id") -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((F.col(first) >= a) & (F.col(last) <= b))
    return out


def _on_days(log: DataFrame, days: list) -> DataFrame:
    """The log's partitions of ``days``; None is the day of events without a time."""
    own = F.col("day").isin([d for d in days if d is not None])
    return log.where(own | F.col("day").isNull() if None in days else own)


def open_days(spark: SparkSession, log_path: str) -> list:
    """Days with ids that no range covers, in order."""
    days = _read(spark, _beside(log_path, "days"), DAYS)
    found = days.where(~_covered(covered_ranges(spark, log_path), "first_id", "last_id")).select("day").distinct().collect()
    return sorted((r["day"] for r in found), key=str)


def pending_events(spark: SparkSession, log_path: str) -> DataFrame:
    """Events that no batch has processed; scans the open days only."""
    log = _on_days(read_log(spark, log_path), open_days(spark, log_path))
    return log.where(~F.coalesce("processed", F.lit(False)) & ~_covered(covered_ranges(spark, log_path))).drop("writer")


def all_events(spark: SparkSession, log_path: str) -> DataFrame:
    """The whole log with ``processed`` as flags and ranges together say."""
    done = F.coalesce("processed", F.lit(False)) | _covered(covered_ranges(spark, log_path))
    return read_log(spark, log_path).withColumn("processed", done).drop("writer")


def mark(spark: SparkSession, log_path: str, high_water: int, batch_id: int, from_id: int = LOWEST) -> None:
    """M5: all events from ``from_id`` up to the mark are processed: one appended row."""
    row = spark.createDataFrame([(batch_id, from_id, high_water, False)], RANGES)
    row.coalesce(1).write.mode("append").parquet(_beside(log_path, "ledger"))


def next_log_id(spark: SparkSession, log_path: str) -> int:
    """An id above all noted ones."""
    return (_read(spark, _beside(log_path, "days"), DAYS).agg(F.max("last_id")).first()[0] or 0) + 1


def compact(spark: SparkSession, log_path: str) -> list:
    """Write flags into the days that ranges newer than the last compaction touch.

    Only those day partitions are read and replaced, by dynamic overwrite from a
    stored copy. Returns the days. Run it while no batch or append runs.
    """
    ledger = _read(spark, _beside(log_path, "ledger"), RANGES)
    upto = ledger.agg(F.max("batch_id"), F.max(F.when(F.col("compacted"), F.col("batch_id")))).first()
    last, done = upto[0], upto[1]
    if last is None or last == done:
        return []
    ranges = covered_ranges(spark, log_path)
    with scratch_scope(spark):
        fresh = _read(spark, _beside(log_path, "days"), DAYS).where(
            ~F.coalesce(F.col("last_id") <= F.lit(_flagged_upto(ledger)), F.lit(False)))
        days = sorted((r["day"] for r in fresh.where(_touched(ranges)).select("day").distinct().collect()), key=str)
        log = _on_days(read_log(spark, log_path), days)
        flagged = stored(log.withColumn("processed", F.coalesce("processed", F.lit(False)) | _covered(ranges)), "log-compact")
        (flagged.hint("rebalance", "day", "writer").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "writer").parquet(log_path))
    spark.createDataFrame([(last, None, ranges[0][1], True)], RANGES).coalesce(1).write.mode("append").parquet(
        _beside(log_path, "ledger"))
    return days


def _flagged_upto(ledger: DataFrame) -> int | None:
    """The end of the first merged range at the last compaction: days up to it are flagged."""
    return ledger.where("compacted").agg(F.max("to_id")).first()[0]


def _touched(ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((F.col("last_id") >= a) & (F.col("first_id") <= b))
    return out
