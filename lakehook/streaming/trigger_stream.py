"""Trigger dispatch as a Structured Streaming query.

New event-log files are read with ``readStream``; every micro-batch is
de-duplicated on the event id, matched against the registrations and handed
to a batch dispatcher (see :mod:`lakehook.plans.dispatch`) inside
``foreachBatch``. Progress lives in the checkpoint, which takes the place of
a "processed" flag: a restarted query resumes after the last committed batch,
and a replayed batch rewrites the same output partitions (dynamic overwrite),
so results stay exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakehook.operators.match import match_triggers
from lakehook.operators.registrations import RegistrationStore
from lakehook.session import scratch_path, scratch_scope


def start_dispatch_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    to_log: Callable[[DataFrame], DataFrame],
    transforms: DataFrame | RegistrationStore,
    handle_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    path_glob: str | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    dedupe_within: str | None = None,
):
    """Start the streaming dispatcher and return the StreamingQuery.

    ``to_log`` maps the raw source rows to event-log rows (``log_id``,
    ``user_id``, ``service``, ``dataset_id``, ``action``, ``object``,
    ``processed``, ``is_transform_output``). ``handle_batch(matched,
    batch_id)`` writes the batch's outputs. ``available_now`` processes what
    is there and stops (bounded by ``max_files_per_trigger`` per batch);
    otherwise the query runs on a ``processing_time`` trigger.

    ``dedupe_within`` (e.g. ``"1 hour"``) drops an event id seen before in
    an earlier micro-batch too -- a log file delivered twice -- using
    streaming state bounded by a watermark on the event time
    (``dropDuplicatesWithinWatermark``). As with any watermark, events
    older than the latest event time minus the delay count as late and are
    dropped, so the delay should exceed how late the log can arrive. It is off
    by default: duplicates are then removed within each micro-batch only, and a
    repeated event rewrites the same output.

    ``transforms`` is a fixed table or a :class:`RegistrationStore`; of the latter,
    each micro-batch takes the version that is current when it begins, so what is
    registered while the query runs fires from the next batch on. A fixed table is
    kept in a store of the query's own. The ranked registrations are written once
    per version; scratch tables of a micro-batch are removed when it is done.
    """
    if not isinstance(transforms, RegistrationStore):
        fixed, transforms = transforms, RegistrationStore(spark, scratch_path(spark, "stream-registrations"))
        transforms.publish(fixed)
    store = transforms
    reader = spark.readStream.schema(schema)
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    log = to_log(reader.parquet(source_dir))
    if dedupe_within:
        # watermarks need a TIMESTAMP column; the log's time is wall-clock
        # (NTZ), and a fixed zone shift does not change a relative delay
        log = (log.withColumn("__event_time", F.col("created_timestamp").cast("timestamp"))
               .withWatermark("__event_time", dedupe_within)
               .dropDuplicatesWithinWatermark(["log_id"])
               .drop("__event_time"))

    def each(batch: DataFrame, batch_id: int) -> None:
        events = batch.dropDuplicates(["log_id"])
        ranked = store.ranked()  # outlives the batch
        with scratch_scope(spark):
            handle_batch(match_triggers(events, None, ranked=ranked), batch_id)

    writer = log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
