"""Trigger matching: which registered transform runs for which event
(J2 trigger match, J3 trigger gate, M5 processed flag).

An event matches a registration when (user, service, dataset, action, object)
agree. Several registrations can share that key; the lowest transform id is the
one picked, and only then are ``enabled`` and the output action checked, so a
disabled first registration hides an enabled second one.

Because the ranking depends only on the key, it is computed once per key on
the registration side (a grouped ``min(struct)``, combined map-side) instead of
once per event: the event side is joined exactly once and never re-shuffled by
event id for a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehook.schemas import DISPATCH_ACTION

# (event-log column, registration column) pairs forming the trigger key.
TRIGGER_KEY = (
    ("user_id", "user_id"),
    ("service", "in_service"),
    ("dataset_id", "in_dataset_id"),
    ("action", "in_action"),
    ("object", "in_object"),
)

# Registration columns carried to the match result.
MATCH_PAYLOAD = ("transform_id", "name", "out_service", "out_dataset_id", "out_action",
                 "out_object", "src_file", "timeout", "enabled")


def pending(log: DataFrame) -> DataFrame:
    """Events still to be dispatched: not processed and not written by a
    transform (transform output never re-triggers)."""
    return log.filter(~F.col("processed") & ~F.coalesce(F.col("is_transform_output"), F.lit(False)))


def _dispatchable_event(log: DataFrame):
    """An event can only be dispatched when it names its object (a log row
    with NULL object details has no file to read)."""
    if "object_details" in log.columns:
        return F.col("object_details").isNotNull()
    return F.lit(True)


def first_registration_per_key(transforms: DataFrame,
                               payload: tuple[str, ...] = MATCH_PAYLOAD) -> DataFrame:
    """Lowest-id registration of every trigger key (ties are impossible: ids
    are unique). NULL key parts can never match an event and are dropped."""
    keys = [r for _, r in TRIGGER_KEY]
    cols = [c for c in payload if c in transforms.columns]
    ranked_first = ["transform_id"] + [c for c in cols if c != "transform_id"]
    best = (transforms
            .filter(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
            .groupBy(*keys)
            .agg(F.min(F.struct(*ranked_first)).alias("__first")))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in ranked_first])


def dispatchable(registrations: DataFrame) -> DataFrame:
    """Registrations that actually run: enabled, output action POST."""
    return registrations.filter(F.col("enabled") & (F.col("out_action") == F.lit(DISPATCH_ACTION)))


def ranked_table(ranked: DataFrame) -> DataFrame:
    """``ranked`` (registrations, registered datasets) as a stored table.

    A derived side has no known size before it runs, so the planner would
    shuffle the event log first and find out later that a broadcast would do.
    Written to the shared scratch folder (a catalog-sized table, rewritten
    whenever registrations change), its size in bytes is known: small, it is
    broadcast and the log is never shuffled; large, it is joined by key.
    """
    from lakehook.session import scratch_path

    path = scratch_path(ranked.sparkSession, "ranked")
    ranked.write.parquet(path)
    return ranked.sparkSession.read.schema(ranked.schema).parquet(path)


def _key_condition(log: DataFrame, regs: DataFrame) -> Column:
    cond = None
    for left, right in TRIGGER_KEY:
        part = log[left] == regs[right]
        cond = part if cond is None else cond & part
    return cond


def ranked_registrations(transforms: DataFrame) -> DataFrame:
    """The registrations that :func:`match_triggers` joins, as a stored table."""
    return ranked_table(dispatchable(first_registration_per_key(transforms)))


def match_triggers(log: DataFrame, transforms: DataFrame | None, policy: str = "first",
                   salt_buckets: int = 0, ranked: DataFrame | None = None) -> DataFrame:
    """Pending events joined to the registration that fires for them.

    ``policy="first"`` (default) keeps the reference rule -- one registration
    per event, chosen before the enabled/POST test. ``policy="all"`` fires
    every enabled POST registration of the key.

    Returns the event columns plus the registration payload. The join is an
    inner equi-join on the trigger key with the ranked registrations as a
    stored table (:func:`ranked_table`): the planner broadcasts it when its
    bytes are few, and AQE splits skewed keys otherwise.

    ``salt_buckets > 0`` salts the join explicitly (for clusters running
    without AQE skew handling): every event gets a bucket from a hash of its
    id, and each registration row -- one per key after ranking, so cheap to
    copy -- is replicated into all buckets with ``explode``. A key holding a
    large share of the events is then spread over that many tasks. The
    result is identical.

    ``ranked`` is a table from :func:`ranked_registrations` that is used again, as
    by a stream whose registrations did not change.
    """
    if ranked is not None:
        regs = ranked
    elif policy == "first":
        regs = ranked_registrations(transforms)
    elif policy == "all":
        keep = [r for _, r in TRIGGER_KEY] + [c for c in MATCH_PAYLOAD if c in transforms.columns]
        regs = dispatchable(transforms.select(*dict.fromkeys(keep)))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    events = pending(log).filter(_dispatchable_event(log))
    if salt_buckets > 0:
        events = events.withColumn(
            "__salt", F.pmod(F.xxhash64("log_id"), F.lit(salt_buckets)).cast("int"))
        regs = regs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    cond = _key_condition(events, regs)
    if salt_buckets > 0:
        cond = cond & (events["__salt"] == regs["__salt"])
    joined = events.join(regs, cond, "inner")
    joined = joined.drop(*[regs[r] for l, r in TRIGGER_KEY if l != r] +
                         [regs[r] for l, r in TRIGGER_KEY if l == r])
    if salt_buckets > 0:
        joined = joined.drop(events["__salt"]).drop(regs["__salt"])
    return joined


STATUS_DISPATCHED = "dispatched"
STATUS_DISABLED = "disabled"
STATUS_OUTPUT_NOT_POST = "output_not_post"
STATUS_NO_OBJECT = "no_object"
STATUS_NO_REGISTRATION = "no_registration"


def match_report(log: DataFrame, transforms: DataFrame) -> DataFrame:
    """Every pending event with the registration that ranks first for it and
    what happened: ``dispatched``, ``disabled`` (the first registration is
    disabled, even if a later one is enabled), ``output_not_post`` (output
    action PUT is registered but never runs), ``no_object`` (no object
    details to read) or ``no_registration``.

    One left join of the events with the ranked registration side, so the
    report costs the same as the match itself.
    """
    regs = ranked_table(first_registration_per_key(transforms))
    events = pending(log)
    if "object_details" not in events.columns:
        events = events.withColumn("object_details", F.lit("{}"))
    joined = events.join(regs, _key_condition(events, regs), "left")
    status = (F.when(regs["transform_id"].isNull(), F.lit(STATUS_NO_REGISTRATION))
              .when(~F.coalesce(regs["enabled"], F.lit(False)), F.lit(STATUS_DISABLED))
              .when(regs["out_action"] != F.lit(DISPATCH_ACTION), F.lit(STATUS_OUTPUT_NOT_POST))
              .when(events["object_details"].isNull(), F.lit(STATUS_NO_OBJECT))
              .otherwise(F.lit(STATUS_DISPATCHED)))
    return joined.select(events["log_id"], regs["transform_id"], status.alias("status"))


def gate(log: DataFrame, transforms: DataFrame) -> DataFrame:
    """Events on a dataset that has at least one registration (any user),
    excluding transform output. A semi join against the distinct registered
    datasets."""
    registered = ranked_table(transforms.select(F.col("in_dataset_id").alias("__ds")).distinct())
    gated = log.join(registered, log["dataset_id"] == registered["__ds"], "left_semi")
    return gated.filter(~F.coalesce(F.col("is_transform_output"), F.lit(False)))


def mark_processed(log: DataFrame, high_water: int | Column) -> DataFrame:
    """M5: flag every event up to the batch high-water mark as processed.

    A snapshot column rewrite: rows above the mark keep their flag, so events
    that arrived while the batch ran are not lost.
    """
    hw = high_water if isinstance(high_water, Column) else F.lit(high_water)
    return log.withColumn(
        "processed",
        F.when(F.col("log_id") <= hw, F.lit(True)).otherwise(F.col("processed")),
    )
