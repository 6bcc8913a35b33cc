"""Equivalence tests: distributed paths against plain local computation."""

import pandas as pd
from pyspark.sql import functions as F

from lakehook.plans import acceptance as A
from lakehook.plans import transforms as TR
from lakehook.session import scratch_path
from lakehook.sources import files as IO
from tests.conftest import SMOKE_DIR


def test_pandas_on_spark_equals_local_pandas(spark):
    events = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    got = TR.pandas_transform(events, A.shift_to_min).toPandas()
    want = A.shift_to_min(pd.read_parquet(f"{SMOKE_DIR}/events.parquet"))
    got = got.sort_values("event_id").reset_index(drop=True)
    want = want.sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_per_file_gets_pandas_in_file_order_at_any_size(spark):
    import numpy as np
    rows = 30_000
    path = scratch_path(spark, "ordered")
    (spark.range(rows).repartitionByRange(3, "id").sortWithinPartitions(F.desc("id"))
     .select("id", F.lit("f").alias("file")).write.parquet(path))
    df = IO.read_files(spark, {"parquet": [path]}, positions=True)

    def ordered(pdf):
        assert isinstance(pdf, pd.DataFrame) and list(pdf.columns) == ["id", "source_file"]
        return pd.DataFrame({"id": pdf["id"], "seen": np.arange(len(pdf)), "total": pdf["id"].cumsum(),
                             "odd": np.where(pdf["id"] % 2 == 1, 1, 0)})

    got = TR.per_file_transform(df, ordered, "id long, seen long, total long, odd long", "file").toPandas()
    got = got.sort_values("seen")
    # each part file holds its range backwards, part files stand in name order
    want = [i for lo, hi in _ranges(path) for i in range(hi, lo - 1, -1)]
    assert got["id"].tolist() == want and got["total"].tolist() == np.cumsum(want).tolist()


def _ranges(path):
    import glob
    parts = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))
    return [(int(p["id"].min()), int(p["id"].max())) for p in map(pd.read_parquet, parts)]


def test_per_file_failures_become_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "file string, v long")

    def picky(pdf):
        if (pdf["v"] == 2).any():
            raise ValueError("two")
        return pdf

    rows = TR.per_file_transform(df, picky, "v long", "file", failures=True).orderBy("file").collect()
    assert [tuple(r) for r in rows] == [("a", 1, None), ("b", None, "ValueError: two")]


def test_csv_and_parquet_columns_bind_by_name(spark):
    root = scratch_path(spark, "by-name")
    spark.createDataFrame([(1, 2.5)], "id long, amount double").write.option("header", True).csv(f"{root}/a.csv")
    spark.createDataFrame([(7.5, 2)], "amount double, id long").write.option("header", True).csv(f"{root}/b.csv")
    for schema in (None, "id long, amount double"):
        got = IO.read_files(spark, {"csv": [f"{root}/a.csv", f"{root}/b.csv"]}, schema).select("id", "amount")
        assert sorted(tuple(r) for r in got.collect()) == [(1, 2.5), (2, 7.5)]


def test_lifecycle_rule_of_another_dataset_does_not_count(spark):
    from lakehook.operators import lifecycle as LC
    datasets = spark.createDataFrame([("a", 1, 1, 9), ("b", 1, 2, 9)],
                                     "dataset string, user_id long, dataset_id long, lifecycle_id long")
    rules = spark.createDataFrame([(1, 1, 9, True), (1, 2, 9, False)],
                                  "user_id long, dataset_id long, lifecycle_id long, rule_enabled boolean")
    steps = spark.createDataFrame([(9, 3, "cold")], "lifecycle_id long, days_till_transition int, transition_to string")
    assert [r["dataset"] for r in LC.due_transitions(datasets, rules, steps).collect()] == ["a"]


def test_dense_ids_and_null_safe_document_ids(spark):
    from lakehook.operators.ids import with_ids
    ids = sorted(r["n"] for r in with_ids(spark.range(0, 50, numPartitions=7), {"n": 5}).collect())
    assert ids == list(range(5, 55))
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    _, got = IO.append_documents(df, scratch_path(spark, "null-ids"), id_cols=["x", "y", "z"])
    assert got.distinct().count() == 2


def test_stream_equals_batch(spark):
    batch = sorted(tuple(r) for r in A.dispatch_batch(spark, SMOKE_DIR).collect())
    stream = sorted(tuple(r) for r in A.dispatch_stream(spark, SMOKE_DIR).collect())
    assert batch == stream and len(batch) > 0


def test_dispatch_replay_is_idempotent(spark):
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    log = lake.event_log(ev)
    matched = match_triggers(log, lake.registrations(log))
    out = scratch_path(spark, "replay")
    for _ in range(2):
        D.dispatch_python(matched, lake.activity(ev), lake.ACTIVITY_FILE_KEYS,
                          lake.activity_file_name(), A.purchase_delta,
                          "event_id long, value_delta double", out)
    back = spark.read.parquet(out)
    assert back.count() == back.dropDuplicates(["event_id", "transform_id"]).count()


def test_csv_inferred_schema(spark):
    path = scratch_path(spark, "infer")
    spark.read.parquet(f"{SMOKE_DIR}/nation.parquet").write.option("header", True).csv(path)
    df = IO.read_csv(spark, path)
    assert dict(df.dtypes)["n_nationkey"] == "int" and df.count() == 25


def test_ingest_reupload_emits_no_event(spark):
    from datetime import datetime
    from lakehook.schemas import FILES
    landing = scratch_path(spark, "landing-t")
    spark.read.parquet(f"{SMOKE_DIR}/region.parquet").write.option("header", True).csv(landing + "/r.csv")
    land = spark.createDataFrame([("r.csv", landing + "/r.csv", "csv")],
                                 "name string, landing_path string, file_extension string")
    root = scratch_path(spark, "ds-t")
    snap1, ev1 = IO.ingest(spark, land, spark.createDataFrame([], FILES), root, 1, 2, "o",
                           datetime(2024, 1, 1), 1, 1)
    snap1 = snap1.checkpoint(eager=True)
    snap2, ev2 = IO.ingest(spark, land, snap1, root, 1, 2, "o", datetime(2024, 1, 2), 2, 2)
    assert ev1.count() == 1 and ev2.count() == 0
    row = snap2.collect()
    assert len(row) == 1 and row[0]["last_modified"] == datetime(2024, 1, 2)
    assert row[0]["creation_date"] == datetime(2024, 1, 1)
    assert row[0]["path"].endswith("/r.parquet") and row[0]["file_extension"] == "parquet"
    assert row[0]["size_bytes"] > 0 and row[0]["size"].endswith(("bytes", "KB"))


def test_sql_transform_isolated_views(spark):
    a = TR.sql_transform(spark, "SELECT count(*) AS n FROM return_arrow_table",
                         lambda s: s.read.parquet(f"{SMOKE_DIR}/region.parquet"))
    b = TR.sql_transform(spark, "SELECT count(*) AS n FROM return_arrow_table",
                         lambda s: s.read.parquet(f"{SMOKE_DIR}/nation.parquet"))
    assert (a.first()["n"], b.first()["n"]) == (5, 25)
    assert not spark.catalog.tableExists("return_arrow_table")
    assert TR.SQL_TEMPLATE.startswith("SELECT * FROM return_arrow_table")
    tiny = spark.createDataFrame([(1,)], "x long")
    assert TR.native_transform(tiny, lambda d: d.withColumn("y", F.col("x") + 1)).first()["y"] == 2


def test_sql_dispatch_per_transform_mode(spark):
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    log = lake.event_log(ev)
    matched = match_triggers(log, lake.registrations(log))
    script = "SELECT count(*) AS n, max(value) AS top FROM return_arrow_table"
    out = scratch_path(spark, "sql-per-t")
    ran = D.dispatch_sql(spark, matched, lambda s: lake.activity(s.read.parquet(f"{SMOKE_DIR}/events.parquet")),
                         lake.ACTIVITY_FILE_KEYS, {"identity.sql": script}, out,
                         work_path=scratch_path(spark, "sql-per-t-work"), scope="transform")
    got = D.read_outputs(spark, out)
    # one aggregate row per fired transform, counting that transform's own files
    assert got.count() == len(ran) == matched.select("transform_id").distinct().count()
    want = (lake.activity(ev).join(D.work_items(matched, lake.ACTIVITY_FILE_KEYS),
                                   lake.ACTIVITY_FILE_KEYS)
            .groupBy("transform_id").count())
    want = {f"t{r['transform_id']}.parquet": r["count"] for r in want.collect()}
    assert {r["out_file"]: r["n"] for r in got.collect()} == want


def test_transform_output_never_retriggers(spark):
    """Output events land in the log flagged as transform output; a
    registration listening on the output dataset does not fire for them,
    while a plain upload to the same dataset does."""
    from datetime import datetime
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.schemas import FILES
    work = spark.createDataFrame([(1, 3, 10, 4, "identity.sql")],
                                 "user_id long, dataset_id long, transform_id long, "
                                 "out_dataset_id long, src_file string")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".parquet"))
    outputs = work.select("user_id", F.col("out_dataset_id").alias("dataset_id"), name.alias("name"),
                          F.concat(F.lit("/lake/out/"), name).alias("path"))
    snap, events = D.record_outputs(outputs, spark.createDataFrame([], FILES), datetime(2024, 1, 1), 1, 100)
    assert snap.count() == 1 and events.first()["is_transform_output"] is True
    upload = events.withColumn("log_id", F.lit(101).cast("long")) \
        .withColumn("is_transform_output", F.lit(False))
    log = events.unionByName(upload)
    regs = spark.createDataFrame(
        [(20, 1, "datasets", 4, "POST", "file", 5, "POST", True)],
        "transform_id long, user_id long, in_service string, in_dataset_id long, in_action string, "
        "in_object string, out_dataset_id long, out_action string, enabled boolean")
    fired = [r["log_id"] for r in match_triggers(log, regs).collect()]
    assert fired == [101]
    # recording the same outputs again adds no event and keeps one catalog row
    snap2, events2 = D.record_outputs(outputs, snap, datetime(2024, 1, 2), 2, 200)
    assert events2.count() == 0 and snap2.count() == 1
    assert snap2.first()["last_modified"] == datetime(2024, 1, 2)


def test_tag_update_emits_put_that_triggers(spark):
    from datetime import datetime
    from lakehook.operators.match import match_triggers
    from lakehook.schemas import FILES
    files = spark.createDataFrame(
        [(1, 3, 10, "a.csv", "/lake/1/3/a.csv", "o", datetime(2024, 1, 1), datetime(2024, 1, 1),
          "1 bytes", 1, "csv", ["x"], "hot")], FILES)
    changes = spark.createDataFrame([(1, 3, "/lake/1/3/a.csv", "y,,z"), (1, 3, "/lake/1/3/missing", "q")],
                                    "user_id long, dataset_id long, path string, tags_text string")
    snap, events = IO.update_file_tags(files, changes, datetime(2024, 2, 1), 50)
    row = snap.first()
    assert row["tags"] == ["y", "z"] and row["last_modified"] == datetime(2024, 2, 1)
    assert [(r["action"], r["log_id"]) for r in events.collect()] == [("PUT", 50)]
    regs = spark.createDataFrame(
        [(7, 1, "datasets", 3, "PUT", "file", 4, "POST", True)],
        "transform_id long, user_id long, in_service string, in_dataset_id long, in_action string, "
        "in_object string, out_dataset_id long, out_action string, enabled boolean")
    assert [r["transform_id"] for r in match_triggers(events, regs).collect()] == [7]


def test_end_to_end_upload_trigger_transform(spark):
    """Upload -> event -> match -> read the named file -> per-file transform
    -> output under the same base name -> recorded as transform output,
    which does not trigger again."""
    from datetime import datetime
    from decimal import Decimal
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.schemas import FILES

    landing = scratch_path(spark, "e2e-landing")
    spark.read.parquet(f"{SMOKE_DIR}/nation.parquet").write.option("header", True) \
        .csv(landing + "/nations.csv")
    land = spark.createDataFrame([("nations.csv", landing + "/nations.csv", "csv")],
                                 "name string, landing_path string, file_extension string")
    root = scratch_path(spark, "e2e-lake")
    catalog, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/u1/d1",
                                1, 1, "owner1", datetime(2024, 5, 1), 1, 1,
                                csv_schema="n_nationkey int, n_name string, n_regionkey int")
    catalog, events = catalog.checkpoint(eager=True), events.checkpoint(eager=True)
    assert events.count() == 1 and events.first()["action"] == "POST"
    regs = spark.createDataFrame(
        [(1, 1, "t1", "datasets", 1, "POST", "file", "datasets", 2, "POST", "file", "region_share.py",
          Decimal(200), True)],
        "transform_id long, user_id long, name string, in_service string, in_dataset_id long, "
        "in_action string, in_object string, out_service string, out_dataset_id long, "
        "out_action string, out_object string, src_file string, timeout decimal(4,0), enabled boolean")
    matched = match_triggers(events, regs)
    assert matched.count() == 1

    def region_share(pdf):
        out = pdf.groupby("n_regionkey", as_index=False).agg(n=("n_name", "count"))
        out["share"] = out["n"] / out["n"].sum()
        return out[["n_regionkey", "n", "share"]]

    out_root = f"{root}/outputs"
    manifest = D.dispatch_files(
        spark, matched, lambda src: ("pandas_file", region_share, "n_regionkey int, n long, share double"), out_root)
    done = manifest.collect()
    assert [(r["name"], r["out_dataset_id"], r["error"]) for r in done] == [("nations.parquet", 2, None)]
    got = spark.read.parquet(done[0]["path"]).collect()
    assert sum(r["n"] for r in got) == 25 and done[0]["n_rows"] == len(got)
    outputs = manifest.select("user_id", F.col("out_dataset_id").alias("dataset_id"), "name", "path")
    _, out_events = D.record_outputs(outputs, catalog, datetime(2024, 5, 1), 10, 10)
    assert out_events.count() == 1 and match_triggers(out_events, regs).count() == 0


def test_stream_in_several_micro_batches_equals_batch(spark):
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    from lakehook.streaming.trigger_stream import start_dispatch_stream

    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    # the event log as three files (ten days each) in one directory
    files_dir = scratch_path(spark, "stream-files")
    for lo, hi in [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"),
                   ("2024-01-21", "2024-02-01")]:
        part = ev.filter((F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
                         & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
        part.coalesce(1).write.mode("append").parquet(files_dir)
    regs = lake.registrations(lake.event_log(ev))
    data = lake.activity(ev)
    out = scratch_path(spark, "stream-out")
    batches = []

    def handle(matched, batch_id):
        batches.append(batch_id)
        D.dispatch_python(matched, data, lake.ACTIVITY_FILE_KEYS, lake.activity_file_name(),
                          A.purchase_delta, "event_id long, value_delta double", out,
                          batch_id=batch_id)

    q = start_dispatch_stream(spark, files_dir, ev.schema, lake.event_log, regs, handle,
                              checkpoint=scratch_path(spark, "stream-ckpt2"),
                              max_files_per_trigger=1)
    q.awaitTermination()
    assert len(batches) == 3
    streamed = sorted(tuple(r) for r in D.read_outputs(spark, out, A.DISPATCH_OUT_DDL).collect())
    batch = sorted(tuple(r) for r in A.dispatch_batch(spark, SMOKE_DIR).collect())
    assert streamed == batch


def test_run_batch_twice_dispatches_once(spark):
    """A full batch (match, dispatch, record, mark processed) over snapshots;
    the second run over the new snapshots finds nothing to do, and the
    transform output it logged never triggers."""
    from datetime import datetime
    from decimal import Decimal
    from lakehook.plans import dispatch as D
    from lakehook.schemas import EVENT_LOG, FILES

    landing = scratch_path(spark, "rb-landing")
    spark.read.parquet(f"{SMOKE_DIR}/region.parquet").write.option("header", True) \
        .csv(landing + "/regions.csv")
    land = spark.createDataFrame([("regions.csv", landing + "/regions.csv", "csv")],
                                 "name string, landing_path string, file_extension string")
    root = scratch_path(spark, "rb-lake")
    files, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/u1/d1",
                              1, 1, "o", datetime(2024, 5, 1), 1, 1,
                              csv_schema="r_regionkey int, r_name string")
    log = spark.createDataFrame([], EVENT_LOG).unionByName(events)
    regs = spark.createDataFrame(
        [(5, 1, "t5", "datasets", 1, "POST", "file", "datasets", 2, "POST", "file", "upper.py",
          Decimal(200), True),
         (6, 1, "t6", "datasets", 2, "POST", "file", "datasets", 3, "POST", "file", "upper.py",
          Decimal(200), True)],
        "transform_id long, user_id long, name string, in_service string, in_dataset_id long, "
        "in_action string, in_object string, out_service string, out_dataset_id long, "
        "out_action string, out_object string, src_file string, timeout decimal(4,0), enabled boolean")

    def upper(pdf):
        out = pdf.copy()
        out["r_name"] = out["r_name"].str.upper()
        return out[["r_regionkey", "r_name"]]

    def resolve(src_file):
        return "pandas_file", upper, "r_regionkey int, r_name string"

    out_root = f"{root}/out"
    s1 = D.run_batch(spark, log, regs, files, resolve, out_root,
                     f"{root}/log1", f"{root}/files1", datetime(2024, 5, 2), 1)
    assert s1["dispatched"] == 1 and s1["outputs"] == 1
    log1, files1 = spark.read.parquet(f"{root}/log1"), spark.read.parquet(f"{root}/files1")
    assert files1.count() == 2
    # transform 6 listens on dataset 2, where the output landed: it must not fire
    s2 = D.run_batch(spark, log1, regs, files1, resolve, out_root,
                     f"{root}/log2", f"{root}/files2", datetime(2024, 5, 3), 2)
    assert s2["dispatched"] == 0
    made = files1.where("dataset_id = 2").first()
    outs = IO.scan_catalog_file(spark, files1, 1, 2, made["file_id"]).collect()
    assert sorted(r["r_name"] for r in outs) == ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    assert made["name"] == "regions.parquet"


def test_stream_drops_events_delivered_twice(spark):
    from lakehook.plans import lake
    from lakehook.streaming.trigger_stream import start_dispatch_stream

    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    src = scratch_path(spark, "dup-src")
    ev.coalesce(1).write.parquet(src)
    ev.coalesce(1).write.mode("append").parquet(src)        # the same log file again
    regs = lake.registrations(lake.event_log(ev))
    seen = {}

    def count(matched, batch_id):
        seen[batch_id] = matched.count()

    for dedupe, expect_factor in ((None, 2), ("1 hour", 1)):
        seen.clear()
        q = start_dispatch_stream(spark, src, ev.schema, lake.event_log, regs, count,
                                  checkpoint=scratch_path(spark, "dup-ckpt"),
                                  max_files_per_trigger=1, dedupe_within=dedupe)
        q.awaitTermination()
        assert len(seen) == 2
        assert sum(seen.values()) == expect_factor * 17       # 17 matches in the smoke data


def test_dispatch_survives_failed_task_attempts(spark):
    import os
    import tempfile
    marks = tempfile.mkdtemp(prefix="lakehook-failures-")   # test-only, local mode

    def flaky_purchase_delta(pdf):
        """purchase_delta, except that the first attempt of every other task
        dies -- a stand-in for a lost executor (nested, so it is pickled by
        value for the workers)."""
        from pyspark import TaskContext
        ctx = TaskContext.get()
        if ctx is not None and ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
            open(os.path.join(marks, f"{ctx.stageId()}-{ctx.partitionId()}"), "w").close()
            raise RuntimeError("simulated executor loss")
        return A.purchase_delta(pdf)

    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    log = lake.event_log(ev)
    out = scratch_path(spark, "flaky")
    D.dispatch_python(match_triggers(log, lake.registrations(log)), lake.activity(ev),
                      lake.ACTIVITY_FILE_KEYS, lake.activity_file_name(), flaky_purchase_delta,
                      "event_id long, value_delta double", out)
    got = sorted(tuple(r) for r in D.read_outputs(spark, out, A.DISPATCH_OUT_DDL).collect())
    want = sorted(tuple(r) for r in A.dispatch_batch(spark, SMOKE_DIR).collect())
    assert len(os.listdir(marks)) > 0          # attempts really failed
    assert got == want and len(got) > 0


def test_sql_dispatch_per_file_scope(spark):
    from lakehook.operators.match import match_triggers
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    log = lake.event_log(ev)
    matched = match_triggers(log, lake.registrations(log))
    script = "SELECT count(*) AS n FROM return_arrow_table"
    out = scratch_path(spark, "sql-per-file")
    D.dispatch_sql(spark, matched, lambda s: lake.activity(s.read.parquet(f"{SMOKE_DIR}/events.parquet")),
                   lake.ACTIVITY_FILE_KEYS, {"identity.sql": script}, out,
                   work_path=scratch_path(spark, "sql-per-file-work"), scope="file")
    got = {r["out_file"]: r["n"] for r in D.read_outputs(spark, out).collect()}
    work = D.work_items(matched, lake.ACTIVITY_FILE_KEYS)
    sizes = lake.activity(ev).groupBy(*lake.ACTIVITY_FILE_KEYS).count()
    want = {f"t{r['transform_id']}_{r['user_id']}_{r['dataset_id']}.parquet": r["count"]
            for r in work.join(sizes, lake.ACTIVITY_FILE_KEYS).collect()}
    assert got == want and len(got) > 0


def test_logical_file_matches_catalog_path_with_special_characters(spark):
    root = scratch_path(spark, "names")
    paths = [f"{root}/my file #1+2.parquet", f"{root}/a%b.csv"]
    spark.range(2).write.parquet(paths[0])
    spark.range(2).write.option("header", True).csv(paths[1])
    df = IO.read_files(spark, {"parquet": [paths[0]], "csv": [paths[1]]})
    got = {r[0] for r in df.select(IO.SOURCE_FILE_COL).collect()}
    want = {r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string")
            .select(IO.normalize_path(F.col("p"))).collect()}
    assert got == want


def test_stream_over_appended_event_log(spark):
    """S8 appends the log (day-partitioned) in two batches; T8 streams that
    directory and dispatches; the result equals the batch dispatch."""
    from pyspark.sql import types as T
    from lakehook.plans import dispatch as D
    from lakehook.plans import lake
    from lakehook.schemas import EVENT_LOG
    from lakehook.streaming.trigger_stream import start_dispatch_stream

    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    log = lake.event_log(ev)
    log_dir = scratch_path(spark, "s8-log")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    # each event names its object: the (user, dataset) activity file
    named = log.withColumn("object_details", F.to_json(F.struct("user_id", "dataset_id")))
    for part in (named.filter(F.col("created_timestamp") < cut),
                 named.filter(F.col("created_timestamp") >= cut)):
        IO.append_events(IO.log_rows(part), log_dir)
    schema = T.StructType(EVENT_LOG.fields + [T.StructField("day", T.DateType())])
    out = scratch_path(spark, "s8-out")

    def handle(matched, batch_id):
        D.dispatch_python(matched, lake.activity(ev), lake.ACTIVITY_FILE_KEYS,
                          lake.activity_file_name(), A.purchase_delta,
                          "event_id long, value_delta double", out, batch_id=batch_id)

    q = start_dispatch_stream(spark, log_dir, schema, lambda df: df.drop("day"),
                              lake.registrations(log), handle,
                              checkpoint=scratch_path(spark, "s8-ckpt"), max_files_per_trigger=8)
    q.awaitTermination()
    streamed = sorted(tuple(r) for r in D.read_outputs(spark, out, A.DISPATCH_OUT_DDL).collect())
    batch = sorted(tuple(r) for r in A.dispatch_batch(spark, SMOKE_DIR).collect())
    assert streamed == batch and len(batch) > 0
