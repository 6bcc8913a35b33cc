"""Dispatch over many files, its limits, the ledger, registrations and scratch space."""

import os
import re
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakehook.operators import ledger
from lakehook.operators.match import match_triggers
from lakehook.operators.registrations import RegistrationStore
from lakehook.plans import dispatch as D
from lakehook.plans.transforms import per_file_transform, sql_per_file
from lakehook.schemas import EVENT_LOG, FILES, TRANSFORMS
from lakehook.session import checkpoint_root, scratch_path, scratch_scope, stored, time_limit
from lakehook.sources import files as IO
from lakehook.sources import storage

NOW = datetime(2024, 6, 1)


def scratch_folders(spark):
    root = re.sub("^file:/+", "/", checkpoint_root(spark)) + "/lakehook"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def jobs_of(spark, work):
    """Number of Spark jobs that ``work`` runs."""
    sc, group = spark.sparkContext, f"count-{time.time()}"
    sc.setJobGroup(group, group)
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup("", "")


def registrations(spark, *rows):
    """(transform_id, in_dataset_id, out_dataset_id, src_file, timeout) of user 1."""
    return spark.createDataFrame([
        (1, t, f"t{t}", "datasets", i, "POST", "file", "datasets", o, "POST", "file", src, Decimal(limit), True)
        for t, i, o, src, limit in rows], TRANSFORMS)


def landed(spark, n, rows=20, fmt="parquet"):
    """n files of (k, v, name, user_id) in one dataset: events, and their rows."""
    root = scratch_path(spark, "many")
    df = spark.range(n * rows).select((F.col("id") % n).alias("f"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"),
                                      F.lit("x").alias("name"), F.lit(5).cast("long").alias("user_id"))
    named = df.withColumn("file", F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(f".{fmt}")))
    named.drop("f").repartition("file").write.partitionBy("file").format(fmt).option("header", True).save(f"{root}/landing")
    land = named.select(F.col("file").alias("name"), F.concat(F.lit(f"{root}/landing/file="), "file").alias("landing_path"),
                        F.lit(fmt).alias("file_extension")).distinct()
    return root, land, [r.asDict() for r in df.collect()]


def test_ingest_runs_as_many_jobs_for_many_files_as_for_few(spark):
    counts = {}
    for fmt in ("parquet", "csv"):
        for n in (3, 90):
            root, land, rows = landed(spark, n, 4, fmt)
            out = {}

            def work():
                files, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/lake", 1, 7, "o", NOW, 1, 1,
                                          csv_schema="k long, v double, name string, user_id long")
                out["files"], out["events"] = files.collect(), events.collect()

            counts[fmt, n] = jobs_of(spark, work)
            assert len(out["files"]) == len(out["events"]) == n
            assert {r["size_bytes"] > 0 for r in out["files"]} == {True}
            got = spark.read.parquet(*[r["path"] for r in out["files"]])
            assert sorted(got.select("k", "v", "name", "user_id").collect()) == sorted(
                (r["k"], r["v"], r["name"], r["user_id"]) for r in rows)
    # adaptive stages may add a few; a job per file would add 87
    for fmt in ("parquet", "csv"):
        assert counts[fmt, 90] <= counts[fmt, 3] + 15, counts


def test_ingest_of_csv_headers_empty_files_and_plain_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("y,x\n5,6\n")
    (tmp_path / "only header.csv").write_text("x,y\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "c%20d.csv").write_text("x,,x\n7,8,9\n")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "dir.parquet"))
    part = next(p for p in (tmp_path / "dir.parquet").iterdir() if p.name.endswith(".parquet"))
    (tmp_path / "one.pq").write_bytes(part.read_bytes())
    names = ["a.csv", "b.csv", "only header.csv", "none.csv", "c%20d.csv", "dir.parquet", "one.pq"]
    land = spark.createDataFrame([(n, str(tmp_path / n), n.split(".")[-1].upper()) for n in names],
                                 "name string, landing_path string, file_extension string")
    root = scratch_path(spark, "mixed")
    files, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), root, 1, 7, "o", NOW, 1, 1,
                              csv_schema="x int, y int")
    by_name = {r["name"]: r["path"] for r in files.collect()}
    assert events.count() == 7 and by_name["one.parquet"] == f"{re.sub('^file:/+', '/', root)}/one.parquet"
    rows = {n: [tuple(r) for r in spark.read.parquet(p).collect()] for n, p in by_name.items() if n != "none.parquet"}
    assert sorted(rows["a.parquet"]) == [(1, 2), (3, 4)] and rows["b.parquet"] == [(5, 6)]
    assert rows["only header.parquet"] == [] and rows["c%20d.parquet"] == [("7", "8", "9")]
    assert sorted(rows["dir.parquet"]) == sorted(rows["one.parquet"]) == [(0,), (1,), (2,)]
    assert spark.read.parquet(by_name["only header.parquet"]).columns == ["x", "y"]
    # again: catalog unchanged in size, no event, the file replaced
    (tmp_path / "a.csv").write_text("x,y\n10,20\n")
    files2, events2 = IO.ingest(spark, land.where("name = 'a.csv'"), files.checkpoint(), root, 1, 7, "o", NOW, 20, 20, csv_schema="x int, y int")
    assert files2.count() == 7 and events2.count() == 0
    assert [tuple(r) for r in spark.read.parquet(by_name["a.parquet"]).collect()] == [(10, 20)]
    with pytest.raises(ValueError, match="xlsx"):
        IO.ingest(spark, spark.createDataFrame([("a", "a", "xlsx")], land.schema), files, root, 1, 7, "o", NOW, 1, 1)


AGGREGATE = "SELECT count(*) AS n, max(v) AS top, min(name) AS name FROM return_arrow_table WHERE k % 2 = 0;"


@pytest.mark.parametrize("per_job", [10_000, 17])
def test_sql_over_many_files_is_one_job_per_block_of_files(spark, per_job):
    root, land, rows = landed(spark, 60)
    _, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/lake", 1, 7, "o", NOW, 1, 1)
    events = events.checkpoint()
    regs = registrations(spark, (1, 7, 2, "total.sql", 200), (2, 8, 2, "other.sql", 200))
    before = scratch_folders(spark)
    made = {}

    def work():
        with scratch_scope(spark):
            made["m"] = D.dispatch_files(spark, match_triggers(events, regs), lambda s: ("sql", AGGREGATE), f"{root}/out",
                                         files_per_job=per_job).collect()

    jobs = jobs_of(spark, work)
    assert jobs < (45 if per_job > 60 else 45 * 5)
    assert scratch_folders(spark) == before
    assert len(made["m"]) == 60 and all(r["error"] is None and r["n_rows"] == 1 for r in made["m"])
    manifest = spark.read.schema(D.MANIFEST).parquet(f"{root}/out-manifest/batch_id=0")
    got = {r["source_file"].split("/")[-1]: spark.read.parquet(r["path"]).first() for r in made["m"][:5]}
    each = {}
    for r in rows:
        if r["k"] % 2 == 0:
            each.setdefault(f"f{r['f']}.parquet", []).append(r["v"])
    want = {f"f{k}.parquet": (len(each.get(f"f{k}.parquet", [])), max(each.get(f"f{k}.parquet", [None]))) for k in range(60)}
    assert all((g["n"], g["top"]) == want[f] for f, g in got.items())
    assert manifest.count() == 60 and manifest.select("path").distinct().count() == 60


@pytest.mark.parametrize("script", [
    "SELECT * FROM return_arrow_table a",
    "SELECT k, v, avg(v) OVER (ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM return_arrow_table",
    "SELECT v, count(*) AS n FROM return_arrow_table GROUP BY v HAVING count(*) > 1",
    "SELECT k FROM return_arrow_table ORDER BY v DESC, k LIMIT 3",
    "WITH t AS (SELECT v, sum(k) AS s FROM return_arrow_table GROUP BY v) SELECT a.v, b.s FROM t a JOIN t b ON a.v = b.v -- end",
    "SELECT v, 1 AS side FROM return_arrow_table WHERE k < 30 UNION ALL SELECT max(v), 2 FROM return_arrow_table",
    "SELECT DISTINCT v FROM return_arrow_table",
    "SELECT count(*) AS n, count(DISTINCT v) AS d FROM return_arrow_table WHERE k > 1000000",
])
def test_a_script_over_all_files_equals_the_script_over_each(spark, script):
    rows = spark.range(60).selectExpr("id as k", "cast(id % 7 as double) as v", "concat('f', id % 4) as source_file")
    files = spark.createDataFrame([(f"f{k}", k) for k in range(5)], "lake_source string, lake_user long")
    session = spark.newSession()
    mine, some = session.createDataFrame(rows.toPandas()), session.createDataFrame(files.toPandas())
    got = sorted((tuple(r) for r in sql_per_file(script, mine, some, ("source_file", "lake_source")).collect()), key=repr)
    want = []
    for k in range(5):
        one = spark.newSession()
        one.createDataFrame(rows.where(F.col("source_file") == f"f{k}").drop("source_file").toPandas(), "k long, v double") \
            .createOrReplaceTempView("return_arrow_table")
        want += [(f"f{k}", k, *r) for r in one.sql(script).collect()]
    assert got == sorted(want, key=repr) and got


def test_files_whose_script_raises_are_found_by_halving(spark):
    root, land, _ = landed(spark, 12)
    _, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/lake", 1, 7, "o", NOW, 1, 1)
    events = events.checkpoint()
    script = "SELECT k, CASE WHEN k IN (5, 6) THEN raise_error('bad row') END AS e FROM return_arrow_table"
    run = lambda body, kind="sql", batch=1: {r["name"]: (r["n_rows"], r["error"]) for r in D.dispatch_files(
        spark, match_triggers(events, registrations(spark, (1, 7, 2, "bad.sql", 200))), lambda s: (kind, body), f"{root}/out",
        batch).collect()}
    done = run(script)
    assert {n for n, (_, e) in done.items() if e} == {"f5.parquet", "f6.parquet"}
    assert [e for _, e in done.values() if e and "bad row" not in e] == []
    assert {n for n, e in done.values() if not e} == {20}
    # a script that cannot be planned fails every file, and earlier outputs stay
    done = run("SELECT nothing FROM return_arrow_table", batch=2)
    assert all(e and n is None for n, e in done.values()) and len(done) == 12
    paths = [r["path"] for r in spark.read.parquet(f"{root}/out-manifest/batch_id=1").where("error is null").collect()]
    assert spark.read.parquet(*paths).count() == 200
    # the per-file runtimes give the same; an empty result replaces the earlier one
    kinds = lambda got: {n: (r, bool(e)) for n, (r, e) in got.items()}
    assert kinds(run(script, "sql_file", 3)) == kinds(run(script, batch=4))
    # a subquery inside a subquery is not decorrelated: the script runs file by file
    largest = run("SELECT k FROM return_arrow_table WHERE k = (SELECT max(k) FROM return_arrow_table)", batch=7)
    assert largest == {f"f{k}.parquet": (1, None) for k in range(12)}
    each = run(lambda df: df.where("k = 3"), "spark_frame", 5)
    assert sorted(n for n, _ in each.values()) == [0] * 11 + [1]
    gone = run("SELECT k FROM return_arrow_table WHERE k = 3", batch=6)
    assert sorted(n for n, _ in gone.values()) == [0] * 11 + [1]
    paths = [r["path"] for r in spark.read.parquet(f"{root}/out-manifest/batch_id=6").collect()]
    assert [tuple(r) for r in spark.read.parquet(*paths).collect()] == [(3,)]


def test_a_script_that_sleeps_is_one_failure_row(spark):
    root, land, _ = landed(spark, 5)
    _, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/lake", 1, 7, "o", NOW, 1, 1)
    events = events.checkpoint()

    def sleepy(pdf):
        import time
        if (pdf["k"] == 3).any():
            time.sleep(60)
        return pdf[["k"]]

    def slow_frame(df):
        slow = F.udf(lambda k: time.sleep(60) or k if k == 3 else k, "long")
        return df.select(slow("k").alias("k"))

    for src, runtime in (("a.py", ("pandas_file", sleepy, "k long")), ("b.py", ("spark_frame", slow_frame))):
        began = time.time()
        regs = registrations(spark, (1, 7, 2, src, 6))
        done = {r["name"]: r for r in D.dispatch_files(spark, match_triggers(events, regs), lambda s: runtime, f"{root}/out").collect()}
        assert time.time() - began < 55
        assert {n for n, r in done.items() if r["error"]} == {"f3.parquet"}
        assert "TimeoutError: ended after 6 s" in done["f3.parquet"]["error"]
        assert {r["n_rows"] for n, r in done.items() if n != "f3.parquet"} == {20}


def test_time_limits_end_jobs_and_leave_others(spark):
    slow = F.udf(lambda k: time.sleep(30) or k, "long")
    began = time.time()
    with pytest.raises(TimeoutError, match="ended after 2 s"):
        with time_limit(spark, 2):
            spark.range(1).select(slow("id")).collect()
    assert time.time() - began < 25
    with time_limit(spark, 60):
        assert spark.range(3).count() == 3
    with pytest.raises(ZeroDivisionError):
        with time_limit(spark, 60):
            1 / 0
    df = per_file_transform(spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, k long"),
                            lambda pdf: pdf, "k long", failures=True, timeout=30)
    assert df.count() == 2


def test_scratch_scopes_remove_what_was_made_inside(spark):
    before = scratch_folders(spark)
    with scratch_scope(spark):
        kept = stored(spark.range(5), "inner")
        with scratch_scope(spark):
            stored(spark.range(5), "innermost")
        assert kept.count() == 5 and len(scratch_folders(spark) - before) == 1
    assert scratch_folders(spark) == before


def test_bad_csv_rows_are_rejected_with_file_and_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,a,2.5\n,b,\n3,"c,d",1\nmany,e,1\n5,f\n6,g,7,8\n7,h,word\n')
    (tmp_path / "b.csv").write_text("x,y,z\n9,i,0\n\n")
    good, bad = IO.read_csv_checked(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), schema="x int, y string, z double")
    assert sorted((tuple(r) for r in good.collect()), key=repr) == sorted(
        [(1, "a", 2.5), (None, "b", None), (3, "c,d", 1.0), (9, "i", 0.0)], key=repr)
    assert sorted(tuple(r) for r in bad.collect()) == sorted((str(tmp_path / "a.csv"), line, why) for line, why in (
        ("many,e,1", "type"), ("5,f", "columns"), ("6,g,7,8", "columns"), ("7,h,word", "type")))
    # whatever is selected, the fates stay
    assert good.select("y").count() == 4 and sorted(r[0] for r in bad.select("reason").collect()) == ["columns", "columns", "type", "type"]


def test_storage_paths():
    store, path = storage.open_store("file:///tmp/a%20b/c=d.parquet")
    assert path == "/tmp/a%20b/c=d.parquet" and type(store).__name__ == "LocalFileSystem"
    assert storage.open_store("/tmp/x")[1] == storage.open_store("file:/tmp/x")[1] == "/tmp/x"
    assert storage.named(["a", "", "A", "b"]) == ["a0", "_c1", "A2", "b"]


# --- ledger ---

def event_rows(spark, days, first=1):
    """One event per (day, id): object-less events of user 1 on dataset 7."""
    rows = [(first + k, None if d is None else datetime(2024, 1, d, 12), 1, "POST", 7) for k, d in enumerate(days)]
    return IO.log_rows(spark.createDataFrame(rows, "log_id long, created_timestamp timestamp_ntz, user_id long, action string, dataset_id long"))


def files_of(path):
    out = {}
    for folder, _, names in os.walk(re.sub("^file:/+", "/", path)):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return out


def test_a_batch_reads_pending_days_only(spark):
    log = scratch_path(spark, "ledger-test")
    ledger.append(event_rows(spark, [1, 1, 2, 3, None]), log)
    assert [r["log_id"] for r in ledger.pending_events(spark, log).orderBy("log_id").collect()] == [1, 2, 3, 4, 5]
    ledger.mark(spark, log, 5, 1)
    assert ledger.open_days(spark, log) == [] and ledger.pending_events(spark, log).count() == 0
    ledger.append(event_rows(spark, [2, 4, None], first=6), log)  # one late event in day 2
    pending = ledger.pending_events(spark, log)
    assert [r["log_id"] for r in pending.orderBy("log_id").collect()] == [6, 7, 8]
    plan = pending._jdf.queryExecution().executedPlan().toString()
    pruned = re.search(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan).group(1)
    assert set(re.findall(r"2024-01-\d\d", pruned)) == {"2024-01-02", "2024-01-04"} and "isnull(day" in pruned
    # ranges out of order merge when the gap closes
    ledger.mark(spark, log, 8, 3, from_id=8)
    assert ledger.covered_ranges(spark, log) == [(ledger.LOWEST, 5), (8, 8)]
    assert [r["log_id"] for r in ledger.pending_events(spark, log).orderBy("log_id").collect()] == [6, 7]
    ledger.mark(spark, log, 7, 2, from_id=6)
    ledger.mark(spark, log, 7, 2, from_id=6)  # a repeated batch
    assert ledger.covered_ranges(spark, log) == [(ledger.LOWEST, 8)]
    assert {r["processed"] for r in ledger.all_events(spark, log).collect()} == {True}


def test_compaction_rewrites_touched_days_only(spark):
    log = scratch_path(spark, "compact-test")
    assert ledger.covered_ranges(spark, log) == [] and ledger.compact(spark, log) == []
    ledger.append(event_rows(spark, [1, 2, 3]), log)
    ledger.mark(spark, log, 2, 1)
    assert [str(d) for d in ledger.compact(spark, log)] == ["2024-01-01", "2024-01-02"]
    flags = {r["log_id"]: r["processed"] for r in ledger.read_log(spark, log).collect()}
    assert flags == {1: True, 2: True, 3: False}
    assert ledger.compact(spark, log) == []
    before = files_of(log)
    ledger.append(event_rows(spark, [3, 5], first=4), log)
    ledger.mark(spark, log, 5, 2)
    days = ledger.compact(spark, log)
    assert [str(d) for d in days] == ["2024-01-03", "2024-01-05"]
    after = files_of(log)
    assert {f: t for f, t in before.items() if "day=2024-01-01" in f or "day=2024-01-02" in f}.items() <= after.items()
    assert {r["log_id"]: r["processed"] for r in ledger.read_log(spark, log).collect()} == dict.fromkeys(range(1, 6), True)
    # a replayed append under a writer's name replaces its first attempt
    for _ in range(2):
        ledger.append(event_rows(spark, [5], first=6), log, writer="batch-9")
    assert ledger.read_log(spark, log).count() == 6 and ledger.next_log_id(spark, log) == 7


def test_log_batches_dispatch_once_and_repeat_safely(spark):
    root, land, _ = landed(spark, 4)
    files, events = IO.ingest(spark, land, spark.createDataFrame([], FILES), f"{root}/lake", 1, 7, "o", NOW, 1, 1)
    files, log = files.checkpoint(), f"{root}/log"
    ledger.append(spark.createDataFrame([], EVENT_LOG).unionByName(events), log)
    regs = registrations(spark, (1, 7, 2, "n.sql", 200), (2, 2, 3, "n.sql", 200))
    resolve = lambda s: ("sql", "SELECT count(*) AS n FROM return_arrow_table")
    before = files_of(log)
    folders = scratch_folders(spark)
    run = lambda batch, cat, out: D.run_log_batch(spark, log, regs, cat, resolve, f"{root}/out", out, NOW, batch)
    real_mark = ledger.mark
    try:  # the first attempt fails after its outputs are written
        ledger.mark = lambda *a, **k: 1 / 0
        with pytest.raises(ZeroDivisionError):
            run(1, files, f"{root}/files1")
    finally:
        ledger.mark = real_mark
    got = run(1, files, f"{root}/files1")
    assert (got["dispatched"], got["failed"], got["outputs"]) == (4, 0, 4)
    assert before.items() <= files_of(log).items()  # the log's files stay as they are
    after = ledger.all_events(spark, log)
    assert after.count() == 8 and after.where("is_transform_output").count() == 4
    assert scratch_folders(spark) == folders
    again = run(2, spark.read.parquet(f"{root}/files1"), f"{root}/files2")
    assert again == {"high_water": None, "dispatched": 0, "failed": 0, "outputs": 0}
    assert spark.read.parquet(f"{root}/files2").count() == 8


# --- registrations while a stream runs ---

def test_registrations_are_picked_up_between_micro_batches(spark):
    from lakehook.streaming.trigger_stream import start_dispatch_stream

    src, path = scratch_path(spark, "versions-src"), scratch_path(spark, "versions")
    store = RegistrationStore(spark, path)
    with pytest.raises(ValueError):
        store.read()
    assert store.publish(registrations(spark, (1, 7, 2, "a.sql", 200))) == 1
    for k in range(20):
        rows = event_rows(spark, [1, 2], first=1 + 2 * k).withColumn("object_details", F.lit('{"path": "/x"}'))
        rows.coalesce(1).write.mode("append").parquet(src)
    seen, folders = {}, []
    keep = scratch_path(spark, "versions-ckpt")

    def handle(matched, batch_id):
        seen[batch_id] = {(r["transform_id"]) for r in matched.collect()}
        stored(matched, "batch-scratch")
        folders.append(len(scratch_folders(spark)))
        if batch_id == 4:
            RegistrationStore(spark, path).publish(registrations(spark, (9, 7, 2, "b.sql", 200)))
        if batch_id == 9:
            RegistrationStore(spark, path).publish(registrations(spark, (10, 8, 2, "b.sql", 200)))

    q = start_dispatch_stream(spark, src, EVENT_LOG, lambda df: df, store, handle, checkpoint=keep, max_files_per_trigger=1)
    q.awaitTermination()
    assert len(seen) == 20
    assert [seen[b] for b in (0, 4, 5, 9, 10, 19)] == [{1}, {1}, {9}, {9}, set(), set()]
    assert max(folders) - min(folders) <= 1, folders  # the ranked table of one version, the batch's own
    assert store.read(1).first()["transform_id"] == 1 and store.current() == 3
    left = len(scratch_folders(spark))
    store.close()
    assert len(scratch_folders(spark)) == left - 1


# --- declared columns, as-of join, sketches, reach ---

def test_declared_columns_need_no_footer_and_no_header_job_per_file(spark):
    root = scratch_path(spark, "declared")
    for k in range(6):
        spark.range(3).selectExpr(f"id + {10 * k} as a", "id as b").coalesce(1).write.parquet(f"{root}/p{k}.parquet")
        spark.range(3).selectExpr(*(["id as a", "id as c"] if k % 2 else ["id as c", "id as a"])).coalesce(1) \
            .write.option("header", True).csv(f"{root}/c{k}.csv")
    files = spark.createDataFrame([(1, 2, f"{root}/p{k}.parquet", "parquet") for k in range(6)]
                                  + [(1, 2, f"{root}/c{k}.csv", "CSV") for k in range(6)],
                                  "user_id long, dataset_id long, path string, file_extension string")
    datasets = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, dataset_id long")
    with pytest.raises(Exception):
        IO.declare_columns(datasets, 1, 2, "not a schema,")
    datasets = IO.declare_columns(datasets, 1, 2, "c long, a long")
    datasets = IO.declare_columns(datasets, 1, 3, "z string")
    assert {r["dataset_id"]: r["columns"] for r in datasets.collect()} == {2: "c long, a long", 3: "z string"}
    out = {}
    jobs = jobs_of(spark, lambda: out.update(df=IO.scan_dataset(spark, files, 1, 2, datasets=datasets)))
    df = out["df"]
    assert df.columns == ["c", "a", IO.SOURCE_FILE_COL] and dict(df.dtypes)["a"] == "bigint" and jobs <= 10
    assert df.count() == 36 and df.where("c is null").count() == 18 and df.where("a >= 50").count() == 3


def test_asof_join_against_brute_force(spark):
    import random

    from lakehook.operators.asof import asof_join

    rng = random.Random(2)
    left = [(rng.choice([0, 0, 0, 1, None]), rng.choice([None, *range(40)]), k) for k in range(200)]
    right = [(rng.choice([0, 0, 1, 2, None]), rng.choice([None, *range(0, 40, 3)]), rng.randint(0, 9)) for _ in range(60)]
    want = []
    for g, t, k in left:
        found = max(((t2, v) for g2, t2, v in right if None not in (g, t, t2) and g2 == g and t2 <= t), default=(None, None))
        want.append((g, t, k, *found))
    df = spark.createDataFrame(left, "g int, t int, k int")
    marks = spark.createDataFrame(right, "g int, t int, v int")
    for bucket in (F.lit(0), F.floor(F.col("t") / 5), F.col("t")):
        got = asof_join(df, marks, ["g"], "t", bucket)
        assert got.columns == ["g", "t", "k", "right_t", "right_v"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert asof_join(df.limit(0), marks, ["g"], "t", F.lit(0)).count() == 0
    assert {r["right_t"] for r in asof_join(df, marks.limit(0), ["g"], "t", F.lit(0)).collect()} == {None}


def test_sketches_of_days_merge_to_all_days(spark):
    from lakehook.operators import sketches as SK

    df = spark.range(20_000).selectExpr("id % 2 as g", "id % 5 as day", "id % 3000 as u", "cast(id as double) as v")
    kept = SK.sketch(df, ["g", "day"], "u", "v")
    assert kept.count() == 10
    for r in SK.merged(kept, ["g"], 0.25).collect():
        exact = df.where(F.col("g") == r["g"])
        assert r["n"] == 10_000 and abs(r["distinct_values"] - exact.select("u").distinct().count()) <= 4 * SK.ERROR * 1500
        rank = exact.where(F.col("v") <= r["quantile"]).count() / 10_000
        assert abs(rank - 0.25) <= SK.RANK_ERROR


def test_reach_ends_on_cycles(spark):
    from lakehook.operators.reach import reach

    steps = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (6, 7), (None, 1), (1, None)]
    df = spark.createDataFrame(steps, "in_dataset_id long, out_dataset_id long")
    got = {(r[0], r[1]): r[2] for r in reach(df).collect()}
    edges, want, frontier, hops = {s for s in steps if None not in s}, {}, None, 0
    frontier = set(edges)
    while frontier:
        hops += 1
        want.update({p: hops for p in frontier})
        frontier = {(a, d) for a, b in frontier for c, d in edges if b == c} - set(want)
    assert got == want and got[1, 1] == 3
    assert reach(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        reach(spark.createDataFrame([(k, k + 1) for k in range(6)], df.schema), max_rounds=3)
