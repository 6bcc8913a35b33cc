"""Operator tests on tiny hand-written frames, including the edge cases of
the data model (SURVEY section 5)."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakehook.functions import predicates as P
from lakehook.functions import scalars as S
from lakehook.operators import lifecycle as LC
from lakehook.operators import lookup as L
from lakehook.operators import mutate as M
from lakehook.operators import quality as Q
from lakehook.operators.match import gate, mark_processed, match_triggers

LOG_DDL = ("log_id long, user_id long, service string, dataset_id long, action string, "
           "object string, is_transform_output boolean, processed boolean")
REG_DDL = ("transform_id long, user_id long, in_service string, in_dataset_id long, "
           "in_action string, in_object string, out_dataset_id long, out_action string, "
           "enabled boolean")


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG_DDL)


def _regs(spark, rows):
    return spark.createDataFrame(rows, REG_DDL)


# ---------------------------------------------------------------- J2 / J3 / M5
def test_disabled_first_registration_hides_enabled_second(spark):
    log = _log(spark, [(1, 7, "datasets", 3, "POST", "file", False, False)])
    regs = _regs(spark, [(10, 7, "datasets", 3, "POST", "file", 4, "POST", False),
                         (20, 7, "datasets", 3, "POST", "file", 5, "POST", True)])
    assert match_triggers(log, regs).count() == 0
    fired = match_triggers(log, regs, policy="all").select("transform_id").collect()
    assert [r[0] for r in fired] == [20]


def test_put_output_is_not_dispatched(spark):
    log = _log(spark, [(1, 7, "datasets", 3, "POST", "file", False, False)])
    regs = _regs(spark, [(10, 7, "datasets", 3, "POST", "file", 4, "PUT", True)])
    assert match_triggers(log, regs).count() == 0


def test_first_match_is_lowest_id_and_at_most_once_per_event(spark):
    log = _log(spark, [(1, 7, "datasets", 3, "POST", "file", False, False),
                       (2, 7, "datasets", 3, "POST", "file", False, False)])
    regs = _regs(spark, [(30, 7, "datasets", 3, "POST", "file", 6, "POST", True),
                         (10, 7, "datasets", 3, "POST", "file", 4, "POST", True),
                         (20, 7, "datasets", 3, "POST", "file", 5, "POST", True)])
    out = match_triggers(log, regs).select("log_id", "transform_id", "out_dataset_id").collect()
    assert sorted(tuple(r) for r in out) == [(1, 10, 4), (2, 10, 4)]


def test_processed_and_transform_output_never_trigger(spark):
    log = _log(spark, [(1, 7, "datasets", 3, "POST", "file", True, False),
                       (2, 7, "datasets", 3, "POST", "file", False, True),
                       (3, 7, "datasets", 3, "POST", "file", None, False)])
    regs = _regs(spark, [(10, 7, "datasets", 3, "POST", "file", 4, "POST", True)])
    assert [r[0] for r in match_triggers(log, regs).select("log_id").collect()] == [3]


def test_key_mismatch_on_any_part(spark):
    log = _log(spark, [(1, 7, "datasets", 3, "PUT", "file", False, False),
                       (2, 8, "datasets", 3, "POST", "file", False, False),
                       (3, 7, "datasets", 4, "POST", "file", False, False),
                       (4, 7, "other", 3, "POST", "file", False, False),
                       (5, 7, "datasets", None, "POST", "file", False, False)])
    regs = _regs(spark, [(10, 7, "datasets", 3, "POST", "file", 4, "POST", True)])
    assert match_triggers(log, regs).count() == 0


def test_gate_needs_any_registration_on_dataset(spark):
    log = _log(spark, [(1, 1, "datasets", 3, "POST", "file", False, False),
                       (2, 1, "datasets", 9, "POST", "file", False, False),
                       (3, 1, "datasets", 3, "POST", "file", True, False)])
    regs = _regs(spark, [(10, 99, "datasets", 3, "POST", "file", 4, "POST", True)])
    assert [r[0] for r in gate(log, regs).select("log_id").collect()] == [1]


def test_mark_processed_up_to_high_water(spark):
    log = _log(spark, [(1, 1, "c", 1, "POST", "file", False, False),
                       (5, 1, "c", 1, "POST", "file", False, False),
                       (9, 1, "c", 1, "POST", "file", False, False)])
    out = dict(mark_processed(log, 5).select("log_id", "processed").collect())
    assert out == {1: True, 5: True, 9: False}


# ---------------------------------------------------------------- P
def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, None, 2.0)],
                               "id long, s string, v double")
    ids = lambda c: sorted(r[0] for r in df.filter(c).select("id").collect())
    assert ids(P.where([("s", "a")])) == [1]
    assert ids(P.where([("s", None)])) == [3]
    assert ids(P.where([("s", "Null")], [True])) == [1, 2]
    assert ids(P.where([("id", [1, 3])])) == [1, 3]          # numeric IN
    assert ids(P.where([("id", [])])) == [1, 2, 3]            # empty list dropped
    assert ids(P.where([("id", [1, 3])], [True])) == [2]      # NOT IN
    assert ids(P.where([("s", "a")], [True])) == [2]          # != drops NULL like SQL
    assert ids(P.where([("v", None), ("id", [2, 3])], [True, False])) == [2, 3]
    with pytest.raises(ValueError):
        P.where([("s", "a")], [True, False])


def test_apply_slots_top_k(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    out = P.apply_slots(df, group_by=["k"], aggregations=[F.sum("v").alias("t")],
                        order_by=[F.desc("t")], limit=1).collect()
    assert [tuple(r) for r in out] == [("y", 3)] or [tuple(r) for r in out] == [("x", 3)]


# ---------------------------------------------------------------- J1 / J6 / A1 / A2
def test_name_to_id_miss_gives_sentinel(spark):
    req = spark.createDataFrame([(1, "ann"), (2, "zed")], "rid long, name string")
    dim = spark.createDataFrame([(10, "ann"), (11, "ann"), (12, "bob")], "id long, name string")
    out = dict(L.name_to_id(req, "name", dim, "name", "id", "uid").select("rid", "uid").collect())
    assert out == {1: 10, 2: 999999999}
    many = L.name_to_id(req, "name", dim, "name", "id", "uid", one_result=False)
    assert sorted((r[0], r[1]) for r in many.select("rid", "uid").collect()) == \
        [(1, 10), (1, 11), (2, None)]


def test_resolve_owned_requires_every_key(spark):
    req = spark.createDataFrame([(1, 7, 3), (2, 7, 4)], "rid long, u long, d long")
    cat = spark.createDataFrame([(7, 3, "f.csv")], "user_id long, dataset_id long, name string")
    out = L.resolve_owned(req, cat, [("u", "user_id"), ("d", "dataset_id")])
    got = sorted((r["rid"], r["name"], r["found"]) for r in out.collect())
    assert got == [(1, "f.csv", True), (2, None, False)]


def test_first_per_key_with_hot_key(spark):
    rows = [(1, i, f"e{i}") for i in range(2000)] + [(2, 5, "x"), (2, 3, "y")]
    df = spark.createDataFrame(rows, "k long, t long, name string").repartition(8)
    out = {r["k"]: (r["t"], r["name"]) for r in L.first_per_key(df, "k", ["t"]).collect()}
    assert out == {1: (0, "e0"), 2: (3, "y")}
    counts = {r[0]: r[1] for r in L.count_per_key(df, "k").collect()}
    assert counts == {1: 2000, 2: 2}


# ---------------------------------------------------------------- M / J5
def test_upsert_twice_equals_once(spark):
    base = spark.createDataFrame([("p1", 1, datetime(2024, 1, 1))], "path string, id long, lm timestamp_ntz")
    inc = spark.createDataFrame([("p1", 9, datetime(2024, 2, 1)), ("p2", 2, datetime(2024, 2, 1))],
                                "path string, id long, lm timestamp_ntz")
    once = M.upsert(base, inc, ["path"], bump=["lm"])
    twice = M.upsert(once, inc, ["path"], bump=["lm"])
    got = sorted(tuple(r) for r in once.collect())
    assert got == [("p1", 1, datetime(2024, 2, 1)), ("p2", 2, datetime(2024, 2, 1))]
    assert sorted(tuple(r) for r in twice.collect()) == got


def test_update_patch_insert_delete(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, s string, n long")
    upd = M.update_rows(base, spark.createDataFrame([(2,)], "id long"), ["id"], {"s": "z"})
    assert sorted(tuple(r) for r in upd.collect()) == [(1, "a", 10), (2, "z", 20)]
    patch = spark.createDataFrame([(1, None, 11), (2, "q", None)], "id long, s string, n long")
    pat = M.patch_rows(base, patch, ["id"])
    assert sorted(tuple(r) for r in pat.collect()) == [(1, "a", 11), (2, "q", 20)]
    ins = M.insert_rows(base, spark.createDataFrame([(3, "c")], "id long, s string"))
    assert sorted(tuple(r) for r in ins.collect())[-1] == (3, "c", None)
    dele = M.delete_rows(base, spark.createDataFrame([(1,)], "id long"), ["id"])
    assert [r[0] for r in dele.collect()] == [2]


def test_cascade_delete_leaves_no_orphans(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    datasets = spark.createDataFrame([(10, 1), (20, 2)], "dataset_id long, user_id long")
    files = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "file_id long, dataset_id long")
    doomed = users.filter("user_id = 1")
    kept_ds, kept_files = M.cascade_delete(
        [(datasets, ["user_id"], ["dataset_id"]), (files, ["dataset_id"], ["file_id"])], doomed)
    assert sorted(r[0] for r in kept_ds.select("dataset_id").collect()) == [20]
    assert sorted(r[0] for r in kept_files.select("file_id").collect()) == [200, 300]


# ---------------------------------------------------------------- J4 / M7
def test_lifecycle_age_equals_threshold(spark):
    files = spark.createDataFrame(
        [(1, "d1", date(2024, 1, 5), "hot"), (2, "d1", date(2024, 1, 4), "hot"),
         (3, "d2", date(2024, 1, 5), "hot")],
        "file_id long, dataset string, created date, storage_class string")
    ds = spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset string, lifecycle_id long")
    rules = spark.createDataFrame([(1, True), (2, False)], "lifecycle_id long, rule_enabled boolean")
    trans = spark.createDataFrame([(1, 3, "cold"), (1, 3, "archive"), (2, 3, "cold")],
                                  "lifecycle_id long, days_till_transition int, transition_to string")
    due = LC.due_transitions(ds, rules, trans)
    out = dict(LC.apply_transitions(files, due, "2024-01-08").select("file_id", "storage_class").collect())
    assert out == {1: "archive", 2: "hot", 3: "hot"}


# ---------------------------------------------------------------- F
def test_scalars(spark):
    df = spark.createDataFrame(
        [(1023, "a.b.csv", "/lake/u/d/a.b.csv", ' <my>:"name". ', "x,,y,", datetime(2024, 1, 1, 0, 0, 7)),
         (1024, "noext", "/f", "ok", "", datetime(2024, 7, 1, 12, 0, 0, 500000)),
         (1152, "x.parquet", "/a/x.parquet", "..dots..", ",", datetime(2024, 1, 1))],
        "n long, name string, path string, raw string, tags string, ts timestamp_ntz")
    out = df.select(
        S.human_size("n").alias("size"), S.file_extension("name").alias("ext"),
        S.base_name("path").alias("base"), S.force_parquet_extension("path").alias("pq"),
        S.parent_dirs("path").alias("parents"), S.sanitize_name("raw").alias("clean"),
        S.split_tags("tags").alias("tags"), S.iso_timestamp("ts").alias("iso"),
        S.local_time("ts").alias("local")).collect()
    assert [r["size"] for r in out] == ["1023 bytes", "1.00 KB", "1.12 KB"]
    assert [r["ext"] for r in out] == ["csv", "noext", "parquet"]
    assert [r["base"] for r in out] == ["a.b.csv", "f", "x.parquet"]
    assert [r["pq"] for r in out] == ["/lake/u/d/a.b.parquet", "/f.parquet", "/a/x.parquet"]
    assert [r["parents"] for r in out] == [["/lake", "/lake/u", "/lake/u/d"], [], ["/a"]]
    assert [r["clean"] for r in out] == ["myname", "ok", "dots"]
    assert [r["tags"] for r in out] == [["x", "y"], [], []]
    assert [r["iso"] for r in out] == ["2024-01-01T00:00:07", "2024-07-01T12:00:00.500000",
                                       "2024-01-01T00:00:00"]
    assert out[0]["local"] == datetime(2023, 12, 31, 17, 0, 7)
    assert out[1]["local"] == datetime(2024, 7, 1, 6, 0, 0)       # daylight saving time


def test_human_size_units(spark):
    df = spark.createDataFrame([(1024 ** 2,), (int(1.5 * 1024 ** 3),), (0,)], "n long")
    assert [r[0] for r in df.select(S.human_size("n")).collect()] == ["1.00 MB", "1.50 GB", "0 bytes"]


# ---------------------------------------------------------------- Q1
def test_quality_rules(spark):
    df = spark.createDataFrame([("Customer#1", "AUTO", 10.0), ("short", "short", 2000.0),
                                (None, "x", None)], "name string, seg string, bal double")
    rules = [Q.length_between("len", "name", 8, 32), Q.min_distinct_chars("chars", "name", 6),
             Q.not_contained("sep", "seg", "name"), Q.at_most("bal", "bal", 1500)]
    summary = {r["rule"]: (r["n_pass"], r["n_fail"]) for r in Q.summarize(df, rules).collect()}
    assert summary == {"len": (1, 2), "chars": (1, 2), "sep": (1, 2), "bal": (1, 2)}
    flags = Q.evaluate(df, rules).select("passed_all").collect()
    assert [r[0] for r in flags] == [True, False, False]


def test_match_with_hot_user_and_salting(spark):
    """One user holds a third of all events; plain, AQE-skew and salted joins agree."""
    from pyspark.sql import functions as F
    n = 6000
    log = (spark.range(n).select(
        F.col("id").alias("log_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50 + 100).cast("long").alias("user_id"),
        F.lit("datasets").alias("service"), (F.col("id") % 4).alias("dataset_id"),
        F.lit("POST").alias("action"), F.lit("file").alias("object"),
        F.lit(False).alias("is_transform_output"), F.lit(False).alias("processed")))
    users = log.select("user_id", "dataset_id").distinct()
    regs = users.select(
        (F.col("user_id") * 10 + F.col("dataset_id")).alias("transform_id"), "user_id",
        F.lit("datasets").alias("in_service"), F.col("dataset_id").alias("in_dataset_id"),
        F.lit("POST").alias("in_action"), F.lit("file").alias("in_object"),
        ((F.col("dataset_id") + 1) % 4).alias("out_dataset_id"), F.lit("POST").alias("out_action"),
        F.lit(True).alias("enabled"))
    plain = sorted(tuple(r) for r in match_triggers(log, regs).select("log_id", "transform_id").collect())
    salted = sorted(tuple(r) for r in match_triggers(log, regs, salt_buckets=16)
                    .select("log_id", "transform_id").collect())
    assert len(plain) == n and plain == salted
    hot = [t for l, t in plain if l % 3 == 0]
    assert len(hot) == n // 3 and all(t // 10 == 7 for t in hot)


def test_match_report_statuses(spark):
    from lakehook.operators.match import match_report
    log = spark.createDataFrame(
        [(1, 7, "datasets", 3, "POST", "file", False, False, "{}"),
         (2, 7, "datasets", 4, "POST", "file", False, False, "{}"),
         (3, 7, "datasets", 5, "POST", "file", False, False, "{}"),
         (4, 7, "datasets", 6, "POST", "file", False, False, None),
         (5, 7, "datasets", 9, "POST", "file", False, False, "{}")],
        LOG_DDL + ", object_details string")
    regs = _regs(spark, [(10, 7, "datasets", 3, "POST", "file", 4, "POST", False),
                         (11, 7, "datasets", 3, "POST", "file", 4, "POST", True),
                         (20, 7, "datasets", 4, "POST", "file", 5, "PUT", True),
                         (30, 7, "datasets", 5, "POST", "file", 6, "POST", True),
                         (40, 7, "datasets", 6, "POST", "file", 7, "POST", True)])
    got = {r["log_id"]: (r["transform_id"], r["status"]) for r in match_report(log, regs).collect()}
    assert got == {1: (10, "disabled"), 2: (20, "output_not_post"), 3: (30, "dispatched"),
                   4: (40, "no_object"), 5: (None, "no_registration")}
    fired = [r["log_id"] for r in match_triggers(log, regs).collect()]
    assert fired == [3]


def test_catalog_create_and_delete_datasets(spark):
    from lakehook.operators import catalog as C
    from lakehook.schemas import DATASETS, FILES
    existing = spark.createDataFrame([(1, 10, "sales", "lake:dataset:::sales", [], None)], DATASETS)
    req = spark.createDataFrame(
        [(2, "sales", ""), (3, "logs", "a,,b"), (2, "logs", None), (4, "xy", None)],
        "user_id long, name string, tags_text string")
    snap, events, refused = C.create_datasets(existing, req, datetime(2024, 1, 1), 100, 1)
    rows = {r["name"]: (r["user_id"], r["tags"]) for r in snap.collect()}
    assert rows == {"sales": (1, []), "logs": (2, [])}
    assert sorted((r["user_id"], r["name"], r["reason"]) for r in refused.collect()) == \
        [(2, "sales", "name_taken"), (3, "logs", "name_taken"), (4, "xy", "name_length")]
    assert [(r["action"], r["description"]) for r in events.collect()] == [("POST", "datasetCreate")]
    files = spark.createDataFrame(
        [(1, 10, 1, "a.csv", "/l/1/sales/a.csv", "o", datetime(2024, 1, 1), datetime(2024, 1, 1),
          "1 bytes", 1, "csv", [], "hot"),
         (2, 11, 2, "b.csv", "/l/2/logs/b.csv", "o", datetime(2024, 1, 1), datetime(2024, 1, 1),
          "1 bytes", 1, "csv", [], "hot")], FILES)
    ds = snap.withColumn("dataset_id", F.when(F.col("name") == "logs", 11).otherwise(F.col("dataset_id")))
    # user 2 cannot delete user 1's dataset; user 1 can
    kept_ds, kept_files, ev = C.delete_datasets(
        ds, files, spark.createDataFrame([(2, 10), (1, 10)], "user_id long, dataset_id long"),
        datetime(2024, 1, 2), 5)
    assert [r["name"] for r in kept_ds.collect()] == ["logs"]
    assert [r["path"] for r in kept_files.collect()] == ["/l/2/logs/b.csv"]
    assert [r["action"] for r in ev.collect()] == ["DELETE"]
    left = C.delete_files(kept_files, spark.createDataFrame(
        [(2, 11, "/l/2/logs/b.csv")], "user_id long, dataset_id long, path string"))
    assert left.count() == 0


def test_mutations_with_repeated_keys_stay_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, s string, n long")
    patches = spark.createDataFrame([(1, "x", None), (1, None, 5)], "id long, s string, n long")
    pat = M.patch_rows(base, patches, ["id"])
    assert pat.count() == 2
    upd = M.update_rows(base, spark.createDataFrame([(1, "p"), (1, "q")], "id long, v string"),
                        ["id"], {"s": F.col("new_v")})
    assert sorted(tuple(r) for r in upd.collect()) == [(1, "q", 10), (2, "b", 20)]
    inc = spark.createDataFrame([("p1", 7, datetime(2024, 3, 1)), ("p1", 8, datetime(2024, 2, 1))],
                                "path string, id long, lm timestamp_ntz")
    cur = spark.createDataFrame([], "path string, id long, lm timestamp_ntz")
    up = M.upsert(cur, inc, ["path"], bump=["lm"]).collect()
    assert [tuple(r) for r in up] == [("p1", 7, datetime(2024, 3, 1))]


def test_catalog_update_datasets_and_delete_users(spark):
    from lakehook.operators import catalog as C
    from lakehook.schemas import DATASETS
    ds = spark.createDataFrame([(1, 10, "sales", "lake:dataset:::sales", ["a"], None),
                                (2, 11, "logs", "lake:dataset:::logs", [], None)], DATASETS)
    patch = spark.createDataFrame([(1, 10, ["x", "y"], None)],
                                  "user_id long, dataset_id long, tags array<string>, lifecycle_id long")
    snap, events = C.update_datasets(ds, patch, datetime(2024, 1, 1), 7)
    assert {r["name"]: r["tags"] for r in snap.collect()} == {"sales": ["x", "y"], "logs": []}
    assert [(r["action"], r["dataset_id"]) for r in events.collect()] == [("PUT", 10)]
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], "user_id long, username string")
    log = spark.createDataFrame([(1, 1, "userDelete"), (2, 2, "x")],
                                "log_id long, user_id long, description string")
    out = C.delete_users(users, {"datasets": ds, "event_log": log},
                         spark.createDataFrame([(1,)], "user_id long"))
    assert [r["username"] for r in out["users"].collect()] == ["bob"]
    assert [r["name"] for r in out["datasets"].collect()] == ["logs"]
    assert [r["log_id"] for r in out["event_log"].collect()] == [2]


def test_register_transforms_refuses_invalid_requests(spark):
    from lakehook.plans.transforms import register_transforms
    from lakehook.schemas import TRANSFORMS
    users = spark.createDataFrame([(1, "ann")], "user_id long, username string")
    ds = spark.createDataFrame([(5, "in"), (6, "out")], "dataset_id long, name string")
    cols = "username string, name string, in_dataset string, in_action string, " \
           "out_dataset string, out_action string, src_file string, timeout int"
    req = spark.createDataFrame([
        ("ann", " my:job. ", "in", "POST", "out", "POST", "f.sql", 200),
        ("zed", "x", "in", "POST", "out", "POST", "f.sql", 200),
        ("ann", "y", "in", "POST", "nowhere", "POST", "f.sql", 200),
        ("ann", "<>", "in", "POST", "out", "POST", "f.sql", 200),
        ("ann", "z", "in", "POST", "out", "POST", "f.sql", 1600)], cols)
    existing = spark.createDataFrame([], TRANSFORMS)
    snap, refused = register_transforms(req, existing, users, ds, with_refused=True)
    assert [(r["name"], r["in_dataset_id"], r["out_dataset_id"]) for r in snap.collect()] == \
        [("myjob", 5, 6)]
    assert sorted((r["name"], r["reason"]) for r in refused.collect()) == [
        ("<>", "name_length"), ("x", "unknown_user"), ("y", "unknown_dataset"),
        ("z", "timeout_bound")]


def test_has_row_single_key_existence(spark):
    df = spark.createDataFrame([(1, "ann"), (2, "bob")], "id long, name string")
    assert L.has_row(df, F.col("name") == "bob")
    assert not L.has_row(df, F.col("name") == "zed")


def test_exclude_list_and_first_per_key_nulls_first(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "name string, t int")
    assert [r[0] for r in P.exclude(df, "name", ["b"]).orderBy("name").collect()] == ["a", "c"]
    assert P.exclude(df, "name", []).count() == 3
    keyed = df.withColumn("k", F.lit(1))
    first = L.first_per_key(keyed, "k", ["t"], payload=["name"]).collect()
    assert [(r["t"], r["name"]) for r in first] == [(None, "b")]      # NULL sorts first


def test_column_arguments_for_lifecycle_and_processed_flag(spark):
    files = spark.createDataFrame([(1, "d1", date(2024, 1, 5), "hot", date(2024, 1, 8)),
                                   (2, "d1", date(2024, 1, 5), "hot", date(2024, 1, 9))],
                                  "file_id long, dataset string, created date, storage_class string, "
                                  "as_of date")
    due = spark.createDataFrame([("d1", 3, "cold")],
                                "dataset string, days_till_transition int, transition_to string")
    out = dict(LC.apply_transitions(files, due, F.col("as_of")).select("file_id", "storage_class")
               .collect())
    assert out == {1: "cold", 2: "hot"}       # each file aged on its own as-of date
    log = _log(spark, [(1, 1, "c", 1, "POST", "file", False, False),
                       (4, 1, "c", 1, "POST", "file", False, False)])
    flagged = dict(mark_processed(log, F.lit(1)).select("log_id", "processed").collect())
    assert flagged == {1: True, 4: False}
