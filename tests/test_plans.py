"""Physical-plan properties the design relies on at scale."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE_DIR

QUERIES = E.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_ranks_registrations_not_events(spark):
    from lakehook.operators.match import first_registration_per_key
    from lakehook.plans import lake
    ev = spark.read.parquet(f"{SMOKE_DIR}/events.parquet")
    ranked = _plan(first_registration_per_key(lake.registrations(lake.event_log(ev))))
    assert "row_number" not in ranked and "min(struct(" in ranked


@pytest.mark.parametrize("name", ["trigger_match", "trigger_gate", "trigger_report"])
def test_the_event_log_is_not_shuffled(spark, name):
    # before adaptive execution: the small side's stored size alone decides
    plan = _plan(QUERIES[name](spark, SMOKE_DIR))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_first_per_key_is_an_aggregate(spark):
    plan = _plan(QUERIES["first_per_key"](spark, SMOKE_DIR))
    assert "Window" not in plan and "partial_min" in plan


def test_topk_per_key_limits_before_the_shuffle(spark):
    plan = _plan(QUERIES["sql_transform_d05"](spark, SMOKE_DIR))
    lines = plan.splitlines()
    partial = next(i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l)
    exchange = next(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    assert partial > exchange          # printed below it = runs before it


def test_parquet_scan_prunes_and_pushes(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = _plan(QUERIES["scan_parquet"](spark, SMOKE_DIR))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity)" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_quantity" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def test_d06_uses_no_null_aware_anti_join(spark):
    plan = _plan(QUERIES["sql_transform_d06"](spark, SMOKE_DIR))
    assert "BroadcastNestedLoopJoin" not in plan and "isNullAwareAntiJoin=true" not in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(
    ("op", "pipeline", "run_batch", "empty_rerun", "scan_by_name", "dispatch", "lake_flow", "per_file", "ingest", "scan_csv", "scan_dataset", "catalog_scan",
     "sink_", "append_", "python_", "register_", "update_tags", "mark_processed"))))
def test_no_row_udfs_or_cartesian_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SMOKE_DIR))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


WINDOW_SCRIPT = """
SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS rn
FROM return_arrow_table"""


def test_script_tasks_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lakehook import session as S
    from lakehook.plans import transforms as TR
    monkeypatch.setattr(S, "TASK_BYTES", 1 << 20, raising=False)
    largest = []
    for n in (500_000, 2_000_000):
        path = f"{tmp_path}/rows-{n}.parquet"
        spark.range(n).select((F.col("id") % (n // 5)).alias("k"), F.rand(1).alias("v")).write.parquet(path)
        ranked = TR.sql_transform(spark, WINDOW_SCRIPT, lambda s, p=path: s.read.parquet(p))
        tasks = ranked.groupBy(F.spark_partition_id().alias("task")).agg(
            F.count("*").alias("n"), F.sum("rn").alias("rn")).collect()
        assert sum(t["n"] for t in tasks) == n and sum(t["rn"] for t in tasks) == n // 5 * 15
        largest.append(max(t["n"] for t in tasks))   # rows that a task has sorted
    assert largest[1] < 1.5 * largest[0], largest


def test_script_keeps_settings_that_make_smaller_tasks(spark):
    from lakehook.plans import transforms as TR
    advisory, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"

    def small(s):
        s.conf.set(advisory, "1m")
        s.conf.set(parts, "300")
        return s.read.parquet(f"{SMOKE_DIR}/lineitem.parquet")

    def no_size(s):   # rows that the planner knows no size of
        return s.createDataFrame([(1, 2.0)], "k long, v double")

    held = TR.sql_transform(spark, "SELECT count(*) AS n FROM return_arrow_table", small)
    assert (held.sparkSession.conf.get(advisory), held.sparkSession.conf.get(parts)) == ("1m", "300")
    held = TR.sql_transform(spark, WINDOW_SCRIPT, no_size)
    assert held.sparkSession.conf.get(parts) == spark.conf.get(parts) and held.first()["rn"] == 1
    assert held.sparkSession.conf.get(advisory) == str(16 << 20)
