"""Acceptance queries: one per operator of the inventory.

Every query takes ``(spark, sf_dir)``, reads the test tables in full and
returns a DataFrame whose columns are named exactly like its DuckDB oracle in
:mod:`lakehook.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.functions import predicates as P
from lakehook.functions import scalars as S
from lakehook.operators import ledger as LG
from lakehook.operators import lifecycle as LC
from lakehook.operators import lookup as L
from lakehook.operators import mutate as M
from lakehook.operators import quality as Q
from lakehook.operators.match import gate, mark_processed, match_report, match_triggers
from lakehook.plans import dispatch as D
from lakehook.plans import lake
from lakehook.plans import transforms as TR
from lakehook.plans.lake import table
from lakehook.plans.scripts import SCRIPTS
from lakehook.plans.transforms import sql_transform
from lakehook.schemas import FILES as TR_FILES_SCHEMA
from lakehook.session import scratch_path
from lakehook.sources import files as IO
from lakehook.streaming.trigger_stream import start_dispatch_stream


def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + J3 (flagship): the transform each pending event fires."""
    log = lake.event_log(table(spark, sf_dir, "events"))
    regs = lake.registrations(log)
    m = match_triggers(log, regs)
    return m.select("log_id", "user_id", F.col("dataset_id").alias("node_id"),
                    "transform_id", F.col("out_dataset_id").alias("out_node_id"))


QUERIES = {
    "trigger_match": trigger_match,
}


# Fixed parameters of the acceptance queries.
FIB_K = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
AS_OF = "2024-01-08"
REUPLOAD_TS = "2024-02-01 00:00:00"


def _files(spark, sf_dir):
    return lake.files_from_documents(table(spark, sf_dir, "documents"))


def _log(spark, sf_dir):
    return lake.event_log(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------- P1-P10
def predicate_conj(spark, sf_dir):
    """Equality, membership (typed, empty list dropped), null and
    negated predicates, compiled into one pushed-down filter."""
    ev = table(spark, sf_dir, "events").withColumn("k", S.json_field("props", "$.k").cast("int"))
    cond = P.where(
        [("event_type", ["click", "purchase", "view"]), ("event_type", "view"),
         ("value", None), ("k", FIB_K), ("props", "Null"), ("user_id", [])],
        negate=[False, True, True, False, True, False])
    return ev.filter(cond).select("event_id", "event_type", "value", "k")


def path_functions(spark, sf_dir):
    """Extension, base name, forced .parquet path, resource name."""
    f = _files(spark, sf_dir)
    return f.select(
        "file_id",
        S.file_extension("name").alias("file_extension"),
        S.base_name("path").alias("base_name"),
        S.force_parquet_extension("path").alias("output_path"),
        S.resource_name("dataset").alias("resource_name"))


def distinct_paths(spark, sf_dir):
    """Distinct (directory, extension) of all files."""
    f = _files(spark, sf_dir).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("dataset_dir"),
        S.file_extension("name").alias("file_extension"))
    return P.project(f, ["dataset_dir", "file_extension"], distinct=True)


def exists_semi(spark, sf_dir):
    """Documents that have a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.exists_in(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def exclude_anti(spark, sf_dir):
    """Documents without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.not_exists_in(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def list_members(spark, sf_dir):
    """P8 + P9: datasets holding English files, minus an exclusion list."""
    f = _files(spark, sf_dir)
    return L.list_members(f, "lang", "en", "dataset", exclude=["src0", "src1"]).distinct()


def grouped_slots(spark, sf_dir):
    """P10: group / order / limit slots -- the five largest datasets."""
    docs = table(spark, sf_dir, "documents")
    return P.apply_slots(
        docs, group_by=["source"],
        aggregations=[F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("total_chars")],
        order_by=[F.desc("total_chars"), F.asc("source")], limit=5)


# ---------------------------------------------------------------- J1, J3, J6, A1, A2
def name_lookup(spark, sf_dir):
    """Name -> id with the miss sentinel (every user id x 20 as a name)."""
    req = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 20).cast("string"), 9, "0"))
        .alias("wanted_name"))
    out = L.name_to_id(req, "wanted_name", table(spark, sf_dir, "customer"),
                       "c_name", "c_custkey", "custkey")
    return out.select("event_id", "custkey")


def id_to_name(spark, sf_dir):
    """J1 reversed: id -> name (NULL on a miss)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = L.name_to_id(orders, "o_custkey", table(spark, sf_dir, "customer"),
                       "c_custkey", "c_name", "c_name", sentinel=None)
    return out.select("o_orderkey", "c_name")


def owned_lookup(spark, sf_dir):
    """Resolve a customer only when both the id and the claimed nation match."""
    req = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        (S.json_field("props", "$.k").cast("int") % 25).alias("claimed_nation"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    out = L.resolve_owned(req, cust, [("user_id", "c_custkey"), ("claimed_nation", "c_nationkey")])
    return out.select("event_id", "c_name", "found")


def trigger_gate(spark, sf_dir):
    """Events on datasets that have any registration."""
    log = _log(spark, sf_dir)
    return gate(log, lake.registrations(log)).select(
        "log_id", F.col("dataset_id").alias("node_id"))


def trigger_report(spark, sf_dir):
    """J2 report: every pending event, its first registration and status."""
    log = _log(spark, sf_dir)
    return match_report(log, lake.registrations(log))


def registration_counts(spark, sf_dir):
    """A1: registrations per input dataset."""
    regs = lake.registrations(_log(spark, sf_dir))
    return L.count_per_key(regs, "in_dataset_id", "n_transforms") \
        .withColumnRenamed("in_dataset_id", "node_id")


def first_per_key(spark, sf_dir):
    """A2: first event of every user (by time, then id)."""
    ev = table(spark, sf_dir, "events")
    return L.first_per_key(ev, "user_id", ["ts", "event_id"], payload=["event_type"])


# ---------------------------------------------------------------- M1-M7, J5
def cascade_delete(spark, sf_dir):
    """J5 + M4: deleting AUTOMOBILE customers removes their orders and those
    orders' line items; returns the surviving line items."""
    cust = table(spark, sf_dir, "customer")
    doomed = cust.filter(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    _, kept_items = M.cascade_delete(
        [(orders, ["o_custkey"], ["o_orderkey"]),
         (items, ["l_orderkey"], ["l_orderkey", "l_linenumber"])], doomed)
    return kept_items


def _file_snapshot(spark, sf_dir, keep, ts=None):
    f = _files(spark, sf_dir).filter(keep)
    created = F.expr(f"TIMESTAMP_NTZ '{ts}'") if ts else F.col("created").cast("timestamp_ntz")
    return f.select("dataset", "path", "file_id", created.alias("created"),
                    created.alias("last_modified"))


def upsert_files(spark, sf_dir):
    """M3: all files but the Spanish ones are in the catalog, all but the English
    ones are uploaded: existing paths only get a new modification time."""
    base = _file_snapshot(spark, sf_dir, ~F.col("lang").eqNullSafe("es"))
    incoming = _file_snapshot(spark, sf_dir, ~F.col("lang").eqNullSafe("en"), ts=REUPLOAD_TS)
    return M.upsert(base, incoming, ["dataset", "path"])


def update_rows(spark, sf_dir):
    """M2: conditional update -- Spanish documents move to the 'archive' source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = docs.filter(F.col("lang") == "es").select("doc_id")
    return M.update_rows(docs, changes, ["doc_id"], {"source": "archive"})


def patch_rows(spark, sf_dir):
    """M6: per-customer patches derived from orders; NULL fields keep the
    stored value."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment",
                                                   "c_nationkey")
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
    patches = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
               .agg(F.when(urgent >= 3, F.lit("PRIORITY")).alias("c_mktsegment"),
                    F.when(F.count(F.lit(1)) > 12, F.lit(0)).alias("c_nationkey")))
    return M.patch_rows(cust, patches, ["c_custkey"])


def mark_processed_q(spark, sf_dir):
    """M5: events up to the high-water mark of the first two weeks are flagged."""
    log = _log(spark, sf_dir)
    batch = log.filter(F.col("created_timestamp") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    hw = batch.agg(F.max("log_id")).first()[0]
    return mark_processed(log, hw).select("log_id", "processed")


def insert_rows(spark, sf_dir):
    """M1: users table plus supplier accounts appended as new users."""
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    new = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 10000000).alias("user_id"), F.col("s_name").alias("username"))
    return M.insert_rows(users, new)


def lifecycle_transition(spark, sf_dir):
    """J4 + M7: storage class after the lifecycle rules run on 2024-01-08."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("dataset"),
                        lake.created_date().alias("created"),
                        F.lit("hot").alias("storage_class"))
    # every dataset has its own rule for its lifecycle; those of src2 and src5 are off
    src = F.col("source")
    datasets = docs.select(src.alias("dataset"), src.alias("dataset_id"),
                           F.when(src.isin("src1", "src2", "src3"), 1)
                           .when(src.isin("src4", "src5"), 2).otherwise(3)
                           .cast("long").alias("lifecycle_id")).distinct()
    rules = datasets.select("dataset_id", "lifecycle_id",
                            (~F.coalesce(F.col("dataset_id").isin("src2", "src5"), F.lit(False))).alias("rule_enabled"))
    transitions = spark.createDataFrame([(1, 3, "cold"), (2, 3, "cold"), (3, 7, "archive")],
                                        "lifecycle_id long, days_till_transition int, transition_to string")
    due = LC.due_transitions(datasets, rules, F.broadcast(transitions))
    out = LC.apply_transitions(files, due, AS_OF)
    return out.select("file_id", "dataset", "storage_class")


# ---------------------------------------------------------------- F1, F6-F12, Q1
def human_size(spark, sf_dir):
    """human-readable sizes in the bytes/KB, MB and GB ranges."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    S.human_size("n_chars").alias("size"),
                    S.human_size(F.col("n_chars") * 1000).alias("size_x1000"),
                    S.human_size(F.col("n_chars") * 100000000).alias("size_x1e8"))


def path_parents(spark, sf_dir):
    """every ancestor directory of every file path."""
    f = _files(spark, sf_dir)
    return f.select("file_id", F.explode(S.parent_dirs("path")).alias("parent_dir"))


def sanitize_names(spark, sf_dir):
    """page URLs turned into safe names."""
    return table(spark, sf_dir, "pages").select("page_id", S.sanitize_name("url").alias("name"))


def local_time(spark, sf_dir):
    """event times as US Mountain wall-clock, second precision."""
    return table(spark, sf_dir, "events").select("event_id", S.local_time("ts").alias("local_ts"))


def json_nulls(spark, sf_dir):
    """F8: NULL fields are written, dates stay dates."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.to_json_object(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"),
        ).alias("details"), S.iso_timestamp(F.to_date("o_orderdate")).alias("day"))


def json_roundtrip(spark, sf_dir):
    """F8 + F9: event objects to JSON (ISO dates) and a field parsed back."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        S.to_json_object("event_id", "ts", "event_type", "user_id", iso_dates=("ts",))
        .alias("details"),
        S.json_field("props", "$.k").cast("int").alias("k"),
        F.from_json("props", "k INT")["k"].alias("k_parsed"))


def tags_clean(spark, sf_dir):
    """comma-separated tags with empty entries removed."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat_ws(",", F.col("lang"), F.lit(""), F.col("source"), F.lit(""))
    tags = S.split_tags(raw)
    return d.select("doc_id", F.size(tags).alias("n_tags"), F.array_join(tags, "|").alias("tags"))


def file_age(spark, sf_dir):
    """file age in whole days on the as-of date."""
    f = _files(spark, sf_dir)
    return f.select("file_id", S.age_days(F.to_date(F.lit(AS_OF)), "created").alias("age_days"))


QUALITY_RULES = [
    ("user_name_length", lambda: Q.length_between("user_name_length", "c_name", *Q.USER_NAME_LENGTH)),
    ("name_distinct_chars", lambda: Q.min_distinct_chars("name_distinct_chars", "c_name", 12)),
    ("segment_not_in_name", lambda: Q.not_contained("segment_not_in_name", "c_mktsegment", "c_name")),
    ("acctbal_at_most", lambda: Q.at_most("acctbal_at_most", "c_acctbal", 1500)),
]


def quality_checks(spark, sf_dir):
    """Q1: pass / fail counts of the customer rules."""
    rules = [make() for _, make in QUALITY_RULES]
    return Q.summarize(table(spark, sf_dir, "customer"), rules)


def quality_transforms(spark, sf_dir):
    """Q1 on the registration catalog: name length and timeout bound."""
    regs = lake.registrations(_log(spark, sf_dir)).withColumn(
        "name", F.concat(F.lit("transform "), F.col("name"), F.lit(" of user "),
                         F.col("user_id").cast("string"), F.lit(" on dataset "),
                         F.col("in_dataset_id").cast("string"), F.lit(" writing to dataset "),
                         F.col("out_dataset_id").cast("string")))
    rules = [Q.length_between("name_length", "name", *Q.TRANSFORM_NAME_LENGTH),
             Q.at_most("timeout_bound", "timeout", Q.MAX_TIMEOUT),
             Q.min_distinct_chars("name_distinct_chars", "name", Q.MIN_DISTINCT_CHARS)]
    return Q.summarize(regs, rules)


QUERIES.update({
    "quality_transforms": quality_transforms,
    "predicate_conj": predicate_conj,
    "path_functions": path_functions,
    "distinct_paths": distinct_paths,
    "exists_semi": exists_semi,
    "exclude_anti": exclude_anti,
    "list_members": list_members,
    "grouped_slots": grouped_slots,
    "name_lookup": name_lookup,
    "id_to_name": id_to_name,
    "owned_lookup": owned_lookup,
    "trigger_gate": trigger_gate,
    "trigger_report": trigger_report,
    "registration_counts": registration_counts,
    "first_per_key": first_per_key,
    "cascade_delete": cascade_delete,
    "upsert_files": upsert_files,
    "update_rows": update_rows,
    "patch_rows": patch_rows,
    "mark_processed": mark_processed_q,
    "insert_rows": insert_rows,
    "lifecycle_transition": lifecycle_transition,
    "human_size": human_size,
    "path_parents": path_parents,
    "sanitize_names": sanitize_names,
    "local_time": local_time,
    "json_roundtrip": json_roundtrip,
    "tags_clean": tags_clean,
    "file_age": file_age,
    "quality_checks": quality_checks,
})


# ---------------------------------------------------------------- T1 + D1-D14, T3


def _script_query(name):
    source, script = SCRIPTS[name]

    def run(spark, sf_dir):
        return sql_transform(spark, script, lambda s: table(s, sf_dir, source))
    run.__name__ = name
    run.__doc__ = f"T1: acceptance script {name} over {source}."
    return run


QUERIES.update({name: _script_query(name) for name in SCRIPTS})


# ---------------------------------------------------------------- T2-T7, S1-S8, T8

ORDERS_DDL = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")
DISPATCH_OUT_DDL = ("user_id long, dataset_id long, transform_id long, event_id long, "
                    "value_delta double, out_file string, out_dataset_id long, batch_id long, job string")
SQL_DISPATCH_OUT_DDL = ("event_id long, event_type string, value2 double, "
                        "out_file string, out_dataset_id long, batch_id long, job string")
DISPATCH_SCRIPT = ("SELECT event_id, event_type, value * 2 AS value2 "
                   "FROM return_arrow_table a WHERE value > 100")


def shift_to_min(df):
    """Whole-table Python transform: non-error events, value relative to the
    smallest value and as a share of the largest."""
    r = df.copy()
    r = r[r["event_type"] != "error"]
    r["value_delta"] = r["value"] - r["value"].min()
    r["value_share"] = r["value"] / r["value"].max()
    return r[["event_id", "event_type", "value_delta", "value_share"]]


def file_delta(pdf):
    """Per-file Python transform: value relative to the file's smallest."""
    r = pdf.copy()
    r["value_delta"] = r["value"] - r["value"].min()
    return r[["event_id", "event_type", "value_delta"]]


def purchase_delta(pdf):
    """Dispatched per-file transform: purchases, value relative to the
    file's cheapest purchase."""
    r = pdf[pdf["event_type"] == "purchase"].copy()
    r["value_delta"] = r["value"] - r["value"].min()
    return r[["event_id", "value_delta"]]


def python_transform(spark, sf_dir):
    """Whole-table pandas transform on pandas-on-Spark."""
    return TR.pandas_transform(table(spark, sf_dir, "events"), shift_to_min)


def python_identity(spark, sf_dir):
    """The default Python transform (an unchanged copy)."""
    return TR.pandas_transform(table(spark, sf_dir, "events"), TR.identity_process_df)


def _event_files(spark, sf_dir):
    """Events as many lake files of bounded size: one per thousand event ids."""
    root = scratch_path(spark, "event-files")
    (table(spark, sf_dir, "events").withColumn("file", F.floor(F.coalesce("event_id", F.lit(-1)) / 1000))
     .repartition("file").sortWithinPartitions("file", "event_id").write.partitionBy("file").parquet(root))
    return IO.read_files(spark, {"parquet": [root]}, positions=True)


def per_file_transform(spark, sf_dir):
    """T4: a pandas transform runs once per file of events."""
    out = TR.per_file_transform(_event_files(spark, sf_dir), file_delta,
                                "event_id long, event_type string, value_delta double", "file")
    return out.drop("file")


def running_total(pdf):
    """An order-dependent per-file transform: running sum, change and first value."""
    r = pdf[["event_id"]].copy()
    cents = (pdf["value"] * 100).round().astype("int64")
    r["running"] = cents.cumsum()
    r["change"] = (cents - cents.shift(1)).astype("Int64")
    r["first_id"] = pdf["event_id"].head(1).iloc[0]
    return r


def per_file_ordered(spark, sf_dir):
    """T4: functions that depend on the order of rows in the file."""
    out = TR.per_file_transform(_event_files(spark, sf_dir), running_total,
                                "event_id long, running long, change long, first_id long", "file")
    return out.select("event_id", "running", "change", "first_id")


def native_transform(spark, sf_dir):
    """T5: a Spark-native DataFrame -> DataFrame transform."""
    def fn(df):
        return (df.filter(F.col("value") > 100)
                .select("event_id", "user_id", (F.col("value") * 2).alias("value_x2")))
    return TR.native_transform(table(spark, sf_dir, "events"), fn)


def scan_parquet(spark, sf_dir):
    """Parquet scan with pruned columns and pushed-down filters."""
    li = IO.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return (li.filter((F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"))
                      & (F.col("l_quantity") < 10))
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"))


def scan_csv(spark, sf_dir):
    """CSV scan (header row, declared schema) of orders stored as CSV."""
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return IO.read_csv(spark, path, schema=ORDERS_DDL)


def _statuses(orders):
    """The order statuses that occur, NULL as None: one lake file each."""
    return sorted((r[0] for r in orders.select("o_orderstatus").distinct().collect()), key=str)


def _orders_dataset(spark, sf_dir):
    """A dataset with a file per order status: shipped orders as Parquet, all
    others as CSV; returns its catalog rows."""
    root = scratch_path(spark, "orders-dataset")
    orders = table(spark, sf_dir, "orders")
    rows = []
    for i, status in enumerate(_statuses(orders)):
        ext = "parquet" if status == "F" else "csv"
        path = f"{root}/orders_{status}.{ext}"
        part = orders.filter(F.col("o_orderstatus").eqNullSafe(status))
        if ext == "parquet":
            IO.write_parquet(part, path)
        else:
            part.write.mode("overwrite").option("header", True).csv(path)
        rows.append((1, 7, 100 if status == "F" else 101 + i, f"orders_{status}.{ext}", path, ext))
    return spark.createDataFrame(
        rows, "user_id long, dataset_id long, file_id long, name string, path string, "
              "file_extension string")


def _mixed_dataset(spark, sf_dir):
    """The catalog of two CSV files with columns in different order and two Parquet
    files, one with a column more."""
    root = scratch_path(spark, "mixed-dataset")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    part = F.pmod(F.coalesce("o_orderkey", F.lit(0)), F.lit(4))
    o.filter(part == 0).write.option("header", True).csv(f"{root}/a.csv")
    o.filter(part == 1).select("o_totalprice", "o_orderkey", "o_custkey").write.option("header", True).csv(f"{root}/b.csv")
    o.filter(part == 2).write.parquet(f"{root}/c.parquet")
    o.filter(part == 3).withColumn("extra", F.col("o_custkey") * 2).write.parquet(f"{root}/d.parquet")
    return spark.createDataFrame(
        [(1, 7, k, f"{n}", f"{root}/{n}", n.split(".")[1]) for k, n in enumerate(["a.csv", "b.csv", "c.parquet", "d.parquet"])],
        "user_id long, dataset_id long, file_id long, name string, path string, file_extension string")


def scan_by_name(spark, sf_dir):
    """S2 + S3: columns are bound by name: one CSV file has its columns in another
    order, one Parquet file has a column more."""
    catalog = _mixed_dataset(spark, sf_dir)
    df = IO.scan_dataset(spark, catalog, 1, 7, csv_schema="o_orderkey long, o_custkey long, o_totalprice double")
    return df.select("o_orderkey", "o_custkey", "o_totalprice", "extra")


def scan_declared(spark, sf_dir):
    """S3: a dataset of Parquet and CSV files read by the columns that its catalog
    entry declares: their order, their types, and one that only some files have."""
    catalog = _mixed_dataset(spark, sf_dir)
    datasets = spark.createDataFrame([(1, 7, "mixed")], "user_id long, dataset_id long, name string")
    datasets = IO.declare_columns(datasets, 1, 7, "extra long, o_totalprice double, o_orderkey long, absent string")
    df = IO.scan_dataset(spark, catalog, 1, 7, datasets=datasets)
    return df.select("o_orderkey", "o_totalprice", "extra", "absent")


def scan_dataset(spark, sf_dir):
    """S3: every file of a dataset (Parquet and CSV), unioned by name."""
    catalog = _orders_dataset(spark, sf_dir)
    df = IO.scan_dataset(spark, catalog, 1, 7, csv_schema=ORDERS_DDL)
    fmt = F.when(F.col(IO.SOURCE_FILE_COL).endswith(".parquet"), "parquet").otherwise("csv")
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice", fmt.alias("fmt"))


def catalog_scan(spark, sf_dir):
    """One file resolved through the catalog by (user, dataset, file id)."""
    catalog = _orders_dataset(spark, sf_dir)
    df = IO.scan_catalog_file(spark, catalog, 1, 7, 100, csv_schema=ORDERS_DDL)
    return df.select("o_orderkey", "o_orderstatus")


def sink_roundtrip(spark, sf_dir):
    """Parquet sink forcing the extension, read back."""
    target = IO.write_parquet(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
        scratch_path(spark, "sink") + "/lineitem_copy.csv")
    back = spark.read.parquet(target)
    stored = F.regexp_extract(IO.logical_file(), r"([^/]+)$", 1)
    return back.select("l_orderkey", "l_linenumber", "l_quantity", stored.alias("stored_as"))


def ingest_q(spark, sf_dir):
    """Orders land as three CSV files, are ingested into a dataset (with
    catalog upsert and upload events), and the shipped file is uploaded
    again -- which updates the catalog but emits no new event."""
    from datetime import datetime

    landing = scratch_path(spark, "landing")
    orders = table(spark, sf_dir, "orders")
    rows = []
    for status in _statuses(orders):
        path = f"{landing}/orders_{status}.csv"
        orders.filter(F.col("o_orderstatus").eqNullSafe(status)).write.option("header", True).csv(path)
        rows.append((f"orders_{status}.csv", path, "csv"))
    land = spark.createDataFrame(rows, "name string, landing_path string, file_extension string")
    empty = spark.createDataFrame([], TR_FILES_SCHEMA)
    ds_root = scratch_path(spark, "dataset")
    t1, t2 = datetime(2024, 3, 1), datetime(2024, 3, 2)
    snap1, ev1 = IO.ingest(spark, land, empty, ds_root, 1, 7, "owner1", t1, 1, 1,
                           csv_schema=ORDERS_DDL)
    snap1 = snap1.checkpoint(eager=True)  # cut lineage before re-reading the dataset
    again = land.filter(F.col("name") == "orders_F.csv")
    snap2, ev2 = IO.ingest(spark, again, snap1, ds_root, 1, 7, "owner1", t2, 4, 4,
                           csv_schema=ORDERS_DDL)
    events = ev1.unionByName(ev2)
    per_file = events.groupBy(S.json_field("object_details", "$.name").alias("file_name")) \
        .agg(F.count(F.lit(1)).alias("n_events"))
    data = IO.scan_dataset(spark, snap2, 1, 7)
    data = data.select("o_orderkey", "o_orderstatus",
                       F.regexp_extract(IO.SOURCE_FILE_COL, r"([^/]+)$", 1).alias("file_name"))
    return data.join(per_file, "file_name", "left")


def append_docs(spark, sf_dir):
    """Conversation turns appended to a document collection (JSON,
    partitioned by role) with content-derived ids, read back."""
    path = scratch_path(spark, "docs")
    conv = table(spark, sf_dir, "conversations")
    n, ids = IO.append_documents(conv, path, id_cols=["conv_id", "turn"], partition_by=["role"])
    back = spark.read.schema("_id string, conv_id long, turn long, text string, role string").json(path)
    return back.select("_id", "conv_id", "turn", "role", F.length("text").alias("n_chars"))


def append_log(spark, sf_dir):
    """Event-log rows appended in two batches, read back."""
    path = scratch_path(spark, "event-log")
    ev = table(spark, sf_dir, "events")
    log = lake.event_log(ev).drop("service", "object", "is_transform_output", "processed")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    for part in (log.filter(F.col("created_timestamp") < cut),
                 log.filter(F.coalesce(F.col("created_timestamp") >= cut, F.lit(True)))):
        IO.append_events(IO.log_rows(part), path)
    back = spark.read.parquet(path)
    return back.select("log_id", "created_timestamp", "action", "dataset_id", "processed")


def register_transform(spark, sf_dir):
    """Registrations submitted by name (user, datasets) are resolved to
    ids, sanitised, numbered above the existing ones and appended."""
    log = _log(spark, sf_dir)
    regs = lake.registrations(log)
    existing = regs.filter(F.col("transform_id") < 1000000)
    submitted = regs.filter(F.col("transform_id") >= 1000000)
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    datasets = log.select("dataset_id").distinct().select(
        "dataset_id", F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string")).alias("name"))
    requests = submitted.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("username"),
        F.concat(F.lit("reg #"), F.col("transform_id").cast("string"), F.lit("!")).alias("name"),
        F.concat(F.lit("dataset_"), F.col("in_dataset_id").cast("string")).alias("in_dataset"),
        "in_action",
        F.concat(F.lit("dataset_"), F.col("out_dataset_id").cast("string")).alias("out_dataset"),
        "out_action", "src_file")
    snapshot = TR.register_transforms(requests, existing, users, datasets)
    new = snapshot.join(existing.select("transform_id"), "transform_id", "left_anti")
    return new.select("name", "user_id", "in_dataset_id", "out_dataset_id", "in_action", "out_action")


def _dispatch_inputs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    log = lake.event_log(ev)
    return log, lake.registrations(log), lake.activity(ev)


def dispatch_batch(spark, sf_dir):
    """T7 (Python): every matched event runs its transform on the file it
    names; outputs land in the transform's output dataset."""
    log, regs, data = _dispatch_inputs(spark, sf_dir)
    out_root = scratch_path(spark, "dispatch-py")
    D.dispatch_python(match_triggers(log, regs), data, lake.ACTIVITY_FILE_KEYS,
                      lake.activity_file_name(), purchase_delta,
                      "event_id long, value_delta double", out_root)
    return D.read_outputs(spark, out_root, DISPATCH_OUT_DDL)


def dispatch_batch_sql(spark, sf_dir):
    """T7 (SQL): fired transforms run their script over their matched files,
    one job per (script, output dataset)."""
    log, regs, _ = _dispatch_inputs(spark, sf_dir)
    out_root = scratch_path(spark, "dispatch-sql")
    D.dispatch_sql(spark, match_triggers(log, regs),
                   lambda s: lake.activity(table(s, sf_dir, "events")),
                   lake.ACTIVITY_FILE_KEYS, {"identity.sql": DISPATCH_SCRIPT}, out_root,
                   work_path=scratch_path(spark, "dispatch-work"), scope="script")
    return D.read_outputs(spark, out_root, SQL_DISPATCH_OUT_DDL)


def dispatch_stream(spark, sf_dir):
    """The event table read as a stream; each micro-batch is matched and
    dispatched like T7 (Python), with progress in a checkpoint."""
    _, regs, data = _dispatch_inputs(spark, sf_dir)
    out_root = scratch_path(spark, "dispatch-stream")
    schema = table(spark, sf_dir, "events").schema

    def handle(matched, batch_id):
        D.dispatch_python(matched, data, lake.ACTIVITY_FILE_KEYS, lake.activity_file_name(),
                          purchase_delta, "event_id long, value_delta double", out_root,
                          batch_id=batch_id)

    q = start_dispatch_stream(spark, sf_dir, schema, lake.event_log, regs, handle,
                              checkpoint=scratch_path(spark, "stream-ckpt"),
                              path_glob="events.parquet")
    q.awaitTermination()
    return D.read_outputs(spark, out_root, DISPATCH_OUT_DDL)


def _catalog_from_documents(spark, sf_dir):
    f = _files(spark, sf_dir)
    created = F.col("created").cast("timestamp_ntz")
    return f.select(
        F.lit(1).cast("long").alias("user_id"),
        F.regexp_extract("dataset", r"(\d+)$", 1).cast("long").alias("dataset_id"),
        "file_id", "name", "path", F.lit("owner1").alias("owner"),
        created.alias("creation_date"), created.alias("last_modified"),
        S.human_size("size_bytes").alias("size"), "size_bytes",
        S.file_extension("name").alias("file_extension"),
        S.split_tags(F.concat_ws(",", "lang", "dataset")).alias("tags"),
        F.lit("hot").alias("storage_class"))


def update_tags(spark, sf_dir):
    """M2 + F12 + S8: German files get new tags; each update is a PUT event
    (which PUT-triggered transforms can match)."""
    from datetime import datetime

    files = _catalog_from_documents(spark, sf_dir)
    changes = (files.filter(S.file_extension(F.regexp_replace("name", r"\.txt$", "")) == "de")
               .select("user_id", "dataset_id", "path",
                       F.concat_ws(",", F.lit("de"), F.lit("reviewed"), F.lit(""),
                                   F.element_at("tags", 2)).alias("tags_text")))
    _, events = IO.update_file_tags(files, changes, datetime(2024, 3, 1), 1)
    return events.select("dataset_id", "action",
                         S.json_field("object_details", "$.path").alias("path"),
                         F.array_join(F.from_json(F.get_json_object("object_details", "$.tags"),
                                                  "array<string>"), "|").alias("tags"))


def priority_summary(pdf):
    """Per-file Python transform of the lake flow: orders per priority."""
    return pdf.groupby("o_orderpriority", as_index=False).agg(
        n=("o_orderkey", "count"), max_price=("o_totalprice", "max"))


def _order_files(spark, orders, root, ext):
    """Orders as lake files of bounded size, one per status and ten thousand order keys,
    written by one job; returns the landing table."""
    name = F.concat(F.lit("orders_"), F.coalesce("o_orderstatus", F.lit("")), F.lit("_"),
                    F.floor(F.coalesce("o_orderkey", F.lit(0)) / 10_000).cast("string"), F.lit(f".{ext}"))
    orders = orders.withColumn("file", name)
    orders.repartition("file").write.partitionBy("file").format(ext).option("header", True).save(root)
    return orders.select(F.col("file").alias("name"), F.concat(F.lit(f"{root}/file="), "file").alias("landing_path"),
                         F.lit(ext).alias("file_extension")).distinct()


def lake_flow(spark, sf_dir):
    """S6 -> S8 -> J2 -> T7 over real files: orders land as many CSV files,
    are ingested (one upload event each), match a registration on their
    dataset, and a per-file pandas transform writes each file's summary under
    the same base name in the output dataset."""
    from datetime import datetime

    land = _order_files(spark, table(spark, sf_dir, "orders"), scratch_path(spark, "flow-landing"), "csv")
    root = scratch_path(spark, "flow-lake")
    _, events = IO.ingest(spark, land, spark.createDataFrame([], TR_FILES_SCHEMA),
                          f"{root}/user1/sales", 1, 7, "owner1", datetime(2024, 6, 1), 1, 1,
                          csv_schema=ORDERS_DDL)
    regs = spark.createDataFrame(
        [(1, 1, "summary", "datasets", 7, "POST", "file", "datasets", 2, "POST", "file",
          "summary.py", True)],
        "transform_id long, user_id long, name string, in_service string, in_dataset_id long, "
        "in_action string, in_object string, out_service string, out_dataset_id long, "
        "out_action string, out_object string, src_file string, enabled boolean")
    manifest = D.dispatch_files(
        spark, match_triggers(events.checkpoint(eager=True), regs),
        lambda src: ("pandas_file", priority_summary, "o_orderpriority string, n long, max_price double"),
        f"{root}/outputs")
    return D.output_rows(spark, manifest, f"{root}/outputs").select(
        "out_dataset_id", F.col("name").alias("out_file"), "o_orderpriority", "n", "max_price")


EVENT_SUMMARY = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place
                FROM return_arrow_table)
SELECT event_type, count(*) AS n, max(value) AS top, max(CASE WHEN place = 1 THEN event_id END) AS top_event
FROM ranked GROUP BY event_type"""


def dispatch_sql_files(spark, sf_dir):
    """T7 + T1: one SQL script (windows, grouping) over each of many lake files, all
    files in one job; events land as files of a thousand ids and are ingested."""
    from datetime import datetime

    ev = table(spark, sf_dir, "events").withColumn("file", F.concat(
        F.lit("events_"), F.floor(F.coalesce("event_id", F.lit(-1)) / 1000).cast("string"), F.lit(".parquet")))
    landing, root = scratch_path(spark, "sql-landing"), scratch_path(spark, "sql-lake")
    ev.repartition("file").write.partitionBy("file").parquet(landing)
    land = ev.select(F.col("file").alias("name"), F.concat(F.lit(f"{landing}/file="), "file").alias("landing_path"),
                     F.lit("parquet").alias("file_extension")).distinct()
    _, events = IO.ingest(spark, land, spark.createDataFrame([], TR_FILES_SCHEMA), f"{root}/user1/events", 1, 7,
                          "owner1", datetime(2024, 6, 1), 1, 1)
    regs = spark.createDataFrame([(1, 1, "summary", "datasets", 7, "POST", "file", "datasets", 2, "POST", "file",
                                   "summary.sql", True)], REGS_DDL)
    manifest = D.dispatch_files(spark, match_triggers(events.checkpoint(eager=True), regs),
                                lambda src: ("sql", EVENT_SUMMARY), f"{root}/outputs")
    return D.output_rows(spark, manifest, f"{root}/outputs").select("name", "event_type", "n", "top", "top_event")


def broken_on_pending(pdf):
    """A transform that raises on files of pending orders."""
    if (pdf["o_orderstatus"] == "P").any():
        raise ValueError("pending orders")
    return pdf.groupby("o_orderstatus", as_index=False).agg(n=("o_orderkey", "count"), top=("o_totalprice", "max"))


REGS_DDL = ("transform_id long, user_id long, name string, in_service string, in_dataset_id long, "
            "in_action string, in_object string, out_service string, out_dataset_id long, "
            "out_action string, out_object string, src_file string, enabled boolean")


def _two_users(spark, sf_dir):
    """Two users' datasets of many order files (even and odd customers), under the
    same base names, and a Python and a SQL registration."""
    from datetime import datetime

    root = scratch_path(spark, "batch-lake")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    files = spark.createDataFrame([], TR_FILES_SCHEMA)
    log = None
    for user in (1, 2):
        mine = orders.filter(F.pmod(F.coalesce("o_custkey", F.lit(0)), F.lit(2)) == user - 1)
        land = _order_files(spark, mine, f"{root}/landing{user}", "parquet")
        files, events = IO.ingest(spark, land, files, f"{root}/user{user}/sales", user, 10 + user, "owner",
                                  datetime(2024, 6, 1), 10_000_000 * user, 10_000_000 * user)
        log = events if log is None else log.unionByName(events)
    regs = spark.createDataFrame([
        (1, 1, "by python", "datasets", 11, "POST", "file", "datasets", 21, "POST", "file", "status.py", True),
        (2, 2, "by sql", "datasets", 12, "POST", "file", "datasets", 22, "POST", "file", "total.sql", True)], REGS_DDL)

    def resolve(src_file):
        if src_file == "status.py":
            return "pandas_file", broken_on_pending, "o_orderstatus string, n long, top double"
        return "sql", "SELECT count(*) AS n, max(o_totalprice) AS top FROM return_arrow_table"

    return root, files.checkpoint(eager=True), log.checkpoint(eager=True), regs, resolve


def _run_two_users(spark, sf_dir):
    from datetime import datetime

    root, files, log, regs, resolve = _two_users(spark, sf_dir)
    D.run_batch(spark, log, regs, files, resolve, f"{root}/out", f"{root}/log2", f"{root}/files2",
                datetime(2024, 6, 2), batch_id=1)
    return root


def run_batch(spark, sf_dir):
    """Each registration runs its own source file (Python, SQL) over each of
    its user's files; the output datasets are read through the catalog (S3)."""
    root = _run_two_users(spark, sf_dir)
    catalog = spark.read.parquet(f"{root}/files2").where("dataset_id in (21, 22)")
    rows = IO.scan_dataset(spark, catalog, 1, 21).select(IO.SOURCE_FILE_COL, "n", "top").unionByName(
        IO.scan_dataset(spark, catalog, 2, 22).select(IO.SOURCE_FILE_COL, "n", "top"))
    named = catalog.select(IO.normalize_path("path").alias(IO.SOURCE_FILE_COL), "user_id", "name")
    return rows.join(named, IO.SOURCE_FILE_COL).drop(IO.SOURCE_FILE_COL)


def dispatch_failures(spark, sf_dir):
    """The manifest of a batch in which some files' script raises."""
    root = _run_two_users(spark, sf_dir)
    return spark.read.parquet(f"{root}/out-manifest/batch_id=1").select(
        "user_id", "src_file", "name", F.col("error").isNotNull().alias("failed"), "n_rows")


def empty_rerun(spark, sf_dir):
    """A rerun of a transform that gives no rows any more replaces the
    output: the catalogued files are empty. Read by path, as the catalog does."""
    root, files, log, regs, _ = _two_users(spark, sf_dir)
    ddl = "o_orderkey long"
    matched = match_triggers(log, regs.where("transform_id = 1"))
    keep = lambda src: ("pandas_file", lambda pdf: pdf[["o_orderkey"]], ddl)
    drop = lambda src: ("pandas_file", lambda pdf: pdf[["o_orderkey"]][pdf["o_orderstatus"] != "F"], ddl)
    D.dispatch_files(spark, matched, keep, f"{root}/out", batch_id=1)
    manifest = D.dispatch_files(spark, matched, drop, f"{root}/out", batch_id=2)
    catalog = manifest.select("user_id", F.col("out_dataset_id").alias("dataset_id"), "path", "name",
                              F.lit("parquet").alias("file_extension"))
    rows = IO.scan_dataset(spark, catalog, 1, 21)
    named = catalog.select(IO.normalize_path("path").alias(IO.SOURCE_FILE_COL), "name")
    return rows.join(named, IO.SOURCE_FILE_COL).select("name", "o_orderkey")


def _ledger_log(spark, sf_dir):
    """The event log appended in two parts, the second with late events of the first
    days, and a ledger that covers the first part; returns its path and mark."""
    path = scratch_path(spark, "ledger-log")
    log = lake.event_log(table(spark, sf_dir, "events")).withColumn("processed", F.lit(False))
    half = log.agg((F.max("log_id") / 2).cast("long")).first()[0] or 0
    LG.append(IO.log_rows(log.where(F.col("log_id") <= half)), path)
    LG.mark(spark, path, half, batch_id=1)
    LG.append(IO.log_rows(log.where(F.coalesce(F.col("log_id") > half, F.lit(True)))), path)
    return path, half


def ledger_pending(spark, sf_dir):
    """M5 + J2's gate: events that the ledger's ranges leave pending, read from the
    days that hold any, late events in early days too."""
    path, _ = _ledger_log(spark, sf_dir)
    return LG.pending_events(spark, path).select("log_id", "user_id", "action")


def ledger_flags(spark, sf_dir):
    """M5: the processed flag of every event, half of it compacted into the log's
    touched days, half of it still in the ledger."""
    path, half = _ledger_log(spark, sf_dir)
    LG.compact(spark, path)
    LG.mark(spark, path, half + half // 2, batch_id=2, from_id=half + 1)
    return LG.all_events(spark, path).select("log_id", "processed")


def create_datasets(spark, sf_dir):
    """Catalog action: every customer asks for a dataset named after its
    market segment (one name is taken already) and one named after its
    nation key (too short). The lowest customer id wins each free name."""
    from datetime import datetime

    from lakehook.operators import catalog as C
    from lakehook.schemas import DATASETS

    cust = table(spark, sf_dir, "customer")
    req = (cust.select(F.col("c_custkey").alias("user_id"), F.lower("c_mktsegment").alias("name"),
                       F.lit(None).cast("string").alias("tags_text"))
           .unionByName(cust.select(F.col("c_custkey").alias("user_id"),
                                    F.col("c_nationkey").cast("string").alias("name"),
                                    F.lit(None).cast("string").alias("tags_text"))))
    existing = spark.createDataFrame([(0, 1, "building", "lake:dataset:::building", [], None)],
                                     DATASETS)
    snap, _, refused = C.create_datasets(existing, req, datetime(2024, 1, 1), 2, 1)
    created = snap.filter(F.col("dataset_id") >= 2).select(
        "user_id", "name", F.lit("created").alias("outcome"))
    return created.unionByName(refused.withColumnRenamed("reason", "outcome"))


def delete_users(spark, sf_dir):
    """Catalog action: AUTOMOBILE customers delete their accounts; their
    event-log rows and registrations go with them (cascade). Returns the
    surviving log rows with the number of registrations left for the user."""
    from lakehook.operators import catalog as C

    cust = table(spark, sf_dir, "customer")
    users = cust.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    log = _log(spark, sf_dir)
    doomed = cust.filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").alias("user_id"))
    out = C.delete_users(users, {"event_log": log, "transforms": lake.registrations(log)}, doomed)
    regs_left = L.count_per_key(out["transforms"], "user_id", "n_transforms")
    return (out["event_log"].select("log_id", "user_id")
            .join(regs_left, "user_id", "left")
            .select("log_id", "user_id", F.coalesce("n_transforms", F.lit(0)).alias("n_transforms")))


def dispatch_record(spark, sf_dir):
    """T7 catalog side (M3 + S8): output files of a dispatched batch enter the
    catalog and are logged as transform output; returns those events."""
    from datetime import datetime

    log, regs, _ = _dispatch_inputs(spark, sf_dir)
    work = D.work_items(match_triggers(log, regs), lake.ACTIVITY_FILE_KEYS)
    empty = spark.createDataFrame([], TR_FILES_SCHEMA)
    outputs = work.select("user_id", F.col("out_dataset_id").alias("dataset_id"),
                          lake.activity_file_name().alias("name")).withColumn(
        "path", F.concat_ws("/", F.lit("/lake/out"), F.col("dataset_id").cast("string"), "name"))
    _, events = D.record_outputs(outputs, empty, datetime(2024, 3, 1), 1, 1)
    return events.select("user_id", "dataset_id", "action",
                         S.json_field("object_details", "$.name").alias("object_name"),
                         "is_transform_output")

def _order_datasets(spark, sf_dir):
    """Every customer's orders as datasets (one per customer) and files (one per order)."""
    cust = table(spark, sf_dir, "customer")
    none = F.lit(None)
    datasets = cust.select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1000000).alias("dataset_id"),
        F.col("c_name").alias("name"), S.resource_name("c_name").alias("resource_name"),
        F.array(F.col("c_mktsegment")).alias("tags"), none.cast("long").alias("lifecycle_id"))
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_custkey") + 1000000).alias("dataset_id"),
        F.col("o_orderkey").alias("file_id"), F.concat(F.lit("/lake/"), F.col("o_orderkey").cast("string")).alias("path"))
    return cust, datasets, files


def update_datasets(spark, sf_dir):
    """Catalog action: customers of nation 3 retag their datasets; a NULL keeps the tags."""
    from datetime import datetime

    from lakehook.operators import catalog as C

    cust, datasets, _ = _order_datasets(spark, sf_dir)
    patches = cust.where("c_nationkey = 3").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1000000).alias("dataset_id"),
        F.when(F.col("c_acctbal") > 0, F.array(F.lit("x"), F.lit("y"))).alias("tags"))
    snap, events = C.update_datasets(datasets, patches, datetime(2024, 3, 1), 1)
    put = events.select("user_id", "dataset_id", F.lit(True).alias("put"))
    return snap.join(put, ["user_id", "dataset_id"], "left").select(
        "user_id", "dataset_id", F.array_join("tags", "|").alias("tags"), F.coalesce("put", F.lit(False)).alias("put"))


def delete_datasets(spark, sf_dir):
    """Catalog action: datasets of nation 3 are deleted with their files; a request
    by another user than the owner does nothing. Returns the files left."""
    from datetime import datetime

    from lakehook.operators import catalog as C

    cust, datasets, files = _order_datasets(spark, sf_dir)
    mine = cust.where("c_nationkey = 3").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") + 1000000).alias("dataset_id"))
    foreign = cust.where("c_nationkey = 4").select(
        (F.col("c_custkey") + 1).alias("user_id"), (F.col("c_custkey") + 1000000).alias("dataset_id"))
    _, left, _ = C.delete_datasets(datasets, files, mine.unionByName(foreign), datetime(2024, 3, 1), 1)
    return left.select("user_id", "file_id")


def delete_files(spark, sf_dir):
    """Catalog action: files of urgent orders are deleted by (user, dataset, path)."""
    from lakehook.operators import catalog as C

    _, _, files = _order_datasets(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    doomed = files.join(urgent, F.col("file_id") == F.col("o_orderkey"), "left_semi")
    return C.delete_files(files, doomed).select("user_id", "file_id")


def match_all(spark, sf_dir):
    """J2 with every enabled POST registration of a key firing."""
    log = _log(spark, sf_dir)
    return match_triggers(log, lake.registrations(log), policy="all").select("log_id", "transform_id")


def match_salted(spark, sf_dir):
    """J2 with hot trigger keys spread over eight buckets: the same matches."""
    log = _log(spark, sf_dir)
    return match_triggers(log, lake.registrations(log), salt_buckets=8).select("log_id", "transform_id")


def asof_events(spark, sf_dir):
    """Every error event with the latest purchase of its user group at or before
    it; one of the three groups holds most events."""
    from lakehook.operators.asof import asof_join

    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.when(F.col("user_id") % 10 == 0, 1).when(F.col("user_id") % 10 == 1, 2).otherwise(0).alias("grp"))
    errors = ev.where("event_type = 'error'").select("event_id", "grp")
    bought = ev.where("event_type = 'purchase'").select("event_id", "grp", "value")
    return asof_join(errors, bought, ["grp"], "event_id", F.floor(F.col("event_id") / 500)).select(
        "event_id", "grp", F.col("right_event_id").alias("purchase_id"), F.col("right_value").alias("purchase_value"))


def merged_sketches(spark, sf_dir):
    """Sketches stored per event type and day, merged to all days: the number of
    rows, and whether estimates lie within the stated errors of exact counts."""
    from lakehook.operators import sketches as SK
    from lakehook.session import stored

    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kept = stored(SK.sketch(ev, ["event_type", "day"], "user_id", "value"), "sketches")
    estimates = SK.merged(kept, ["event_type"])
    # the exact side: distinct users, and the rank of the estimated median
    exact = ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    rank = (ev.join(F.broadcast(estimates.select("event_type", "quantile")), "event_type").groupBy("event_type").agg(
        F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("upto"),
        F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below")))
    near = F.abs(F.col("distinct_values") - F.col("users")) <= F.ceil(4 * SK.ERROR * F.col("users"))
    inside = (F.col("below") <= 0.5 + SK.RANK_ERROR) & (F.col("upto") >= 0.5 - SK.RANK_ERROR)
    return estimates.join(exact, "event_type").join(rank, "event_type").select(
        "event_type", "n", "users", near.alias("users_near"), inside.alias("median_near"))


def registration_reach(spark, sf_dir):
    """The datasets that a change reaches through chains of registrations, with
    the fewest steps; the chains have cycles."""
    from lakehook.operators.reach import reach

    regs = lake.registrations(_log(spark, sf_dir)).where("transform_id >= 1000000")
    return reach(regs)


def variant_details(spark, sf_dir):
    """D11 + F9: event details as VARIANT, parsed once per row, read by path."""
    ev = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("details"))
    return ev.select("event_id", F.try_variant_get("details", "$.k", "int").alias("k"),
                     F.try_variant_get("details", "$.k", "string").alias("k_text"),
                     F.try_variant_get("details", "$.missing", "string").alias("missing"),
                     F.schema_of_variant("details").alias("shape"))


def _rough_csv(spark, sf_dir):
    """Orders as CSV, in which some rows lack a field, have one too many, or hold words
    for a number."""
    path = scratch_path(spark, "rough-csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(",", text("o_orderkey"), F.when(F.col("o_orderkey") % 11 == 3, F.lit("many")).otherwise(text("o_custkey")),
                       text("o_totalprice"))
    line = F.when(F.col("o_orderkey") % 7 == 2, line).otherwise(F.concat(line, F.lit(',"'), F.col("o_orderstatus"), F.lit(',"')))
    line = F.when(F.col("o_orderkey") % 13 == 5, F.concat(line, F.lit(",extra"))).otherwise(line)
    o.select(line.alias("value")).write.text(path)
    return path


def csv_rejects(spark, sf_dir):
    """Rows of a CSV dataset by their fate: read, or rejected for their number of
    fields or a value of another type."""
    good, bad = IO.read_csv_checked(spark, _rough_csv(spark, sf_dir), header=False, schema=(
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string"))
    kept = good.select("o_orderkey", F.lit("read").alias("fate"), "o_totalprice")
    key = F.split("record", ",")[0].cast("long")
    return kept.unionByName(bad.select(key.alias("o_orderkey"), F.col("reason").alias("fate"),
                                       F.lit(None).cast("double").alias("o_totalprice")))


QUERIES.update({
    "asof_events": asof_events,
    "merged_sketches": merged_sketches,
    "registration_reach": registration_reach,
    "variant_details": variant_details,
    "csv_rejects": csv_rejects,
    "json_nulls": json_nulls,
    "scan_by_name": scan_by_name,
    "scan_declared": scan_declared,
    "per_file_ordered": per_file_ordered,
    "run_batch": run_batch,
    "dispatch_sql_files": dispatch_sql_files,
    "ledger_pending": ledger_pending,
    "ledger_flags": ledger_flags,
    "dispatch_failures": dispatch_failures,
    "empty_rerun": empty_rerun,
    "update_datasets": update_datasets,
    "delete_datasets": delete_datasets,
    "delete_files": delete_files,
    "match_all": match_all,
    "match_salted": match_salted,
    "python_transform": python_transform,
    "python_identity": python_identity,
    "per_file_transform": per_file_transform,
    "native_transform": native_transform,
    "scan_parquet": scan_parquet,
    "scan_csv": scan_csv,
    "scan_dataset": scan_dataset,
    "catalog_scan": catalog_scan,
    "sink_roundtrip": sink_roundtrip,
    "ingest": ingest_q,
    "append_docs": append_docs,
    "append_log": append_log,
    "register_transform": register_transform,
    "dispatch_batch": dispatch_batch,
    "dispatch_batch_sql": dispatch_batch_sql,
    "dispatch_stream": dispatch_stream,
    "dispatch_record": dispatch_record,
    "update_tags": update_tags,
    "lake_flow": lake_flow,
    "create_datasets": create_datasets,
    "delete_users": delete_users,
})
