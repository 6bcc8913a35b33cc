"""Registered transforms.

* SQL transforms run one script over the single table ``return_arrow_table``,
  in an isolated session so concurrent transforms cannot see each other's view.
* Python transforms are ``process_df(df) -> df`` functions over a pandas-like
  frame. Whole-table semantics use pandas-on-Spark (distributed, aggregates
  stay global); per-file semantics use grouped ``applyInPandas``.
* Native transforms are plain ``DataFrame -> DataFrame`` functions.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakehook.session import ship_package, size_tasks
from lakehook.sources.files import PART_COL, ROW_COL

TABLE_NAME = "return_arrow_table"
ERROR_COL = "__error"

# The default bodies of a new transform (identity).
SQL_TEMPLATE = "SELECT * FROM return_arrow_table a"


def identity_process_df(df):
    """Default Python transform body: an unchanged copy."""
    return_df = df.copy()
    return return_df


def sql_transform(spark: SparkSession, script: str,
                  reader: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Run ``script`` over the table produced by ``reader``.

    ``reader`` is called with a fresh ``newSession()`` (shared SparkContext
    and cache, private temp views), registers the input there as
    ``return_arrow_table`` and runs the script in that session, with shuffles
    in proportion to the input (:func:`lakehook.session.size_tasks`).
    """
    session = spark.newSession()
    df = reader(session)
    size_tasks(df)
    df.createOrReplaceTempView(TABLE_NAME)
    return session.sql(script)


def pandas_transform(df: DataFrame, process_df: Callable) -> DataFrame:
    """Whole-table Python transform on pandas-on-Spark.

    Takes what that frame defines without an order: column arithmetic, filters,
    ``assign``, aggregates, ``groupby``, ``merge``. Functions that depend on the
    order of rows or need numpy arrays (``cumsum``, ``shift``, ``head``,
    ``np.where``) belong to :func:`per_file_transform` or, as window functions,
    to :func:`native_transform`.

    The frame handed to ``process_df`` is distributed; column arithmetic,
    filters and global aggregates run as Spark jobs. The default index is the
    ``distributed`` kind (no sequential numbering pass); the index is dropped
    from the result.
    """
    import warnings

    import pyspark.pandas as ps

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _run_pandas_api(df, process_df, ps)


def _run_pandas_api(df, process_df, ps):
    with ps.option_context("compute.default_index_type", "distributed",
                           "compute.ops_on_diff_frames", False):
        psdf = df.pandas_api()
        out = process_df(psdf)
        return out.to_spark()


@contextmanager
def alarm(seconds: float | None) -> Iterator[None]:
    """Raise TimeoutError in a task's Python code after ``seconds``."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_):
        raise TimeoutError(f"ended after {seconds:g} s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def sql_per_file(script: str, rows: DataFrame, files: DataFrame, on: tuple[str, str]) -> DataFrame:
    """T1 over many files at once: ``script`` runs over each file's rows by itself.

    A lateral join of ``files`` with the script, in which ``return_arrow_table``
    stands for the rows whose ``on[0]`` equals the file's ``on[1]``; Catalyst
    decorrelates it into joins, grouped aggregates and windows, so all files are
    one job. A file without rows is an empty table: a global aggregate still
    gives its row. The result has the columns of ``files`` and then the script's;
    its rows have no order. A script that Catalyst cannot decorrelate raises
    AnalysisException here, before any job.
    """
    session = rows.sparkSession
    rows.createOrReplaceTempView("lake_rows")
    files.createOrReplaceTempView("lake_files")
    columns = ", ".join("`" + c.replace("`", "``") + "`" for c in rows.columns if c != on[0])
    return session.sql(f"""SELECT lake_files.*, lake_result.* FROM lake_files, LATERAL (
        WITH {TABLE_NAME} AS (SELECT {columns} FROM lake_rows WHERE lake_rows.`{on[0]}` = lake_files.`{on[1]}`)
        SELECT * FROM (
{script.strip().rstrip(';')}
)) lake_result""")


def per_file_transform(df: DataFrame, process_df: Callable, schema: T.StructType | str,
                       file_cols: list[str] | str = "source_file", order_by: Sequence[str] = (),
                       failures: bool = False, timeout: float | None = None) -> DataFrame:
    """T4: run a pandas ``process_df`` once per file, all files in one job.

    A file is a group of rows with equal ``file_cols`` (several columns make a
    composite key); its rows are handed over in the order of ``order_by``, else
    in that of the file where ``df`` carries ``ROW_COL`` (see
    :func:`lakehook.sources.files.read_files`). ``process_df`` always gets
    pandas, whatever the file's size: a file is the unit of work, as large as one
    worker can hold, and a registration whose files are larger declares another
    runtime (``spark_frame`` or ``sql``). It never sees the key columns; they are
    attached to every output row. ``schema`` describes its output.

    With ``failures``, a file whose call raises gives one row with the text of
    the exception in ``ERROR_COL`` (NULL in all other rows), and other files go
    on; without, the job fails. A call that takes longer than ``timeout`` seconds
    is ended by an alarm and counts as one that raises.
    """
    keys = [file_cols] if isinstance(file_cols, str) else list(file_cols)
    out_schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    fields = [df.schema[k] for k in keys] + list(out_schema.fields)
    if failures:
        fields.append(T.StructField(ERROR_COL, T.StringType()))
    names = [f.name for f in fields]
    order = list(order_by) or [c for c in (PART_COL, ROW_COL) if c in df.columns]
    hidden = keys + [c for c in (PART_COL, ROW_COL) if c in df.columns]

    def run_file(pdf: pd.DataFrame) -> pd.DataFrame:
        ident = {k: pdf[k].iloc[0] for k in keys}
        try:
            with alarm(timeout):
                res = process_df(pdf.drop(columns=hidden).reset_index(drop=True)).reset_index(drop=True)
            if failures:
                res[ERROR_COL] = None
            res = res[[n for n in names if n not in keys]]
        except Exception as error:
            if not failures:
                raise
            res = pd.DataFrame({ERROR_COL: [f"{type(error).__name__}: {error}"]})
        for i, k in enumerate(keys):
            res.insert(i, k, ident[k])
        for n in names:  # a failure has none of the result's columns
            if n not in res:
                res[n] = pd.Series([None] * len(res), dtype=object)
        return res[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []   # the file that the last batch left open
        for pdf in batches:
            if not len(pdf):
                continue
            seam = pd.concat([held[-1].tail(1), pdf]) if held else pdf
            fresh = np.zeros(len(seam), bool)
            for k in keys:
                one, two = seam[k].iloc[:-1].to_numpy(), seam[k].iloc[1:].to_numpy()
                fresh[1:] |= (one != two) & ~(pd.isna(one) & pd.isna(two))
            starts = np.flatnonzero(fresh[1:] if held else fresh)
            at = 0
            for to in [*starts.tolist(), len(pdf)]:
                if to > at:
                    held.append(pdf.iloc[at:to])
                if to < len(pdf) and held:   # another file begins here
                    yield run_file(pd.concat(held))
                    held = []
                at = to
        if held:
            yield run_file(pd.concat(held))

    ship_package()
    # files one after another in each task, in order: no call and no group per file,
    # and memory for one file and one batch, however many files there are
    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])))


def native_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """T5: a Spark-native transform, ``DataFrame -> DataFrame``."""
    return df.transform(fn)


def register_transforms(requests: DataFrame, existing: DataFrame, users: DataFrame,
                        datasets: DataFrame, with_refused: bool = False):
    """Turn registration requests into catalog rows and append them.

    ``requests`` carries names: ``username, name, in_dataset, in_action,
    out_dataset, out_action, src_file`` (+ optional ``timeout``, ``enabled``).
    User and dataset names are resolved to ids (J1, sentinel on a miss);
    names are sanitised (F7) and must then be 1-64 characters long, the
    timeout at most 1500, both actions PUT or POST, the source file a ``.py`` or
    ``.sql`` file, and the user and both datasets must resolve --
    other requests are refused with a reason. New ids continue above the
    current maximum (stable, see :func:`lakehook.operators.ids.with_ids`),
    without a global sort. Returns the
    new catalog snapshot, plus the refused requests when ``with_refused``.
    """
    from lakehook.functions.scalars import sanitize_name
    from lakehook.operators.ids import with_ids
    from lakehook.operators.lookup import name_to_id
    from lakehook.operators.quality import MAX_TIMEOUT, TRANSFORM_NAME_LENGTH
    from lakehook.schemas import DEFAULT_TIMEOUT, MISSING_ID, OBJECT_FILE, SERVICE_DATASETS, TRIGGER_ACTIONS

    r = name_to_id(requests, "username", users, "username", "user_id", "user_id")
    r = name_to_id(r, "in_dataset", datasets, "name", "dataset_id", "in_dataset_id")
    r = name_to_id(r, "out_dataset", datasets, "name", "dataset_id", "out_dataset_id")
    timeout = F.col("timeout") if "timeout" in requests.columns else F.lit(DEFAULT_TIMEOUT)
    enabled = F.col("enabled") if "enabled" in requests.columns else F.lit(True)
    r = r.withColumn("__name", sanitize_name("name")).withColumn("__timeout", timeout)
    lo, hi = TRANSFORM_NAME_LENGTH
    reason = (F.when(F.col("user_id") == MISSING_ID, F.lit("unknown_user"))
              .when((F.col("in_dataset_id") == MISSING_ID) | (F.col("out_dataset_id") == MISSING_ID),
                    F.lit("unknown_dataset"))
              .when(~F.coalesce(F.length("__name").between(lo, hi), F.lit(False)),
                    F.lit("name_length"))
              .when(~F.coalesce(F.col("in_action").isin(*TRIGGER_ACTIONS), F.lit(False)),
                    F.lit("in_action"))
              .when(~F.coalesce(F.col("out_action").isin(*TRIGGER_ACTIONS), F.lit(False)),
                    F.lit("out_action"))
              .when(~F.coalesce(F.col("src_file").rlike(r"\.(py|sql)$"), F.lit(False)),
                    F.lit("source_file"))
              .when(~F.coalesce(F.col("__timeout") <= MAX_TIMEOUT, F.lit(False)),
                    F.lit("timeout_bound")))
    r = r.withColumn("__reason", reason)
    ok = r.filter(F.col("__reason").isNull())
    base = existing.agg(F.coalesce(F.max("transform_id"), F.lit(0)).alias("m")).first()["m"]
    new = with_ids(ok, {"transform_id": base + 1}).select(
        F.col("user_id").cast("long"), "transform_id",
        F.col("__name").alias("name"),
        F.lit(SERVICE_DATASETS).alias("in_service"),
        F.col("in_dataset_id").cast("long"),
        F.col("in_action"), F.lit(OBJECT_FILE).alias("in_object"),
        F.lit(SERVICE_DATASETS).alias("out_service"),
        F.col("out_dataset_id").cast("long"),
        F.col("out_action"), F.lit(OBJECT_FILE).alias("out_object"),
        F.col("src_file"),
        F.col("__timeout").cast("decimal(4,0)").alias("timeout"),
        enabled.cast("boolean").alias("enabled"))
    snapshot = existing.unionByName(new.select(*existing.columns))
    if not with_refused:
        return snapshot
    refused = r.filter(F.col("__reason").isNotNull()).select(
        *requests.columns, F.col("__reason").alias("reason"))
    return snapshot, refused
