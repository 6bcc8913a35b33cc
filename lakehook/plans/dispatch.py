"""Batch dispatch of matched events to their transforms.

Input is the match result of :func:`lakehook.operators.match.match_triggers`
plus the lake data the events point at. A "file" is identified by key
columns (``file_keys``) of the data; every matched event names one file.

* :func:`dispatch_files` runs each registration's own source file -- pandas,
  SQL or a DataFrame function -- over exactly the files that matched events
  name, one output per file, with failures noted in the batch's manifest.
* :func:`dispatch_python` and :func:`dispatch_sql` do so for one transform body
  or one script over a keyed table, all files in one job.
* :func:`record_outputs` enters the outputs in the file catalog and logs
  them as transform output, which never re-triggers; :func:`run_batch`
  chains match, dispatch, recording and the processed flag.

Outputs of keyed tables are written as Parquet under ``out_root``, partitioned by output
dataset, batch id and writing job, with the output file name (the input
file's base name with a ``.parquet`` extension) as a column; rows are sorted
by it inside each Parquet file so a single file's rows are found through
row-group statistics. The number of physical files therefore follows the
number of tasks, not the number of matched files. Writes use dynamic
partition overwrite: re-running a batch replaces exactly the partitions it
produced, so replays are idempotent; :func:`read_outputs` returns the latest
version of every output file (a later batch rewriting a file name replaces
it).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakehook.plans.transforms import ERROR_COL, TABLE_NAME, per_file_transform, sql_per_file
from lakehook.session import checkpoint_root, scratch_path, scratch_scope, stored, time_limit
from lakehook.sources.files import SOURCE_FILE_COL, read_files
from lakehook.sources.storage import write_empty

OUT_FILE_COL = "out_file"
OUT_DATASET_COL = "out_dataset_id"
BATCH_COL = "batch_id"
JOB_COL = "job"


def work_items(matched: DataFrame, file_keys: list[str]) -> DataFrame:
    """Distinct (file, transform) pairs of a batch. Several events on the same
    file and transform collapse into one run (its output would be the same)."""
    extra = [c for c in ("src_file",) if c in matched.columns]
    return matched.select(*file_keys, "transform_id", "out_dataset_id", *extra).distinct()


def _write(result: DataFrame, out_root: str, batch_id: int, job: str) -> None:
    """Partitions are (dataset, batch, job): ``job`` names the writing job
    deterministically, so jobs running concurrently never overwrite each
    other's partitions, while a replay of the same job rewrites its own."""
    (result.withColumn(BATCH_COL, F.lit(batch_id).cast("long"))
     .withColumn(JOB_COL, F.lit(job))
     .sortWithinPartitions(OUT_DATASET_COL, OUT_FILE_COL)
     .write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(OUT_DATASET_COL, BATCH_COL, JOB_COL)
     .parquet(out_root))


def read_outputs(spark: SparkSession, out_root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Latest version of every output file: rows of the highest batch that
    wrote each (output dataset, file name). The version pick is a grouped
    max (combined map-side) joined back on the key, not a window over rows."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    out = reader.parquet(out_root)
    latest = out.groupBy(OUT_DATASET_COL, OUT_FILE_COL).agg(F.max(BATCH_COL).alias(BATCH_COL))
    return (out.join(latest, [OUT_DATASET_COL, OUT_FILE_COL, BATCH_COL], "left_semi")
            .drop(BATCH_COL, JOB_COL))


def dispatch_python(matched: DataFrame, data: DataFrame, file_keys: list[str],
                    file_name: Column, process_df: Callable, out_schema: T.StructType | str,
                    out_root: str, batch_id: int = 0, order_by: tuple[str, ...] = ()) -> None:
    """Run a per-file pandas transform for every (file, transform) of the
    batch in one job and write the results.

    The batch's work items are checkpointed first (reliable checkpoint in the
    shared folder): the match -- a scan of the event log -- runs exactly
    once, and executor loss after that point never re-runs it. The data is read
    once and shuffled once, by file and transform. ``file_name`` is a Column
    over ``file_keys`` giving the output file name.
    """
    checkpoint_root(data.sparkSession)
    work = work_items(matched, file_keys).checkpoint(eager=True)
    group = file_keys + ["transform_id", "out_dataset_id"]
    result = per_file_transform(data.join(work.drop("src_file"), file_keys), process_df, out_schema, group,
                                order_by=order_by)
    _write(result.withColumn(OUT_FILE_COL, file_name), out_root, batch_id, "py")


# Files that one job opens at most (about). Spark's file index keeps the paths of
# a job's files on the driver, so this bounds that list.
FILES_PER_JOB = 10_000

# Columns of a work item that travel with its rows, and the layout of outputs.
# The prefix keeps them apart from the columns of the files and of the scripts.
ITEM = ["lake_source", "lake_user", "lake_transform", "lake_dataset", "lake_output", "lake_name"]
LAYOUT = ["lake_dataset", "lake_user", "lake_output", "lake_name"]

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (
    ("user_id", T.LongType()), ("transform_id", T.LongType()), ("out_dataset_id", T.LongType()),
    ("src_file", T.StringType()), ("source_file", T.StringType()), ("name", T.StringType()),
    ("path", T.StringType()), ("n_rows", T.LongType()), ("error", T.StringType()))])


def dispatch_files(spark: SparkSession, matched: DataFrame, resolve: Callable, out_root: str,
                   batch_id: int = 0, csv_schema=None, max_parallel: int = 8,
                   files_per_job: int = FILES_PER_JOB) -> DataFrame | None:
    """T7 over lake files: every matched event runs *its own registration's*
    source file over the file that it names in ``object_details``.

    ``resolve(src_file)`` gives the registration's runtime and body:

    * ``("pandas_file", process_df, schema)``: all files of the script in one
      job, pandas file by file in the file's row order, whatever its size;
    * ``("sql", text)``: all files in one job, the script over each file by itself
      (:func:`lakehook.plans.transforms.sql_per_file`); files of one script are
      read with their columns merged by name;
    * ``("sql_file", text)`` or ``("spark_frame", fn)``: a job for each file; this is
      also what becomes of an ``sql`` script that Catalyst cannot decorrelate, as
      one with a subquery inside a subquery.

    A result is one output: (user, output dataset, source file, transform), under
    the source file's base name with a ``.parquet`` extension, in a directory of
    its own that the catalog can point to; files with one base name, and files of
    two users, never meet. A rerun replaces an output, also by an empty one. A
    file whose script raises leaves its earlier output and does not stop others:
    of a job over many files that fails, halves are run until the file is alone,
    and then the script by itself.

    A registration's ``timeout`` (seconds) bounds the work on each file: pandas
    code by an alarm in its task, jobs by cancelling their tag; a job over n files
    has n times as long before it is halved.

    The work items are a stored table. A script's function runs once per item and
    attempt: its rows are written to the scratch space, and outputs, counts and the
    manifest are made from there. The manifest is a join of the work items with
    these counts; empty outputs are written by tasks. On the driver are the scripts
    and the paths of one job's files, at most about ``files_per_job``.

    Returns the batch's manifest (also under ``<out_root>-manifest``): user_id,
    transform_id, out_dataset_id, src_file, source_file, name, path, n_rows,
    error; or None when nothing matched.
    """
    with scratch_scope(spark):
        work = stored(_files_to_run(matched), "dispatch-work")
        scripts = work.groupBy("src_file", "timeout").agg(
            F.count_distinct("lake_source").alias("files")).collect()  # a catalog's scripts
        if not scripts:
            return None
        parts = scratch_path(spark, "dispatch-manifest")
        for r in sorted(scripts, key=lambda r: (r["src_file"], r["timeout"] or 0)):
            job = _Job(spark, r["src_file"], resolve(r["src_file"]), r["timeout"], out_root, parts, csv_schema, max_parallel)
            chunks = -(-r["files"] // files_per_job)
            for k in range(chunks):
                job.run(work.where(F.col("src_file").eqNullSafe(r["src_file"]) & F.col("timeout").eqNullSafe(r["timeout"])
                                   & (F.pmod(F.xxhash64("lake_source"), F.lit(chunks)) == k)))
        target = f"{out_root.rstrip('/')}-manifest/batch_id={batch_id}"
        spark.read.schema(MANIFEST).parquet(parts).write.mode("overwrite").parquet(target)
    return spark.read.schema(MANIFEST).parquet(target)


def _files_to_run(matched: DataFrame) -> DataFrame:
    """Distinct (file, transform) pairs of a batch with their output's key and name."""
    from lakehook.functions import scalars as S
    from lakehook.sources.files import normalize_path

    obj = F.col("object_details")
    limit = F.col("timeout").cast("double") if "timeout" in matched.columns else F.lit(None).cast("double")
    work = matched.select(
        normalize_path(F.get_json_object(obj, "$.path")).alias("lake_source"),
        F.lower(F.get_json_object(obj, "$.file_extension")).alias("ext"),
        F.col("user_id").alias("lake_user"), F.col("transform_id").alias("lake_transform"),
        F.col("out_dataset_id").alias("lake_dataset"), "src_file", limit.alias("timeout")).distinct()
    return work.withColumns({
        "lake_name": S.force_parquet_extension(S.base_name("lake_source")),
        "lake_output": output_key("lake_transform", "lake_source")})


class _Job:
    """One script over files that one job can open."""

    def __init__(self, spark, script, runtime, timeout, out_root, parts, csv_schema, max_parallel):
        self.spark, self.script, self.timeout = spark, script, timeout
        self.kind, self.body, *self.schema = runtime
        self.root = script_root(out_root, script)
        self.parts, self.csv_schema, self.max_parallel = parts, csv_schema, max_parallel

    def run(self, work: DataFrame) -> None:
        """Outputs of the work items, and their rows of the manifest."""
        runs = {"pandas_file": self._pandas, "sql": self._sql, "sql_file": self._each, "spark_frame": self._each}
        if self.kind not in runs:
            raise ValueError(f"unknown runtime {self.kind!r} of {self.script}")
        self.items = scratch_path(self.spark, "dispatch-items")
        work.withColumn("path", _place(self.root)).write.parquet(self.items)
        items = self._items(self.spark)
        runs[self.kind](items).select(
            F.col("lake_user").alias("user_id"), F.col("lake_transform").alias("transform_id"),
            F.col("lake_dataset").alias("out_dataset_id"), F.lit(self.script).alias("src_file"),
            F.col("lake_source").alias("source_file"), F.col("lake_name").alias("name"), "path",
            F.col("n").cast("long").alias("n_rows"), "error").write.mode("append").parquet(self.parts)

    def _items(self, session: SparkSession) -> DataFrame:
        return session.read.parquet(self.items)

    def _paths(self, items: DataFrame) -> list[tuple[str, str]]:
        return sorted(tuple(r) for r in items.select("lake_source", "ext").distinct().collect())

    def _read(self, session: SparkSession, paths: list[tuple[str, str]], positions: bool = False) -> DataFrame:
        by_ext: dict[str, list[str]] = {}
        for path, ext in paths:
            by_ext.setdefault(ext, []).append(path)
        return read_files(session, by_ext, self.csv_schema, positions)

    def _pandas(self, items: DataFrame) -> DataFrame:
        data = self._read(self.spark, self._paths(items), positions=True).withColumnRenamed(SOURCE_FILE_COL, "lake_source")
        rows = stored(per_file_transform(data.join(items.select(*ITEM), "lake_source"), self.body, self.schema[0],
                                         ITEM, failures=True, timeout=self.timeout), "dispatch-rows")
        errors = rows.where(F.col(ERROR_COL).isNotNull()).select(
            "lake_output", "lake_user", "lake_dataset", F.col(ERROR_COL).alias("error"))
        return self._written(items, [rows.where(F.col(ERROR_COL).isNull()).drop(ERROR_COL)], errors)

    def _sql(self, items: DataFrame) -> DataFrame:
        """The script over all files; over halves of them where that fails.

        A file that fails alone, and every file of a script that Catalyst cannot
        decorrelate, is left to the script by itself.
        """
        results, alone, open_ = [], [], [self._paths(items)]
        every = len(open_[0])
        while open_:
            paths = open_.pop()
            try:
                with time_limit(self.spark, self.timeout and self.timeout * len(paths)):
                    results.append(stored(self._over(paths, every), "dispatch-rows"))
            except Exception:  # the script's own failure, which its file gets alone
                if len(paths) > 1 and (len(paths) < every or self._runs_at_all(paths)):
                    open_ += [paths[len(paths) // 2:], paths[:len(paths) // 2]]
                else:
                    alone += paths
        if not alone:
            return self._written(items, results, self._errors())
        left = F.broadcast(self.spark.createDataFrame([(p,) for p, _ in alone], "lake_source string"))
        rest = self._each(items.join(left, "lake_source", "left_semi"))
        done = items.join(left, "lake_source", "left_anti")
        return self._written(done, results, self._errors()).select(rest.columns).union(rest)

    def _over(self, paths: list[tuple[str, str]], every: int, rows: int | None = None) -> DataFrame:
        session = self.spark.newSession()
        mine = self._items(session).select(*ITEM)
        if len(paths) < every:
            some = session.createDataFrame([(p,) for p, _ in paths], "lake_source string")
            mine = mine.join(F.broadcast(some), "lake_source").select(*ITEM)
        data = self._read(session, paths)
        return sql_per_file(self.body, data if rows is None else data.limit(rows), mine, (SOURCE_FILE_COL, "lake_source"))

    def _runs_at_all(self, paths: list[tuple[str, str]]) -> bool:
        """Whether the script over many files at once can be planned and run, by one row."""
        try:
            self._over(paths[:1], len(paths), rows=1).collect()
            return True
        except Exception:
            return False

    def _errors(self) -> DataFrame:
        return self.spark.createDataFrame([], "lake_output string, lake_user long, lake_dataset long, error string")

    def _written(self, items: DataFrame, results: list[DataFrame], errors: DataFrame) -> DataFrame:
        """Outputs from stored rows; the items with n and error."""
        keys = ["lake_output", "lake_user", "lake_dataset"]
        counts = self.spark.createDataFrame([], "lake_output string, lake_user long, lake_dataset long, n long")
        for rows in results:
            counts = counts.union(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
            (rows.drop("lake_source", "lake_transform").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(self.root))
        # a file's script raises once or gives rows
        errors = errors.groupBy(*keys).agg(F.min("error").alias("error"))
        done = items.join(counts, keys, "left").join(errors, keys, "left")
        done = stored(done.withColumn("n", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))), "dispatch-done")
        if results:
            write_empty(done.where("n = 0"), results[0].drop(*ITEM).schema)
        return done

    def _each(self, items: DataFrame) -> DataFrame:
        """A job for each work item."""
        todo = [r.asDict() for r in items.select("lake_source", "ext", "lake_output", "path").collect()]

        def execute(i):
            try:
                with time_limit(self.spark, self.timeout):
                    session = self.spark.newSession()
                    frame = self._read(session, [(i["lake_source"], i["ext"])]).drop(SOURCE_FILE_COL)
                    if self.kind == "spark_frame":
                        frame = self.body(frame)
                    else:
                        frame.createOrReplaceTempView(TABLE_NAME)
                        frame = session.sql(self.body)
                    frame.write.mode("overwrite").parquet(i["path"])
                return session.read.parquet(i["path"]).count(), None
            except Exception as error:  # the script's own failure: noted, others go on
                return None, _said(error)

        with ThreadPoolExecutor(max_workers=max(1, self.max_parallel)) as pool:
            done = [(i["path"], n, error) for i, (n, error) in zip(todo, pool.map(execute, todo))]
        # items share a file when several registrations match it, but no path
        return items.join(F.broadcast(self.spark.createDataFrame(done, "path string, n long, error string")), "path").select(
            *items.columns, "n", "error")


def _said(error: Exception) -> str:
    """The error and what it was caused by first of all."""
    text = str(error)
    causes = [line.removeprefix("Caused by: ") for line in map(str.strip, text.split("\n")) if line.startswith("Caused by: ")]
    return f"{type(error).__name__}: {text[:500]}" + (f" ... caused by {causes[-1][:400]}" if causes and causes[-1] not in text[:500] else "")


def script_root(out_root: str, script: str) -> str:
    """The directory of a script's outputs."""
    return f"{out_root.rstrip('/')}/script={script.rsplit('/', 1)[-1]}"


# The characters that Spark writes as %XX in a partition's directory.
ESCAPED = "%\"#'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32)))


def _place(root: str) -> Column:
    """Directory of an item's output, as ``partitionBy`` lays it out."""
    name = F.col("lake_name")
    for c in ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(f"{root}/lake_dataset="), F.col("lake_dataset").cast("string"), F.lit("/lake_user="),
                    F.col("lake_user").cast("string"), F.lit("/lake_output="), "lake_output", F.lit("/lake_name="), name)


def output_rows(spark: SparkSession, manifest: DataFrame, out_root: str) -> DataFrame:
    """Rows of a manifest's outputs with user_id, out_dataset_id, src_file and name.

    Scripts' output directories are read whole and joined with the manifest, so no
    path is listed; outputs that the manifest does not name are left out.
    """
    scripts = [r[0] for r in manifest.where("error is null and n_rows > 0").select("src_file").distinct().collect()]
    keys = manifest.where("error is null").select(
        "user_id", "out_dataset_id", "src_file", "name", output_key("transform_id", "source_file").alias("lake_output"))
    out = None
    for script in sorted(scripts):
        rows = spark.read.option("mergeSchema", True).parquet(script_root(out_root, script)).drop("lake_name").withColumns({
            "user_id": F.col("lake_user").cast("long"), "out_dataset_id": F.col("lake_dataset").cast("long"),
            "src_file": F.lit(script)}).drop("lake_user", "lake_dataset")
        rows = rows.join(keys, ["user_id", "out_dataset_id", "src_file", "lake_output"]).drop("lake_output")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def output_key(transform: str, source: str) -> Column:
    """Names an output by its transform and source file; never read as a number."""
    return F.concat(F.lit("o"), F.hex(F.xxhash64(transform, source)))


def dispatch_sql(spark: SparkSession, matched: DataFrame,
                 data_reader: Callable[[SparkSession], DataFrame], file_keys: list[str],
                 scripts: dict[str, str] | Callable[[str], str], out_root: str,
                 work_path: str, max_parallel: int = 8, batch_id: int = 0,
                 scope: str = "file") -> list[tuple]:
    """Run the SQL scripts of the fired transforms and write their outputs.

    ``scope`` decides what one script run sees as ``return_arrow_table``:

    * ``"script"``: for row-local scripts only, as it puts all users' files
      together: one job per (script, output dataset) over the UNION ALL of the matched files of every transform in the group (a file
      matched by two transforms appears twice). For row-local scripts this
      equals the union of per-transform outputs. Output file: the script's
      base name with a ``.parquet`` extension. Jobs are bounded by the
      catalog (scripts x datasets), not by how many events fired.
    * ``"transform"``: one job per fired transform over its files (exact
      per-transform input for aggregating scripts); output
      ``t<transform_id>.parquet``.
    * ``"file"`` (default): the exact per-file semantics for any script that
      Catalyst can decorrelate, one job per script over all its (transform, file)
      pairs (:func:`lakehook.plans.transforms.sql_per_file`); output: the file's
      base name (``source_file`` keys) or its key values, with a ``.parquet``
      extension.

    The batch's work items are first written to ``work_path`` in the shared
    checkpoint folder: that cuts the match lineage, survives executor loss,
    and lets every job's private session read them. ``scripts`` maps a
    registration's ``src_file`` to its SQL text; ``data_reader(session)``
    builds the lake data inside a given session. Only the list of groups (scripts
    and datasets, fired transforms, or scripts) reaches the driver. Jobs run
    concurrently (``max_parallel``). Returns the groups that ran.
    """
    from lakehook.functions import scalars as S
    from lakehook.sources.files import parquet_target

    keys_of = {"script": ["src_file", "out_dataset_id"],
               "transform": ["transform_id", "out_dataset_id"],
               "file": ["src_file"]}
    if scope not in keys_of:
        raise ValueError(f"unknown scope {scope!r}")
    key = keys_of[scope]
    work_items(matched, file_keys).write.mode("overwrite").parquet(work_path)
    work = spark.read.parquet(work_path)
    groups = [tuple(r) for r in work.select(*key).distinct().collect()]
    script_text = scripts if callable(scripts) else scripts.__getitem__

    def whole(group, session, mine) -> tuple[DataFrame, str]:
        """The script over all the group's rows; its output file."""
        src = group[0] if scope == "script" else mine.select("src_file").first()["src_file"]
        out_file = parquet_target(group[0].rsplit("/", 1)[-1]) if scope == "script" else f"t{group[0]}.parquet"
        data_reader(session).join(mine.select(*file_keys), file_keys, "inner").createOrReplaceTempView(TABLE_NAME)
        result = session.sql(script_text(src)).withColumns({
            OUT_DATASET_COL: F.lit(group[1]).cast("long"), OUT_FILE_COL: F.lit(out_file)})
        return result, f"sql-{out_file}"

    def each_file(group, session, mine) -> tuple[DataFrame, str]:
        """The script over every (transform, file) by itself."""
        one_key = F.to_json(F.struct(*file_keys))
        present = F.lit(True)
        for k in file_keys:
            present = present & F.col(k).isNotNull()
        name = (S.force_parquet_extension(S.base_name("source_file")) if file_keys == ["source_file"] else
                F.concat(F.lit("t"), F.col("transform_id").cast("string"), F.lit("_"),
                         F.concat_ws("_", *[F.col(k).cast("string") for k in file_keys]), F.lit(".parquet")))
        items = mine.where(present).select(one_key.alias("lake_key"), F.col("out_dataset_id").alias("lake_dataset"),
                                           name.alias("lake_name"))
        rows = data_reader(session).where(present).withColumn("lake_key", one_key)
        wanted = rows.join(items.select("lake_key").distinct(), "lake_key", "left_semi")
        result = sql_per_file(script_text(group[0]), wanted, items, ("lake_key", "lake_key")).drop("lake_key")
        return result.withColumnsRenamed({"lake_dataset": OUT_DATASET_COL, "lake_name": OUT_FILE_COL}), f"sql-{group[0].rsplit('/', 1)[-1]}"

    def execute(group):
        session = spark.newSession()
        mine = session.read.parquet(work_path)
        for k, v in zip(key, group):
            mine = mine.filter(F.col(k) == F.lit(v))
        result, job = (each_file if scope == "file" else whole)(group, session, mine)
        _write(result, out_root, batch_id, job)
        return group

    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
        return list(pool.map(execute, groups))


def record_outputs(outputs: DataFrame, files: DataFrame, now, next_file_id: int, next_log_id: int):
    """Catalog side of a dispatched batch (M3 + S8 for transform output).

    ``outputs`` has one row per written output: user_id, dataset_id, name, path.
    Every output is upserted into the ``files`` catalog keyed by (user, dataset,
    path): a path seen before only gets a new modification time, a new one gets a
    row and one POST event flagged ``is_transform_output`` -- the gate and the
    matcher skip such events, so transform output never triggers another
    transform. Returns ``(catalog_snapshot, output_events)``.
    """
    from lakehook.functions import scalars as S
    from lakehook.operators.ids import with_ids
    from lakehook.operators.mutate import upsert
    from lakehook.sources.files import log_rows

    ts = F.lit(now).cast("timestamp_ntz")
    staged = with_ids(outputs.select("user_id", "dataset_id", "name", "path").distinct(),
                      {"file_id": next_file_id, "__log_id": next_log_id})
    incoming = staged.select(
        F.col("user_id").cast("long"), F.col("dataset_id").cast("long"), "file_id",
        "name", "path", F.lit(None).cast("string").alias("owner"),
        ts.alias("creation_date"), ts.alias("last_modified"),
        F.lit(None).cast("string").alias("size"), F.lit(None).cast("long").alias("size_bytes"),
        S.file_extension("name").alias("file_extension"),
        F.array().cast("array<string>").alias("tags"), F.lit("hot").alias("storage_class"),
        "__log_id")
    keys = ["user_id", "dataset_id", "path"]
    snapshot = upsert(files.select(*incoming.drop("__log_id").columns), incoming.drop("__log_id"), keys)
    new = incoming.join(files.select(*keys), keys, "left_anti")
    events = log_rows(new.select(
        F.col("__log_id").alias("log_id"),
        "user_id", F.lit("POST").alias("action"), "dataset_id",
        F.lit("transformOutput").alias("description"),
        S.to_json_object("name", "path", "creation_date", "last_modified", "file_extension",
                         iso_dates=("creation_date", "last_modified")).alias("object_details"),
        F.lit(True).alias("is_transform_output")), created=now)
    return snapshot, events


def run_batch(spark: SparkSession, log: DataFrame, transforms: DataFrame, files: DataFrame,
              resolve: Callable, out_root: str, log_out: str, files_out: str, now,
              batch_id: int, csv_schema=None) -> dict:
    """One complete batch of T7 over lake snapshots.

    1. the batch's high-water mark is fixed (largest pending event id);
    2. pending events up to it are matched (J2) and each runs its registration's
       source file over its file (:func:`dispatch_files`, S5);
    3. written outputs are upserted into the file catalog and logged as
       transform output (:func:`record_outputs`, M3 + S8);
    4. every event up to the mark is flagged processed (M5), those whose script
       failed too: the failure is in the manifest.

    The new event log and file catalog are written as new snapshots to
    ``log_out`` / ``files_out`` (never over the paths being read). Events
    that arrive while the batch runs lie above the mark and stay pending.
    Returns counts of the batch.
    """
    from lakehook.operators.match import mark_processed, match_triggers, pending

    hw = pending(log).agg(F.max("log_id").alias("hw")).first()["hw"]
    if hw is None:
        log.write.mode("overwrite").parquet(log_out)
        files.write.mode("overwrite").parquet(files_out)
        return {"high_water": None, "dispatched": 0, "failed": 0, "outputs": 0}
    batch = log.filter(F.col("log_id") <= F.lit(hw))
    with scratch_scope(spark):  # the match's ranked registrations
        manifest = dispatch_files(spark, match_triggers(batch, transforms), resolve, out_root, batch_id, csv_schema)
    new_files, new_log, counts = files, mark_processed(log, hw), (0, 0)
    if manifest is not None:
        next_file = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0] + 1
        next_log = log.agg(F.max("log_id")).first()[0] + 1
        new_files, events = record_outputs(
            manifest.where("error is null").select("user_id", F.col("out_dataset_id").alias("dataset_id"),
                                                   "name", "path"), files, now, next_file, next_log)
        new_log = new_log.unionByName(events.select(*new_log.columns))
        counts = manifest.agg(F.count(F.lit(1)), F.count("error")).first()
    new_log.write.mode("overwrite").parquet(log_out)
    new_files.write.mode("overwrite").parquet(files_out)
    return {"high_water": hw, "dispatched": counts[0], "failed": counts[1],
            "outputs": spark.read.parquet(log_out).filter(
                F.col("is_transform_output") & (F.col("log_id") > F.lit(hw))).count()}


def run_log_batch(spark: SparkSession, log_path: str, transforms: DataFrame, files: DataFrame,
                  resolve: Callable, out_root: str, files_out: str, now, batch_id: int, csv_schema=None) -> dict:
    """:func:`run_batch` over an appended log with a ledger (:mod:`lakehook.operators.ledger`).

    Reads the days with pending events only. Output events are appended to the log
    under the batch's name, and the processed range is one appended row of the
    ledger: the log itself is not rewritten. The range is written last, so a batch
    that fails before is repeated, and replaces what it has written. The new file
    catalog goes to ``files_out``. Returns counts of the batch.
    """
    from lakehook.operators import ledger
    from lakehook.operators.match import match_triggers

    batch = ledger.pending_events(spark, log_path)
    hw = batch.where(~F.coalesce("is_transform_output", F.lit(False))).agg(F.max("log_id")).first()[0]
    if hw is None:
        files.write.mode("overwrite").parquet(files_out)
        return {"high_water": None, "dispatched": 0, "failed": 0, "outputs": 0}
    counts, outputs = (0, 0), 0
    with scratch_scope(spark):
        matched = match_triggers(batch.where(F.col("log_id") <= hw).drop("day"), transforms)
        manifest = dispatch_files(spark, matched, resolve, out_root, batch_id, csv_schema)
        new_files = files
        if manifest is not None:
            next_file = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0] + 1
            new_files, events = record_outputs(
                manifest.where("error is null").select("user_id", F.col("out_dataset_id").alias("dataset_id"), "name", "path"),
                files, now, next_file, ledger.next_log_id(spark, log_path))
            events = stored(events, "output-events")
            outputs = events.count()
            ledger.append(events, log_path, writer=f"batch-{batch_id}")
            counts = manifest.agg(F.count(F.lit(1)), F.count("error")).first()
        new_files.write.mode("overwrite").parquet(files_out)
    ledger.mark(spark, log_path, hw, batch_id)
    return {"high_water": hw, "dispatched": counts[0], "failed": counts[1], "outputs": outputs}
