"""Scans and sinks of the lake.

All reads go through ``spark.read`` so column pruning and filter pushdown
reach the Parquet scan; all writes go through ``DataFrame.write`` so data
never passes through the driver. Only file *lists* (catalog metadata, the
same information Spark's own file index holds on the driver) are ever
collected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakehook.functions import scalars as S
from lakehook.operators import mutate as M
from lakehook.operators.ids import with_ids
from lakehook.schemas import OBJECT_FILE, SERVICE_DATASETS
from lakehook.session import scratch_path, scratch_scope, stored
from lakehook.sources.storage import copy_file, first_line, for_each, move_directory, write_empty

PARQUET_EXTENSIONS = ("pq", "parquet")
CSV_EXTENSIONS = ("csv",)
SOURCE_FILE_COL = "source_file"
PART_COL, ROW_COL = "__part", "__row"
# Files whose paths one job holds on the driver, as Spark's file index does, at most (about).
FILES_PER_JOB = 10_000


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet scan."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV scan with a header row. Pass ``schema`` whenever it is known;
    inference (an extra pass over the data) is the fallback."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(list(paths))


CORRUPT_COL = "_corrupt_record"


def read_csv_checked(spark: SparkSession, *paths: str, schema: T.StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S2 with a defined fate for bad rows: (good rows, rejected rows).

    A row is rejected when it has another number of fields than ``schema``
    (``columns``), a value that is not of its column's type (``type``), or cannot be
    taken apart otherwise (``record``); the rejected table has its file, the whole record as it stands there, and the
    reason. An empty value is NULL and no error. The files are parsed once, with all
    columns, into a stored table that both frames read: which rows are good does not
    depend on the columns that are selected later.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*declared.fields, T.StructField(CORRUPT_COL, T.StringType())])
    rows = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
            .schema(whole).csv(list(paths)))
    rows = stored(rows.withColumn(SOURCE_FILE_COL, logical_file()), "csv-checked")
    # commas outside of quotes
    short = F.size(F.split(F.regexp_replace(CORRUPT_COL, r'"(?:[^"\\]|\\.)*"', ""), ",")) != len(declared)
    absent = F.lit(False)
    for f in declared.fields:
        absent = absent | F.col(f"`{f.name}`").isNull()
    bad = rows.where(F.col(CORRUPT_COL).isNotNull()).select(
        SOURCE_FILE_COL, F.col(CORRUPT_COL).alias("record"),
        F.when(short, F.lit("columns")).when(absent, F.lit("type")).otherwise(F.lit("record")).alias("reason"))
    return rows.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL, SOURCE_FILE_COL), bad


def logical_file(file_path=None):
    """The lake file a row came from, as the catalog writes its path. Spark
    writes a "file" as a directory of ``part-*`` files; this strips the part
    file name (plain files stay unchanged), decodes the percent-encoding of
    the reported path and drops a local ``file:`` scheme."""
    path = F.col("_metadata.file_path") if file_path is None else file_path
    stripped = F.regexp_replace(path, "/part-[^/]*$", "")
    # Spark reports the path percent-encoded; decode it (protecting '+',
    # which form decoding would turn into a space)
    decoded = F.url_decode(F.regexp_replace(stripped, r"\+", "%2B"))
    return normalize_path(decoded)


def normalize_path(path):
    """Local-filesystem URIs (``file:/x``, ``file:///x``) as bare paths, so
    catalog paths and the paths Spark reports compare equal."""
    return F.regexp_replace(path, "^file:/+", "/")


def _with_source(df: DataFrame, positions: bool) -> DataFrame:
    if positions:
        # row_index exists for Parquet alone; CSV rows keep their split's order
        row = (F.col("_metadata.row_index") if "row_index" in _metadata_fields(df)
               else F.monotonically_increasing_id())
        df = df.withColumns({PART_COL: F.col("_metadata.file_path"), ROW_COL: row})
    return df.withColumn(SOURCE_FILE_COL, logical_file())


def _metadata_fields(df: DataFrame) -> list[str]:
    return df.select("_metadata").schema[0].dataType.fieldNames()


def _bound(header: Sequence[str], schema) -> T.StructType | None:
    """The declared types of a file's columns, in its order; text for the others."""
    if schema is None:
        return None
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in declared.fields}
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])


def _csv_by_header(spark: SparkSession, paths: list[str], schema) -> list[DataFrame]:
    """CSV files bound by column name: one read per distinct header. The headers are
    read in tasks, one line of each file; a declared schema gives the types of
    the columns that a file has, and its other columns are read as text. Files
    without a line have no columns and no rows."""
    if len(paths) == 1:  # Spark reads the header of the one file as it binds it
        header = spark.read.option("header", True).csv(paths).columns
        return [read_csv(spark, *paths, schema=_bound(header, schema))]
    todo = spark.createDataFrame([(p,) for p in paths], "landing_path string")
    groups = for_each(todo, first_line, "landing_path string, header array<string>").groupBy("header").agg(
        F.sort_array(F.collect_list("landing_path")).alias("paths")).collect()
    out = [read_csv(spark, *r["paths"], schema=_bound(r["header"], schema))
           for r in sorted(groups, key=lambda r: r["header"]) if r["header"]]
    return out or [read_csv(spark, *paths, schema=_bound([], schema) or T.StructType([]))]


def read_files(spark: SparkSession, paths_by_ext: dict[str, list[str]],
               csv_schema: T.StructType | str | None = None, positions: bool = False,
               schema: T.StructType | str | None = None) -> DataFrame:
    """Read files of several formats and schemas into one DataFrame, tagged with
    their source file, aligned by column name (missing columns are NULL).

    A declared ``schema`` is what the caller gets, of all files: Parquet footers are
    not read for their schemas then, and CSV columns are bound to it by their headers.
    Its types must be those of the Parquet files, or wider ones that Spark reads them as.

    ``positions`` adds each row's part file and place in it (``PART_COL``,
    ``ROW_COL``), the order in which a per-file transform gets its rows."""
    parts = []
    pq = [p for e in PARQUET_EXTENSIONS for p in paths_by_ext.get(e, [])]
    csv = [p for e in CSV_EXTENSIONS for p in paths_by_ext.get(e, [])]
    unknown = set(paths_by_ext) - set(PARQUET_EXTENSIONS) - set(CSV_EXTENSIONS)
    if unknown:
        raise ValueError(f"unsupported file extensions: {sorted(unknown)}")
    if pq:
        reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
        parts.append(_with_source(reader.parquet(*pq), positions))
    if csv:
        parts += [_with_source(df, positions) for df in _csv_by_header(spark, csv, csv_schema if schema is None else schema)]
    if not parts:
        raise ValueError("no files to read")
    if schema is not None:
        declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        own = [SOURCE_FILE_COL, *((PART_COL, ROW_COL) if positions else ())]
        parts = [p.select(*[(F.col(f"`{f.name}`") if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in declared.fields], *own) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _paths_by_ext(catalog_rows: DataFrame) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for r in catalog_rows.select("path", "file_extension").distinct().collect():
        grouped.setdefault(r["file_extension"].lower(), []).append(r["path"])
    return grouped


def scan_dataset(spark: SparkSession, files: DataFrame, user_id, dataset_id,
                 csv_schema=None, datasets: DataFrame | None = None) -> DataFrame:
    """S3: every file of one dataset, one read per format (and CSV header), unioned by
    name, each row tagged with its file.

    With the ``datasets`` table, the dataset's declared columns (``columns``, as DDL;
    see :func:`declare_columns`) are the schema, and no file is opened to find one.
    """
    mine = (F.col("user_id") == F.lit(user_id)) & (F.col("dataset_id") == F.lit(dataset_id))
    declared = datasets.filter(mine).select("columns").first() if datasets is not None else None
    return read_files(spark, _paths_by_ext(files.filter(mine)), csv_schema, schema=declared[0] if declared else None)


def declare_columns(datasets: DataFrame, user_id, dataset_id, columns: str) -> DataFrame:
    """The datasets table with the DDL of one dataset's columns in ``columns``."""
    T._parse_datatype_string(columns)  # refuses what is no schema
    before = F.col("columns") if "columns" in datasets.columns else F.lit(None).cast("string")
    mine = (F.col("user_id") == F.lit(user_id)) & (F.col("dataset_id") == F.lit(dataset_id))
    return datasets.withColumn("columns", F.when(mine, F.lit(columns)).otherwise(before))


def scan_catalog_file(spark: SparkSession, files: DataFrame, user_id, dataset_id, file_id,
                      csv_schema=None) -> DataFrame:
    """(user, dataset, file id) -> path and format from the catalog -> data.

    The lookup is scoped by all three keys, so two datasets holding files
    with the same name cannot be confused."""
    rows = files.filter((F.col("user_id") == F.lit(user_id)) & (F.col("dataset_id") == F.lit(dataset_id))
                        & (F.col("file_id") == F.lit(file_id)))
    return read_files(spark, _paths_by_ext(rows), csv_schema)


def parquet_target(path: str) -> str:
    """Driver-side twin of :func:`scalars.force_parquet_extension`."""
    if path.endswith(".parquet"):
        return path
    return re.sub(r"\.[^.]*$", "", path) + ".parquet"


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> str:
    """Parquet sink; the target's extension is forced to ``.parquet``.
    Returns the path actually written."""
    target = parquet_target(path)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def append_documents(df: DataFrame, path: str, id_cols: Sequence[str] | None = None,
                     partition_by: Sequence[str] | None = None, fmt: str = "json"):
    """Append schemaless documents to a collection directory.

    Every document gets an ``_id``: a SHA-256 of the JSON of ``id_cols`` when given
    (stable across retries and re-runs), else a random UUID -- in that case
    the tagged documents are checkpointed first, so a retried task cannot
    hand out different ids than the ones reported. Returns
    ``(count, ids)``: the count is an observed metric of the write itself
    (no second pass), ``ids`` a DataFrame of the appended ``_id`` values.
    """
    from pyspark.sql import Observation

    if id_cols:
        # as JSON, so that a NULL keeps its column
        ident = F.sha2(F.to_json(F.struct(*id_cols), {"ignoreNullFields": "false"}), 256)
        tagged = df.withColumn("_id", ident)
    else:
        tagged = df.withColumn("_id", F.expr("uuid()")).checkpoint(eager=True)
    obs = Observation("append_documents")
    writer = tagged.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return obs.get["n"], tagged.select("_id")


def log_rows(df: DataFrame, created: datetime | None = None) -> DataFrame:
    """Complete event-log rows from a DataFrame holding at least
    ``log_id, user_id, action, dataset_id``; the other columns get their
    defaults (service 'datasets', object 'file', not processed). The creation
    time is the given instant, else now as US Mountain wall-clock."""
    now_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                                 F.localtimestamp())
    ts = F.lit(created).cast("timestamp_ntz") if created is not None else S.local_time(now_utc)
    defaults = {
        "created_timestamp": ts,
        "description": F.lit(None).cast("string"),
        "service": F.lit(SERVICE_DATASETS),
        "host": F.lit(None).cast("string"),
        "host_details": F.lit(None).cast("string"),
        "object": F.lit(OBJECT_FILE),
        "object_details": F.lit(None).cast("string"),
        "is_transform_output": F.lit(False),
        "processed": F.lit(False),
    }
    from lakehook.schemas import EVENT_LOG
    cols = []
    for f in EVENT_LOG.fields:
        src = F.col(f.name) if f.name in df.columns else defaults[f.name]
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_events(rows: DataFrame, log_path: str) -> None:
    """Append event-log rows, partitioned by day for pruning.

    Rows of a day are brought together first, else every task would leave a file
    in every day; the rebalance splits a day that is too large for one task. Rows
    without a time stay, in the partition of the NULL day.
    """
    (rows.withColumn("day", F.to_date("created_timestamp")).hint("rebalance", "day")
         .write.mode("append").partitionBy("day").parquet(log_path))


def _landed(spark: SparkSession, landing: DataFrame, dataset_root: str, csv_schema) -> DataFrame:
    """(name, path, size_bytes) of landing files brought into the dataset, as a stored
    table; a number of jobs that depends on the distinct CSV headers alone."""
    target = F.concat(F.lit(f"{dataset_root.rstrip('/')}/"), S.force_parquet_extension("name"))
    todo = stored(landing.select("name", "landing_path", F.lower("file_extension").alias("ext"), target.alias("path")), "ingest")
    known = F.col("ext").isin(*PARQUET_EXTENSIONS, *CSV_EXTENSIONS)
    if odd := todo.where(~F.coalesce(known, F.lit(False))).select("ext").distinct().limit(5).collect():
        raise ValueError(f"unsupported file extensions: {sorted(str(r[0]) for r in odd)}")
    ddl = "name string, landing_path string, path string"
    # Parquet files are copied as they are
    done = [stored(for_each(todo.where(F.col("ext").isin(*PARQUET_EXTENSIONS)).select("name", "landing_path", "path"),
                            copy_file, ddl + ", size_bytes long"), "ingest-copied")]
    headed = stored(for_each(todo.where(F.col("ext").isin(*CSV_EXTENSIONS)).select("name", "landing_path", "path"),
                             first_line, ddl + ", header array<string>"), "ingest-headers")
    for r in headed.groupBy("header").agg(F.count(F.lit(1)).alias("n")).orderBy("header").collect():
        mine = headed.where(F.col("header") == F.array(*map(F.lit, r["header"])) if r["header"] else F.size("header") == 0)
        chunks = -(-r["n"] // FILES_PER_JOB)
        for k in range(chunks):
            some = mine.where(F.pmod(F.xxhash64("landing_path"), F.lit(chunks)) == k)
            done.append(_written_csv(spark, some, r["header"], dataset_root, csv_schema))
    out = done[0].select("name", "path", "size_bytes")
    for d in done[1:]:
        out = out.union(d.select("name", "path", "size_bytes"))
    return out


def _written_csv(spark: SparkSession, files: DataFrame, header: list[str], dataset_root: str, csv_schema) -> DataFrame:
    """CSV files with one header as Parquet: one read, one partitioned write, one job of moves."""
    place = F.hex(F.xxhash64("path"))
    files = files.select("name", "path", normalize_path("landing_path").alias("landing_path"),
                         F.concat(F.lit("f"), place).alias("lake_file"))
    staging = scratch_path(spark, "ingest-staged")
    empty = T.StructType([])
    if header:
        paths = [r[0] for r in files.select("landing_path").collect()]  # those of one job
        rows = _with_source(read_csv(spark, *paths, schema=_bound(header, csv_schema)), False)
        empty = rows.drop(SOURCE_FILE_COL).schema
        (rows.join(files.select(F.col("landing_path").alias(SOURCE_FILE_COL), "lake_file"), SOURCE_FILE_COL).drop(SOURCE_FILE_COL)
         .write.partitionBy("lake_file").parquet(staging))
        # a header alone gives no directory: those files are empty tables
        full = spark.read.schema(T.StructType([*empty.fields, T.StructField("lake_file", T.StringType())])).parquet(staging)
        full = full.groupBy("lake_file").agg(F.count(F.lit(1)).alias("rows"))
        files = stored(files.join(full, "lake_file", "left"), "ingest-files")
        bare = files.where("rows is null").withColumn("path", F.concat(F.lit(f"{staging}/lake_file="), "lake_file"))
    else:
        bare = files.withColumn("path", F.concat(F.lit(f"{staging}/lake_file="), "lake_file"))
    write_empty(bare, empty)
    moves = files.select("name", "path", F.concat(F.lit(f"{staging}/lake_file="), "lake_file").alias("staged"))
    return stored(for_each(moves, move_directory, "name string, path string, staged string, size_bytes long"), "ingest-moved")


def ingest(spark: SparkSession, landing: DataFrame, files: DataFrame, dataset_root: str,
           user_id: int, dataset_id: int, owner: str, now: datetime,
           next_file_id: int, next_log_id: int, csv_schema=None):
    """Land files into a dataset, upsert the catalog, log new uploads.

    ``landing`` lists ``(name, landing_path, file_extension)`` of the files to
    ingest. Each file lands as Parquet under ``dataset_root`` with the
    same base name; its catalog size is what was really written. Parquet files are
    copied as they are, file by file in tasks of one job; CSV files with one header
    are read and written together (one job for about ``FILES_PER_JOB`` of them) and
    each brought to its path, so the number of jobs does not follow the number of
    files. The catalog gets a new row per new
    path, or only a new modification time for an existing one -- and only new
    paths produce a POST event. CSV files are read with ``csv_schema`` when given, else
    with types inferred over the files of one header; a CSV file without a line is a
    table without columns. Returns ``(catalog_snapshot, new_events)`` as
    DataFrames.
    """
    with scratch_scope(spark):  # rows with ids are checkpointed
        landed = _landed(spark, landing, dataset_root, csv_schema).withColumn("path", normalize_path("path"))
        landed = with_ids(landed, {"file_id": next_file_id, "__log_id": next_log_id})
    ts = F.lit(now).cast("timestamp_ntz")
    staged = landed.select(
        F.lit(user_id).cast("long").alias("user_id"),
        F.lit(dataset_id).cast("long").alias("dataset_id"),
        "file_id", "__log_id",
        S.base_name("path").alias("name"), F.col("path"),
        F.lit(owner).alias("owner"), ts.alias("creation_date"), ts.alias("last_modified"),
        S.human_size("size_bytes").alias("size"), F.col("size_bytes"),
        F.lit("parquet").alias("file_extension"),
        F.array().cast("array<string>").alias("tags"), F.lit("hot").alias("storage_class"))
    incoming = staged.drop("__log_id")
    keys = ["user_id", "dataset_id", "path"]
    snapshot = M.upsert(files.select(*incoming.columns), incoming, keys)
    new_paths = staged.join(files.select(*keys), keys, "left_anti")
    events = log_rows(new_paths.select(
        F.col("__log_id").alias("log_id"),
        "user_id", F.lit("POST").alias("action"), "dataset_id",
        F.lit("uploadFile").alias("description"),
        S.to_json_object("name", "path", "owner", "creation_date", "last_modified", "size",
                         "file_extension", iso_dates=("creation_date", "last_modified"))
        .alias("object_details")), created=now)
    return snapshot, events


def update_file_tags(files: DataFrame, changes: DataFrame, now: datetime, next_log_id: int):
    """Tag update of catalog files (M2 + F12), logged as PUT events.

    ``changes`` holds ``user_id, dataset_id, path, tags_text`` (comma
    separated; empty entries dropped). The file is found by its stored path,
    so the PUT event is always produced and PUT-triggered transforms can
    fire. Returns ``(catalog_snapshot, put_events)``.
    """
    keys = ["user_id", "dataset_id", "path"]
    ch = changes.select(*keys, S.split_tags("tags_text").alias("tags"))
    snapshot = M.update_rows(files, ch, keys, {
        "tags": F.col("new_tags"), "last_modified": F.lit(now).cast("timestamp_ntz")})
    hit = with_ids(files.select(*keys, "name").join(ch, keys, "inner"), {"log_id": next_log_id})
    events = log_rows(hit.select(
        "log_id",
        "user_id", F.lit("PUT").alias("action"), "dataset_id",
        F.lit("updateFile").alias("description"),
        S.to_json_object("name", "path", "tags").alias("object_details")), created=now)
    return snapshot, events
