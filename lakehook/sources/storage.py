"""File work inside tasks: headers, copies, moves and empty Parquet files.

Spark's writers make a file where there are rows; what is left to do for whole
files (copying a Parquet file as it is, replacing an output by an empty one,
bringing written directories to their place) is dealt out here as one Spark job
over a table of paths. Tasks open the storage through pyarrow's file systems
(local paths, ``hdfs``, ``viewfs``, ``s3``, ``gs``, ``abfs``). All functions may run
twice for one path, as retried tasks do.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakehook.session import ship_package

_LOCATION = re.compile(r"(?P<store>[A-Za-z][\w+.-]*://[^/]*)(?P<path>/.*)")


def open_store(path: str):
    """(file system, path within it); percent signs of a path are taken as they are."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if not (m := _LOCATION.fullmatch(path)):
        return fs.LocalFileSystem(), path
    store, base = fs.FileSystem.from_uri(m["store"] + "/")
    return store, base.rstrip("/") + m["path"]


def data_files(store, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a lake file: itself, or the part files of its directory in order."""
    from pyarrow import fs

    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    below = len(path.rstrip("/")) + 1
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size
                  and not any(p[:1] in "._" and "=" not in p for p in f.path[below:].split("/")))


def for_each(rows: DataFrame, action: Callable[[dict], dict], schema: str) -> DataFrame:
    """``action`` on every row of a stored table; lazy: the caller stores or writes the result.

    Rows are few bytes and much work, so they are dealt out by their number, a few to
    a task, and not by their size.
    """
    ship_package()
    slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(1, min(rows.count(), slots)))
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [action(r) for r in frame.to_dict("records")]
            yield pd.DataFrame({n: pd.Series([d[n] for d in done], dtype=object) for n in names})

    return rows.mapInPandas(run, schema)


def named(header: list[str]) -> list[str]:
    """A header's names as Spark reads them: unnamed and repeated columns get their number."""
    low = [c.lower() for c in header]
    return [f"_c{k}" if not c else f"{c}{k}" if low.count(c.lower()) > 1 else c for k, c in enumerate(header)]


def first_line(row: dict) -> dict:
    """The columns of a CSV file with a header row; none for a file without a line."""
    store, path = open_store(row["landing_path"])
    for file, _ in data_files(store, path):
        with store.open_input_stream(file) as stream:
            head = b""
            while b"\n" not in head and (more := stream.read(1 << 16)):
                head += more
        line = head.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
        return {**row, "header": named(next(csv.reader([line]), []))}
    return {**row, "header": []}


def copy_file(row: dict) -> dict:
    """Copy the lake file ``landing_path`` as it is to the directory ``path``, replacing that."""
    from pyarrow import fs

    source, path = open_store(row["landing_path"])
    target, place = open_store(row["path"])
    files = data_files(source, path)
    replace(target, place)
    target.create_dir(place, recursive=True)
    for k, (file, _) in enumerate(files):
        fs.copy_files(file, f"{place}/part-{k:05d}.parquet", source_filesystem=source, destination_filesystem=target)
    return {**row, "size_bytes": sum(size for _, size in files)}


def move_directory(row: dict) -> dict:
    """Bring the directory ``staged`` to ``path``, replacing that; done if it is gone already."""
    from pyarrow import fs

    store, staged = open_store(row["staged"])
    _, place = open_store(row["path"])
    if store.get_file_info(staged).type != fs.FileType.NotFound:
        replace(store, place)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        store.move(staged, place)
    return {**row, "size_bytes": sum(size for _, size in data_files(store, place))}


def replace(store, place: str) -> None:
    """Remove the file or directory at ``place``, if there is one."""
    from pyarrow import fs

    kind = store.get_file_info(place).type
    if kind == fs.FileType.Directory:
        store.delete_dir(place)
    elif kind == fs.FileType.File:
        store.delete_file(place)


def write_empty(places: DataFrame, schema: T.StructType) -> None:
    """An empty Parquet file of ``schema`` as the only content of each directory ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def write(row: dict) -> dict:
        import pyarrow.parquet as pq

        store, place = open_store(row["path"])
        replace(store, place)
        store.create_dir(place, recursive=True)
        pq.write_table(arrow.empty_table(), f"{place}/part-00000.parquet", filesystem=store)
        return row

    for_each(places.select("path"), write, "path string").write.format("noop").mode("overwrite").save()
