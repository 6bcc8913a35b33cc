"""Session construction and shared-storage scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every lakehook job relies on. AQE re-plans joins from runtime sizes
# (sort-merge -> broadcast when a side turns out small, skewed partitions are
# split), and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed work items of finished batches are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# A task of a SQL script reads about so many bytes of a shuffle. Each of its sorts and
# windows holds several times as many, and they add up. Beyond MAX_TASKS, which the
# driver keeps track of one by one, tasks become larger.
TASK_BYTES = 16 << 20
MAX_TASKS = 100_000


def build_session(
    master: str | None = None,
    app_name: str = "lakehook",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with lakehook's defaults.

    On a cluster ``master`` stays None so spark-submit decides; tests and the
    bench pass ``local[N]``.
    """
    # pandas-on-Spark wants this set before the JVM starts, on both sides.
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or a directory already set
    with ``setCheckpointDir``). When neither is set, a local run gets a private
    temporary directory; on a cluster that is refused, since every node would
    have its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lakehook-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique directory name under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    leaf = "-".join(p for p in parts if p) or "scratch"
    path = f"{root}/lakehook/{leaf}-{uuid.uuid4().hex[:12]}"
    if scopes := _OPEN.get(threading.get_ident()):
        scopes[-1].append(path)
    return path


# Open scopes by thread: plain data, as functions of this package travel by value.
_OPEN: dict[int, list[list[str]]] = {}


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that this thread takes inside are removed at the end.

    For code that has written its result somewhere else by then; a DataFrame that
    still reads a scratch table must not leave the block.
    """
    me = threading.get_ident()
    scopes = _OPEN.setdefault(me, [])
    scopes.append([])
    try:
        yield
    finally:
        made = scopes.pop()
        if not scopes:
            del _OPEN[me]
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the lake or of the scratch space, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch space and read back: what made it runs once,
    its size is known to the planner, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_tasks(df: DataFrame) -> None:
    """Have the shuffles of ``df``'s session dealt out by the bytes of ``df``'s sources.

    A shuffle gets a partition for each ``TASK_BYTES`` of them, and adaptive execution
    joins small partitions up to that size only, so that a task's memory stays as it is
    while the input grows. Settings that make smaller tasks stay; sources that the
    planner knows no size of count as none.
    """
    session = df.sparkSession
    unknown = session._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    parts = min(MAX_TASKS, -(-sum(s for s in sizes if s < unknown) // TASK_BYTES))
    if parts > int(session.conf.get("spark.sql.shuffle.partitions")):
        session.conf.set("spark.sql.shuffle.partitions", str(parts))
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    in_bytes = session._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(session.conf.get(advisory)) > TASK_BYTES:
        session.conf.set(advisory, str(TASK_BYTES))


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """End the Spark jobs that this thread runs inside after ``seconds``.

    The jobs carry a tag, and a watcher cancels what has the tag from the deadline
    on, jobs begun later too. The block then raises TimeoutError.
    """
    if seconds is None:
        yield
        return
    sc, tag = spark.sparkContext, f"lakehook-{uuid.uuid4().hex}"
    over, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while True:
                sc.cancelJobsWithTag(tag)
                if over.wait(0.2):
                    return

    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"ended after {seconds:g} s") from error
        raise
    finally:
        over.set()
        watcher.join()
        sc.removeJobTag(tag)
    if late.is_set():
        raise TimeoutError(f"ended after {seconds:g} s")


def ship_package() -> None:
    """Make lakehook functions travel to Python workers by value.

    Grouped pandas functions defined in this package are pickled with the
    task, so executors need no installed copy of it (on a cluster, shipping
    a zip with ``--py-files`` works as well).
    """
    from pyspark import cloudpickle

    import lakehook

    cloudpickle.register_pickle_by_value(lakehook)
