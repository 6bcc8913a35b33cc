"""What the training-data operators share: table reading, scratch tables, components."""

from __future__ import annotations

import os
import site
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lakehook
from lakehook.session import scratch_path

# Fixed value: the white space of the contracts, [\x20\x09-\x0D].
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage with a table that every executor can read again, so a lost
    executor costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package: as installed there, else shipped
    once per application as a zip, as ``--py-files`` would do. Imported by
    reference, a module's caches outlive a task in its worker."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(lakehook.__file__)))
    seen = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if sc.master.split("[")[0] == "local":
        seen.append(os.getcwd())
    if (root.endswith(".zip") or sc.getConf().get("spark.submit.pyFiles", "") or sc.applicationId in _SHIPPED
            or os.path.realpath(root) in {os.path.realpath(p) for p in seen if p}):
        return
    _SHIPPED.add(sc.applicationId)
    # on the driver alone: Spark hands the file out to the executors
    name = os.path.join(tempfile.mkdtemp(prefix="lakehook-ship-"), "lakehook.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "lakehook")):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(name)


_SHIPPED: set[str] = set()


class Remembered(dict):
    """A bounded memory of two generations: when the newer one is full, the older
    one is forgotten, and what is used again moves on."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def unknown(self, keys) -> list:
        """Those of ``keys`` that are new; all others are in the newer generation then."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = []
        for key in keys:
            if key not in self:
                if key in self.old:
                    self[key] = self.old[key]
                else:
                    out.append(key)
        return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, name: str, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges(a, b)``.

    Alternates the large-star and small-star steps: every round is two grouped
    passes over the edges with a map-side ``min``, the number of edges never
    grows, and the rounds needed grow with the logarithm of the longest chain.
    Returns ``(id, component_id)`` for the vertices of the edges only. No edge
    or label is gathered on the driver; each round's edges are a written table.
    """
    cur = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct(), f"{name}-edges")
    for step in range(max_rounds):
        # large star: neighbours above a vertex hang on its smallest neighbour
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a vertex and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        nxt = materialise(small, f"{name}-round{step}")
        # finished when every vertex hangs on one root and no root hangs on anything
        roots = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = roots.where("n > 1").select("u").union(
            nxt.select("v").distinct().join(roots, F.col("v") == F.col("u"), "left_semi"))
        cur = nxt
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"components of {name} did not settle in {max_rounds} rounds")
    return (cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
            .union(cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()))
