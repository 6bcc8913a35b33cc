"""Registrations as numbered snapshots that a running dispatcher picks up.

A snapshot is written whole under ``version=<n>``; a row of ``published`` then makes
it the current one, so a reader never sees half a snapshot. A dispatcher asks for the
current version at each batch; the ranked table that the match joins is built once
per version, and removed when the next one takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.operators.match import dispatchable, first_registration_per_key
from lakehook.session import remove, scratch_path


class RegistrationStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._version: int | None = None
        self._ranked: str | None = None

    def publish(self, transforms: DataFrame) -> int:
        """Make ``transforms`` the current snapshot; one publisher at a time."""
        version = (self.current() or 0) + 1
        transforms.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return version

    def current(self) -> int | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("version long").parquet(f"{self.path}/published").agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The registrations of a version, by default the current one."""
        version = version or self.current()
        if version is None:
            raise ValueError(f"no registrations were published under {self.path}")
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def ranked(self) -> DataFrame:
        """The current version's ranked registrations (see ``match_triggers``)."""
        version = self.current()
        if version != self._version or self._ranked is None:
            before = self._ranked
            path = scratch_path(self.spark, "ranked")
            dispatchable(first_registration_per_key(self.read(version))).write.parquet(path)
            self._version, self._ranked = version, path
            if before:
                remove(self.spark, before)
        return self.spark.read.parquet(self._ranked)

    def close(self) -> None:
        """Remove the ranked table."""
        if self._ranked:
            remove(self.spark, self._ranked)
        self._version = self._ranked = None
