"""Fixity audit of WARC replicas with Merkle trees over ordered offset ranges.

Records stand in files at byte offsets. A replica's tree has the records'
SHA-256 digests as leaves; a node covers a range of offsets and hashes its
children's (start, digest) in order. Ranges are ``LEAF_RANGE`` bytes at the
lowest level and ``FANOUT`` times wider at each level above; the top node covers
a file. Two replicas' roots are compared file by file, and only below a
mismatching node are the next level's nodes compared, down to the records.

Every level is one grouped aggregation by (file, range) of the level below, so a
group holds at most ``FANOUT`` nodes, or the records that start within
``LEAF_RANGE`` bytes. The descent joins by (file, range) and reads mismatching
branches only; nothing is gathered on the driver.

Defined results: null urls and bodies are written as empty; a null id gets a file
by its record's hash; a key that is no number counts as a null id and stands in its
record; rows that repeat an id are records of their own, in the
order of their digests, and stand in one file, which one window group lays out. Records only one replica has are ``missing`` or
``extra``; others are ``ok`` or ``damaged``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakehook.llm.common import materialise, table

FILE_RECORDS = 1024
LEAF_RANGE = 1 << 16
FANOUT = 16
LEVELS = 4


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(id, file, record): each row as a WARC resource record, and the file it stands in."""
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("none"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url).cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))
    return pages.select(F.col(key).try_cast("long").alias("id"), record.alias("record")).select(
        "id", F.coalesce(F.floor(F.col("id") / FILE_RECORDS).cast("long"),
                         -1 - F.pmod(F.xxhash64("record"), F.lit(1 << 20))).alias("file"), "record")


def index(rows: DataFrame, *more: str) -> DataFrame:
    """(file, offset, length, digest, id): where each record stands and its SHA-256;
    and the columns ``more`` of the rows."""
    facts = rows.select("id", "file", F.octet_length("record").cast("long").alias("length"),
                        F.sha2(F.col("record").cast("binary"), 256).alias("digest"), *more)
    before = (Window.partitionBy("file").orderBy(F.col("id").asc_nulls_last(), "digest")
              .rowsBetween(Window.unboundedPreceding, -1))
    return facts.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
                        "length", "digest", "id", *more)


def _width(level: int) -> int:
    return LEAF_RANGE * FANOUT ** level


def tree(records_at: DataFrame) -> list[DataFrame]:
    """Nodes (file, range, digest) of every level, the lowest first, files last."""
    def parents(below: DataFrame, start, group: list) -> DataFrame:
        children = F.sort_array(F.collect_list(F.struct(start.alias("start"), F.col("digest"))))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["start"].cast("string"), c["digest"])), "\n")
        return below.groupBy("file", *group).agg(F.sha2(text.cast("binary"), 256).alias("digest"))

    level = parents(records_at, F.col("offset"), [F.floor(F.col("offset") / _width(0)).alias("range")])
    levels = [level]
    for _ in range(1, LEVELS):
        level = parents(level, F.col("range"), [F.floor(F.col("range") / FANOUT).alias("range")])
        levels.append(level)
    return [*levels, parents(level, F.col("range"), []).withColumn("range", F.lit(0).cast("long"))]


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ, or that one side lacks."""
    both = left.select(*keys, F.col("digest").alias("one")).join(
        right.select(*keys, F.col("digest").alias("two")), keys, "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two")))


def faults(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, one, two): the records of two indexes that differ, found by descent."""
    trees = [[materialise(level, f"warc-{side}-{n}") for n, level in enumerate(tree(at))]
             for side, at in (("one", left), ("two", right))]
    bad = differing(trees[0][-1], trees[1][-1], ["file"]).select("file")
    for n in range(LEVELS - 1, -1, -1):
        # below a file: all its top ranges; below a range: those it covers
        up = ["file"] if n == LEVELS - 1 else ["file", "up"]
        sides = [side[n].withColumn("up", F.floor(F.col("range") / FANOUT)).join(bad, up, "left_semi")
                 for side in (trees[0], trees[1])]
        bad = materialise(differing(sides[0], sides[1], ["file", "range"])
                          .select("file", F.col("range").alias("up")), f"warc-bad-{n}")
    sides = [at.withColumn("up", F.floor(F.col("offset") / _width(0))).join(bad, ["file", "up"], "left_semi")
             for at in (left, right)]
    return differing(sides[0], sides[1], ["file", "offset"])


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per record of either index: id, file, offset, length, digest, status."""
    found = faults(left, right).select("file", "offset", F.when(F.col("two").isNull(), "missing")
                                       .when(F.col("one").isNull(), "extra").otherwise("damaged").alias("status"))
    mine = left.join(found, ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    more = right.join(found.where("status = 'extra'"), ["file", "offset"])
    return mine.unionByName(more).select("id", "file", "offset", "length", "digest", "status")


def worn(rows: DataFrame) -> DataFrame:
    """``rows`` with the length and digest (``worn``) that each record has in a replica
    that has lost every 101st record and the last bytes of every 97th, by id; null is lost."""
    short = F.when(F.col("id") % 97 == 13, F.expr("substring(record, 1, length(record) - 9)")).otherwise(F.col("record"))
    left = F.struct(F.octet_length(short).cast("long").alias("length"), F.sha2(short.cast("binary"), 256).alias("digest"))
    return rows.withColumn("worn", F.when(F.col("id").isNull() | (F.col("id") % 101 != 7), left))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worn(records(table(spark, sf_dir, "pages")))
    both = materialise(index(rows, "worn"), "warc-index")
    # a record of the replica stands where it stands in the first: no join by digest
    second = both.where("worn is not null").select("file", "offset", "worn.length", "worn.digest", "id")
    return audit(both.drop("worn"), second).withColumnRenamed("id", "page_id")


ORACLE = f"""
WITH r AS (
  SELECT page_id, page_id // {FILE_RECORDS} AS file,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:',
           page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
           'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ',
           octet_length(encode(coalesce(html, ''))), chr(13), chr(10), chr(13), chr(10),
           coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages)
SELECT page_id, file,
       CAST(coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       octet_length(encode(record)) AS length, sha256(record) AS digest,
       CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'damaged' ELSE 'ok' END AS status
FROM r
"""
