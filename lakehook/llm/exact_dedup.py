"""Exact deduplication with a heavy-hitter split (native: DataFrame functions only).

A text's digest is the SHA-256 of the text after every run of blanks
(``[\\x20\\x09-\\x0D]+``) became one space. A frequent-items sketch of the
Misra-Gries family finds the digests that may be frequent; an exact, map-side
combined count verifies them. The verified winners are a table of at most
``HOT_DIGESTS`` rows: it is broadcast, and rows of winners are decided or
removed in the scan's own tasks. Every other digest has few rows (under
``rows * 4 / TRACKED``) and goes through one ordinary shuffle.

Defined results: a null text counts as empty, so null and empty texts are one
group. Null ids sort after all others; of rows that repeat id and text, one is
kept. An empty table gives an empty result. Other columns, whatever their
names, are ignored by ``decisions`` and returned untouched by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakehook.llm.common import BLANKS, materialise, table, text_or_empty

# Counters of the sketch, and the bound on the broadcast table of winners.
TRACKED = 65_536
HOT_DIGESTS = 4_096


def digest(text: str = "text"):
    return F.sha2(F.regexp_replace(text_or_empty(text), BLANKS, " ").cast("binary"), 256)


def _first(key: str, row: str):
    """The row of a group that stays: smallest id, nulls last, then scan order."""
    return F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.col(row).alias("row"))


def frequent(digests: DataFrame, column: str) -> DataFrame:
    """Verified heavy hitters of ``column`` with their exact counts, at most HOT_DIGESTS rows."""
    guess = (digests.agg(F.expr(f"approx_top_k({column}, {HOT_DIGESTS}, {TRACKED})").alias("top"))
             .select(F.explode("top").alias("t")).select(F.col("t.item").alias(column)))
    return (digests.select(column).join(F.broadcast(guess), column)
            .groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    # two narrow columns and the row's number: small against the texts, read three times
    digests = materialise(
        docs.select(F.col(key).alias("id"), digest(text).alias("sha"),
                    F.monotonically_increasing_id().alias("row")), "digests")
    hot = frequent(digests, "sha").select("sha")
    hot = (digests.join(F.broadcast(hot), "sha").groupBy("sha")
           .agg(F.min(_first("id", "row")).alias("first"), F.count(F.lit(1)).alias("size")))
    hot = materialise(hot, "hot")  # at most HOT_DIGESTS rows
    common = digests.join(F.broadcast(hot), "sha")
    own = Window.partitionBy("sha")
    rest = (digests.join(F.broadcast(hot.select("sha")), "sha", "left_anti")
            .select("sha", "id", "row",
                    F.min(_first("id", "row")).over(own).alias("first"),
                    F.count(F.lit(1)).over(own).alias("size")))
    return common.select(rest.columns).union(rest).select(
        F.col("id").alias(key), F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; columns as given.

    Copies of winners go in the scan's tasks, before the shuffle; what remains
    is shuffled once by digest.
    """
    columns = list(docs.columns)
    body = docs.select(F.struct("*").alias("doc"), F.col(key).alias("id"), digest(text).alias("sha"))
    digests = body.select("id", "sha")
    hot = frequent(digests, "sha").select("sha")
    hot = materialise(
        digests.join(F.broadcast(hot), "sha").groupBy("sha").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"))).alias("first"))
        .select("sha", F.col("first.id").alias("keep")), "hot")
    left = (body.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sha", "left")
            .where(F.col("hot").isNull() | F.col("id").eqNullSafe(F.col("keep"))))
    first = Window.partitionBy("sha").orderBy(F.col("id").asc_nulls_last())
    return (left.withColumn("n", F.row_number().over(first)).where("n = 1")
            .select([F.col("doc").getField(c).alias(c) for c in columns]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
