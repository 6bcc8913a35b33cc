"""A trie of conversation prefixes with totals rolled up by depth bands.

A node is a distinct sequence of first turns (role, text); conversations that
start with it are its members. Turns travel as 128-bit digests, and a node's key
is a chained digest of its turns.

No group is unbounded. Turns get their place in a conversation from a range sort
and counts per sorted partition, so one conversation may span many partitions.
The chain is folded in bands of ``BAND`` depths; bands of longer conversations
are folded again, as if each band were a turn. Likewise the totals of subtrees:

1. every node explodes its own values to its ancestors within its band, itself
   included: at most ``BAND`` rows, summed map-side;
2. band roots with these sums are the nodes of a smaller trie, ``BAND`` times
   lower, which is rolled up by the same two steps;
3. the completed total of each band root goes to the ancestors in the band above.

So a trie of depth d takes 2 * log(d) / log(BAND) rounds, and a node explodes to
2 * BAND rows at most.

Defined results: turns are ordered by (turn, nulls first), equal turns by the
digest of role and text, so repeated rows are turns of their own. Null role or
text counts as empty. Rows without a conversation id belong to none and are left
out. A table without conversations has no nodes. Columns other than the four
named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakehook.llm.common import materialise, prepare_workers, table, text_or_empty

BAND = 16
# Conversation ids whose decimal digits are joined into one row before hashing.
CHUNK = 4_096
# The conversation that lends its first turns, and how many it may lend.
FAMILY = 20
SHARED = 4
WORD = r"[^\x20\x09-\x0D]+"


def _root() -> Column:
    """The key of the node without turns."""
    return F.unhex(F.lit("00" * 16))


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _step(before: Column, turn: Column) -> Column:
    return _digest(F.concat(before, turn))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, words) of every turn with a conversation id."""
    role, text = text_or_empty("role"), text_or_empty("text")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        _digest(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place from 0, digest, words) and (conv, size), without a task per conversation."""
    turns = materialise(turns, "trie-turns")
    order = ("conv", F.col("turn").asc_nulls_first(), "digest")
    split = materialise(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv", "digest", "words", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at")), "trie-sorted")
    # one row for each conversation in each sorted partition
    parts = split.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    rows = split.join(parts.select("conv", "part", "first", "before"), ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "digest", "words")
    return rows, parts.groupBy("conv").agg(F.sum("rows").alias("size"))


def rebuilt(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos from 1, digest, words) of rebuilt conversations, and all their ids.

    The first turns come from the family's first conversation, the others are own.
    """
    shares = sizes.select("conv", "size", (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
                          (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).alias("shared"))
    lenders = sizes.select(F.col("conv").alias("base"), F.col("size").alias("lender_size"))
    shares = materialise(shares.join(lenders, "base", "left").select(
        "conv", "base", "shared", F.least("shared", F.coalesce("lender_size", F.lit(0))).alias("taken")), "trie-shares")
    # at most SHARED - 1 turns and FAMILY conversations meet at a lender
    lent = rows.where(F.col("place") < SHARED - 1).withColumnRenamed("conv", "base").join(
        shares.select("conv", "base", "shared"), "base").where("place < shared").select(
        "conv", (F.col("place") + 1).alias("pos"), "digest", "words")
    own = rows.join(shares.select("conv", "shared", "taken"), "conv").where("place >= shared").select(
        "conv", (F.col("place") - F.col("shared") + F.col("taken") + 1).alias("pos"), "digest", "words")
    return lent.union(own), shares.select("conv")


def _depth(rows: DataFrame) -> int:
    return rows.agg(F.max("pos")).first()[0] or 0


def chained(rows: DataFrame, deepest: int, band: int) -> DataFrame:
    """``rows`` (conv, pos, digest, words) with the key of the prefix that ends there."""
    bands = rows.groupBy("conv", F.floor(F.col("pos") / band).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    inside = F.aggregate("turns", F.array(F.unhex(F.lit(""))), lambda done, turn: F.concat(
        done, F.array(_step(F.element_at(done, -1), turn["digest"]))))
    bands = bands.withColumn("inside", inside)
    if deepest >= band:
        bands = materialise(bands, "trie-bands")
        # each band that another may follow as a turn of a shorter conversation
        upper = bands.where(F.col("band") < deepest // band).select("conv", (F.col("band") + 1).alias("pos"), F.element_at("inside", -1).alias("digest"),
                             F.lit(0).cast("long").alias("words"))
        upper = chained(upper, deepest // band, band).select("conv", F.col("pos").alias("band"), F.col("key").alias("above"))
        bands = bands.join(upper, ["conv", "band"], "left")
    else:
        bands = bands.withColumn("above", F.lit(None).cast("binary"))
    turn = F.posexplode("turns").alias("k", "turn")
    return (bands.select("conv", "inside", F.coalesce("above", _root()).alias("above"), turn)
            .select("conv", "turn.*", _step(F.col("above"), F.element_at("inside", F.col("k") + 2)).alias("key"))
            .drop("digest"))


def nodes_of(chain: DataFrame, deepest: int, band: int) -> DataFrame:
    """Nodes below the root: key, pos, parent, path (keys of its band down to itself),
    conv_id and n_convs, from (conv, pos, key, words)."""
    bands = chain.groupBy("conv", F.floor(F.col("pos") / band).alias("band")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("turns"))
    if deepest >= band:
        last = bands.select("conv", (F.col("band") + 1).alias("band"), F.element_at("turns", -1)["key"].alias("above"))
        bands = bands.join(last, ["conv", "band"], "left")
    else:
        bands = bands.withColumn("above", F.lit(None).cast("binary"))
    # the root is the first of its band
    first = F.col("band") == 0
    path = F.when(first, F.concat(F.array(_root()), F.col("turns.key"))).otherwise(F.col("turns.key"))
    rows = bands.select("conv", path.alias("path"), first.cast("int").alias("lead"), "above",
                        F.posexplode("turns").alias("k", "turn")).select(
        "conv", "turn.*", F.slice("path", F.lit(1), F.col("k") + 1 + F.col("lead")).alias("path"), "above")
    return rows.groupBy("key").agg(
        F.first("pos").alias("pos"), F.first("path").alias("path"), F.first("words").alias("words"),
        F.first("above").alias("above"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    ).withColumn("parent", F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))).otherwise(F.col("above"))).drop("above")


def rolled_up(nodes: DataFrame, chain: DataFrame, deepest: int, band: int, values: list[str], level: int = 0) -> DataFrame:
    """(key, *values): each node's values summed over its subtree, itself included.

    ``nodes`` has key, pos, parent, path and values, the root among them; ``chain``
    has (conv, pos, key) of all turns.
    """
    sums = [F.sum(v).alias(v) for v in values]
    inside = nodes.select(F.explode("path").alias("key"), *values).groupBy("key").agg(*sums)
    if deepest < band:
        return inside
    inside = materialise(inside, f"trie-inside{level}")
    roots = nodes.where(F.col("pos") % band == 0).select("key", "pos", "parent").join(inside, "key")
    higher = materialise(chain.where(F.col("pos") % band == 0).select(
        "conv", F.floor(F.col("pos") / band).alias("pos"), "key", F.lit(0).cast("long").alias("words")), f"trie-chain{level}")
    ways = nodes_of(higher, deepest // band, band).select("key", "path", F.col("parent").alias("upper"))
    upper = (roots.join(ways, "key", "left").select(
        "key", F.floor(F.col("pos") / band).alias("pos"), F.col("upper").alias("parent"),
        F.coalesce("path", F.array(_root())).alias("path"), *values))
    totals = rolled_up(materialise(upper, f"trie-roots{level}"), higher, deepest // band, band, values, level + 1)
    # completed totals go on to the band above, through the parents of band roots
    passed = (roots.where("pos > 0").select("key", "parent").join(totals, "key")
              .groupBy(F.col("parent").alias("key")).agg(*sums))
    across = passed.join(nodes.select("key", "path"), "key").select(F.explode("path").alias("key"), *values)
    return inside.union(across).groupBy("key").agg(*sums)


def digest_of_ids(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) over (key, conv): ids in ascending order, comma-joined.

    Ranges of (key, id) are joined to rows of up to ``CHUNK`` ids; a hash takes its
    rows one after another, so no list stands in memory.
    """
    prepare_workers(rows.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()),
                 pa.array([",".join(map(str, ids))], pa.string())], names=["key", "first", "ids"])

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) >= CHUNK):
                    yield row()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, sums = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    sums.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    chunks = rows.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        join, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(
        hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node; see the module's docstring."""
    turns, ids = rebuilt(*placed(turns_of(conversations)))
    turns = materialise(turns, "trie-rebuilt")
    deepest = _depth(turns)
    chain = materialise(chained(turns, deepest, band), "trie-chain")
    everyone = ids.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = everyone.where("n_convs > 0").select(
        _root().alias("key"), F.lit(0).cast("long").alias("pos"), F.array(_root()).alias("path"),
        F.lit(0).cast("long").alias("words"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"))
    nodes = nodes_of(chain, deepest, band)
    nodes = materialise(nodes.select(root.columns).union(root), "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialise(nodes.withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "trie-valued")
    values = ["n_leaves", "saved_tokens"]
    totals = rolled_up(nodes, chain, deepest, band, values)
    # most nodes hang on few parents near the root: its children need no join
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("pos > 1").join(parents, "parent")
    smallest = everyone.first()["conv_id"]
    top = nodes.where("pos = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    start = nodes.where("pos = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    nodes = below.select(start.columns).union(top.select(start.columns)).union(start)
    last = chain.groupBy("conv").agg(F.max(F.struct("pos", "key"))["key"].alias("key"))
    ends = ids.join(last, "conv", "left").select(F.coalesce("key", _root()).alias("key"), "conv")
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.drop(*values).join(totals, "key").join(digest_of_ids(ends), "key", "left")
            .select("conv_id", F.col("pos").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    *values, F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


# The checksum of a conversation's decimal digits, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, byte: list_reduce([xor(s, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

ORACLE = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
r AS (
  SELECT conv_id, row_number() OVER w AS depth,
         list(sha256(length(role) || ':' || role || text)) OVER w AS node,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
p AS (SELECT conv_id, depth, node, words FROM r UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM c),
ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY conv_id) GROUP BY node),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words
      FROM p GROUP BY node, depth),
kids AS (SELECT node[:-2] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
up AS (
  SELECT node[:k] AS node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, parent.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN up USING (node) LEFT JOIN ends USING (node)
LEFT JOIN n AS parent ON v.depth > 0 AND parent.node = v.node[:-2]
"""
