"""Size-aware Jaccard self-join of documents over word n-gram sets.

A document's words are the runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z
lower-cased; its set holds the distinct n-word shingles (the whole sequence as
one when it has fewer words, nothing without words). Two documents link when
``100 * |A and B| >= threshold * |A or B|``.

Copies. Documents with one word sequence are one vertex (its 64-bit digest), so
copies never meet in an index: a vertex's index entries are merged where they
arrive, and each task sends those of a vertex once.

Heavy and light. Linked sets of sizes m >= n share at least ``need(m, n)``
shingles. *Small* sets, of up to ``b`` shingles, list their subsets of each
fixed size that a link with another small set could demand; small sets with a
common subset are candidates. *Large* sets are found by scanning inverted lists:
a set enters the lists of its ``probe(n)`` first shingles in a global order, and
linked sets meet in at least as many lists as their sizes leave no way around.
The boundary ``b`` is the one with the least estimated cost, from the numbers of
sets of each size and the sum of squared list lengths. The order puts rare
shingles first: exact counts over all documents give the most frequent shingles
(at most ``RANKED``, the bound on what tasks are sent), these go last by count,
all others first by hash. Any order gives the same links; this one keeps shared
passages out of the lists.

Lists of up to ``LONG`` entries give pairs, whose numbers of common lists are
summed; pairs with too few are dropped. Longer lists, as of large groups of near
copies, are cut into blocks of bounded size, and one task compares two blocks:
a group's pairs are compared in memory and never emitted, only the edges of
each task's spanning forest leave it. Every candidate pair is verified on whole
shingle sets. Links become components by star contraction.

Defined results: null, empty and blank texts have an empty set and stand alone.
A null key, or one that several rows share, is kept on its rows; component_id is
the smallest key of the component (null if it has none). An empty table gives an
empty result. No pair is lost to a cap: every limit here only changes where the
same pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import connected_components, materialise, prepare_workers, table

WORDS = 5
THRESHOLD = 75
# Shingles that are ordered by their count: at most so many, each in at least FREQUENT documents.
RANKED = 1 << 20
FREQUENT = 8
# Entries of an inverted list that is compared pair by pair.
LONG = 64
# Documents of long lists that are compared in one task, when their lists share them;
# else the bounds of a block of one list: documents, and shingles of them.
ALONE_DOCS = 4096
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 2_000_000
# Index entries and hashes that one group of tasks merges.
ENTRIES = 2_000_000
# Sizes up to which subsets may be listed; over it they are too many.
MOST_SMALL = 10
SLICE_ROWS = 512
# Candidate ids that are sent to every task instead of shuffling the texts.
IDS_SENT = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEY_BITS = np.uint64(24)  # an index key is the hash's upper 40 bits


def need(m, n, threshold: int = THRESHOLD):
    """Least common shingles of linked sets of m and n shingles."""
    return -(-threshold * (m + n) // (100 + threshold))


def probe(n, threshold: int = THRESHOLD):
    """How many first shingles of a set meet one of any set that it links with."""
    return n + (threshold * n) // -100 + 1


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def vertex_of(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def shingles_of(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[j:j + len(out)]
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Keys and words of slices of (id, text) batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part.column(0), [words_of(t or "") for t in part.column(1).to_pylist()]


def profile(rows: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, digest, vertex, n_shingles) of each of the rows (id, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for ids, words in _texts(batches):
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()),
                pa.array([vertex_of(w) for w in words], pa.int64()),
                pa.array([len(shingles_of(w, n)) for w in words], pa.int64())],
                names=["id", "digest", "vertex", "n_shingles"])

    return rows.mapInArrow(run, f"id {kind}, digest binary, vertex long, n_shingles long")


# --- counts of shingles over all documents ---

def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an index key (40 bits): ranges of keys."""
    return ((keys * np.uint64(buckets)) >> np.uint64(40)).astype(np.int64)


def _split(buckets: int, keys: np.ndarray):
    """Ranges of rising keys by bucket, those with rows."""
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    return [(b, s, e) for b, s, e in zip(range(buckets), edges[:-1].tolist(), edges[1:].tolist()) if s < e]


def frequent_shingles(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """(key, df): in how many documents each key stands, those in FREQUENT at least.

    A task combines its documents' keys before the shuffle: one row of sorted
    keys per bucket and flush, with counts where they exceed one.
    """
    def count(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            out = [(b, keys[s:e], counts[s:e]) for b, s, e in _split(buckets, keys)]
            more = [(k[c > 1], c[c > 1]) for _, k, c in out]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in out], pa.int32()),
                # within a bucket of 40-bit keys the lower 32 bits and the bucket tell them apart
                pa.array([k[c == 1].astype("<u4").tobytes() for _, k, c in out], pa.binary()),
                pa.array([k.astype("<u4").tobytes() for k, _ in more], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, c in more], pa.binary())],
                names=["bucket", "once", "more", "counts"])

        for _, words in _texts(batches):
            for w in words:
                keys = np.unique(shingles_of(w, n) >> _KEY_BITS)
                held.append(keys)
                size += len(keys)
            if size >= ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part["bucket"].iloc[0])
        once = np.frombuffer(b"".join(part["once"]), "<u4")
        keys = np.concatenate([once, np.frombuffer(b"".join(part["more"]), "<u4")])
        weights = np.concatenate([np.ones(len(once), np.int64),
                                  np.frombuffer(b"".join(part["counts"]), "<u4").astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        df = np.add.reduceat(weights[order], starts) if len(keys) else np.empty(0, np.int64)
        often = df >= FREQUENT
        return pd.DataFrame({"bucket": bucket, "low": keys[starts][often].astype(np.int64), "df": df[often]})

    parts = rows.mapInArrow(count, "bucket int, once binary, more binary, counts binary")
    return parts.groupBy("bucket").applyInPandas(merge, "bucket int, low long, df long")


def _ranked(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, at most RANKED: bucket, low bits and count.

    The least count is read off a histogram by powers of 2 ** 0.25, so only
    shingles that are kept come to the driver.
    """
    level = F.floor(F.log2("df") * 4)
    steps = sorted(((r["level"], r["count"]) for r in
                    frequent.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for step, count in steps:
        if total + count > RANKED:
            break
        total, least = total + count, step
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    got = frequent.where(level >= least).toPandas()
    return got["bucket"].to_numpy(np.int64), got["low"].to_numpy(np.int64), got["df"].to_numpy(np.int64)


# --- the boundary between small and large sets ---

def subset_sizes(n: int, small: int, threshold: int = THRESHOLD) -> list[int]:
    """Sizes of the subsets that a small set of n lists: what links with sets of
    1 to ``small`` shingles need in common at least."""
    return sorted({need(m, n, threshold) for m in range(1, small + 1)
                   if need(m, n, threshold) <= min(m, n)})


def subset_count(n: int, small: int, threshold: int = THRESHOLD) -> int:
    from math import comb

    return sum(comb(n, c) for c in subset_sizes(n, small, threshold))


def boundary(sizes: dict[int, int], repeats: float, threshold: int = THRESHOLD) -> int:
    """Largest size of a small set, by least cost.

    ``sizes`` counts the sets of each size up to MOST_SMALL, ``repeats`` is the
    mean length of the list that a shingle stands in. Listing costs an entry for
    each subset; scanning costs, for each probed shingle, its list.
    """
    def cost(b: int) -> float:
        return sum(count * (subset_count(n, b, threshold) if n <= b else probe(n, threshold) * repeats)
                   for n, count in sizes.items())

    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


# --- the index: subsets of small sets, inverted lists of large ones ---

def _entries(hashes: np.ndarray, small: int, rank, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and whether a key is a subset's."""
    n = len(hashes)
    keys, subset = [], []
    if n <= small:
        h = hashes.tolist()
        for c in subset_sizes(n, small, threshold):
            for some in combinations(h, c):
                keys.append(xxhash.xxh3_64_intdigest(np.array([c, *some], np.uint64).tobytes()) >> 24)
        subset = [True] * len(keys)
    if n > small or 100 * n // threshold > small:
        order = np.lexsort((hashes, rank(hashes)))[:probe(n, threshold)]
        found = np.unique(hashes[order] >> _KEY_BITS)
        keys = np.concatenate([np.array(keys, np.uint64), found])
        subset = subset + [False] * len(found)
    return np.array(keys, np.uint64), np.array(subset, bool)


def index(rows: DataFrame, n: int, buckets: int, small: int, ranked, threshold: int) -> DataFrame:
    """Index entries, gathered by bucket and task: (bucket, keys, subset, vertices, sizes)."""
    r_bucket, r_low, r_df = ranked
    code = (r_bucket.astype(np.uint64) << np.uint64(32)) | r_low.astype(np.uint64)
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast((code[order], r_df[order]))

    def run(batches):
        codes, counts = shared.value

        def rank(hashes: np.ndarray) -> np.ndarray:
            if not len(codes):
                return np.zeros(len(hashes), np.int64)
            keys = hashes >> _KEY_BITS
            own = (_bucket(keys, buckets).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            return np.where(codes[at] == own, counts[at], 0)

        seen: set[int] = set()
        held, size = [], 0

        def flush():
            keys = np.concatenate([k for k, _, _, _ in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            subset = np.concatenate([s for _, s, _, _ in held])[order]
            lengths = [len(k) for k, _, _, _ in held]
            vertex = np.repeat(np.array([v for _, _, v, _ in held], np.int64), lengths)[order]
            sizes = np.repeat(np.array([z for _, _, _, z in held], np.int32), lengths)[order]
            out = _split(buckets, keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in out], pa.int32()),
                 *(pa.array([a[s:e].tobytes() for _, s, e in out], pa.binary())
                   for a in (keys.astype("<u4"), subset, vertex, sizes))],
                names=["bucket", "keys", "subset", "vertices", "sizes"])

        for _, words in _texts(batches):
            for w in words:
                vertex = vertex_of(w)
                if not w or vertex in seen:
                    continue
                if len(seen) < ENTRIES:  # copies in one task; others are merged on arrival
                    seen.add(vertex)
                hashes = shingles_of(w, n)
                keys, subset = _entries(hashes, small, rank, threshold)
                held.append((keys, subset, vertex, len(hashes)))
                size += len(keys)
            if size >= ENTRIES // 4:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "bucket int, keys binary, subset binary, vertices binary, sizes binary")


def _lists(part: pd.DataFrame):
    """The lists of one bucket: rising (key, subset, vertex) without repeats, and where lists begin."""
    keys = np.frombuffer(b"".join(part["keys"]), "<u4").astype(np.int64)
    subset = np.frombuffer(b"".join(part["subset"]), bool)
    vertex = np.frombuffer(b"".join(part["vertices"]), np.int64)
    size = np.frombuffer(b"".join(part["sizes"]), np.int32).astype(np.int64)
    lists = keys * 2 + subset
    order = np.lexsort((vertex, lists))
    lists, vertex, size = lists[order], vertex[order], size[order]
    fresh = np.r_[True, (lists[1:] != lists[:-1]) | (vertex[1:] != vertex[:-1])] if len(lists) else np.empty(0, bool)
    lists, vertex, size = lists[fresh], vertex[fresh], size[fresh]
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if len(lists) else np.empty(0, np.int64)
    return lists, vertex, size, starts, np.diff(np.r_[starts, len(lists)])


def _may_link(m: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * np.minimum(m, n) >= threshold * np.maximum(m, n)


def candidates(entries: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs from short lists and members of long ones, in one table.

    Rows with ``b`` are pairs with their common lists in this bucket; rows
    without are members of a long list, with its number.
    """
    columns = ["list", "a", "b", "size_a", "size_b", "common"]
    schema = ", ".join(f"{c} long" for c in columns)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        bucket = int(part["bucket"].iloc[0])
        lists, vertex, size, starts, lengths = _lists(part)
        out = []
        for length in np.unique(lengths[(lengths > 1) & (lengths <= LONG)]).tolist():
            rows = starts[lengths == length][:, None] + np.arange(length)
            i, j = np.triu_indices(length, 1)
            for at in range(0, len(rows), max(1, ENTRIES // len(i))):
                some = rows[at:at + max(1, ENTRIES // len(i))]
                x, y = some[:, i].ravel(), some[:, j].ravel()
                ok = _may_link(size[x], size[y], threshold)
                x, y = x[ok], y[ok]
                weight = np.where(lists[x] & 1, 1 << 40, 1)
                # vertices rise within a list, so a < b
                got = pd.DataFrame({"a": vertex[x], "b": vertex[y], "size_a": size[x],
                                    "size_b": size[y], "common": weight})
                out.append(got.groupby(["a", "b", "size_a", "size_b"], as_index=False)["common"].sum())
        long = np.repeat(lengths > LONG, lengths)
        out.append(pd.DataFrame({"list": (bucket << 33) + lists[long], "a": vertex[long], "size_a": size[long]}))
        # as nullable integers before they are joined: a float would round the ids
        return pd.concat([o.reindex(columns=columns).astype("Int64") for o in out], ignore_index=True)

    found = materialise(entries.groupBy("bucket").applyInPandas(run, schema), "jaccard-candidates")
    bigger = F.greatest("size_a", "size_b")
    beyond = bigger - (bigger + F.floor(F.lit(-threshold) * bigger / 100) + 1)
    pairs = (found.where("b is not null").groupBy("a", "b", "size_a", "size_b")
             .agg(F.sum("common").alias("common"))
             # what lies beyond the prefixes adds at most this much
             .where(F.col("common") + beyond >= F.ceil(
                 F.lit(threshold) * (F.col("size_a") + F.col("size_b")) / (100 + threshold))))
    return pairs.select("a", "b"), found.where("b is null").select("list", F.col("a").alias("vertex"),
                                                                   F.col("size_a").alias("size"))


def block_tasks(members: DataFrame, threshold: int) -> DataFrame:
    """(task, vertex): the documents of long lists that a task compares with each other.

    Lists that share documents take one label, their smallest list's over two
    steps; when the documents of a label fit one block, they are one task. The
    documents of every other long list are compared by themselves: in size
    classes a link apart, hashed into blocks of bounded size, a task for any two
    blocks of one class or of neighbouring classes. Every two members of a list
    of linkable sizes meet in a task.
    """
    lists = members.select("list", "vertex", "size", F.col("list").alias("label"))
    for _ in range(2):
        by_doc = lists.groupBy("vertex").agg(F.min("label").alias("doc_label"))
        by_list = (lists.select("list", "vertex").join(by_doc, "vertex")
                   .groupBy("list").agg(F.min("doc_label").alias("label")))
        lists = members.join(by_list, "list")
    lists = materialise(lists.select("list", "vertex", "size", "label"), "jaccard-lists")
    docs, load = F.count(F.lit(1)).alias("docs"), F.sum("size").alias("load")
    clusters = lists.select("label", "vertex", "size").distinct()
    fit = (clusters.groupBy("label").agg(docs, load)
           .where((F.col("docs") <= ALONE_DOCS) & (F.col("load") <= BLOCK_SHINGLES)).select("label"))
    whole = clusters.join(fit, "label").select(F.xxhash64("label").alias("task"), "vertex")

    wide = (lists.join(fit, "label", "left_anti")
            .withColumn("step", F.floor(F.log("size") / F.log(F.lit(100 / threshold)) + 1e-9)))
    total = wide.groupBy("list", "step").agg(docs, load)
    pieces = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("load") * 2 / BLOCK_SHINGLES))
    placed = (wide.join(total, ["list", "step"])
              .select("list", "step", F.pmod(F.xxhash64("vertex"), pieces).alias("block"), "vertex"))
    blocks = placed.select("list", "step", "block").distinct()
    other = blocks.select("list", F.col("step").alias("step2"), F.col("block").alias("block2"))
    same = (F.col("step2") == F.col("step")) & (F.col("block2") >= F.col("block"))
    pairs = (blocks.join(other, "list").where(same | (F.col("step2") == F.col("step") + 1))
             .withColumn("task", F.xxhash64("list", "step", "block", "step2", "block2")))
    sides = pairs.select("list", "step", "block", "task").union(
        pairs.select("list", "step2", "block2", "task")).distinct()
    return whole.union(placed.join(sides, ["list", "step", "block"]).select("task", "vertex"))


# --- verification ---

def _linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Which of the sets link, as a square of booleans, by products of incidence rows."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[starts, len(flat)])
    shared = np.repeat(counts > 1, counts)
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)[shared]
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 1024
    edges = np.searchsorted(column, np.arange(0, int(counts.size) + width, width))
    for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if s == e:
            break
        live, row = np.unique(owner[s:e], return_inverse=True)
        m = np.zeros((len(live), width), np.float32)
        m[row, column[s:e] - k * width] = 1
        common[np.ix_(live, live)] += m @ m.T
    out = np.zeros(common.shape, bool)
    for r in range(0, len(sets), 256):
        some = common[r:r + 256].astype(np.int64)
        out[r:r + 256] = 100 * some >= threshold * (sizes[r:r + 256, None] + sizes[None, :] - some)
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest, breadth first."""
    fresh = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        queue = [root] if fresh[root] else []
        fresh[root] = False
        while queue:
            x = queue.pop()
            near = np.flatnonzero(linked[x] & fresh).tolist()
            fresh[near] = False
            out += [(x, y) for y in near]
            queue += near
    return out


def links(docs: DataFrame, pairs: DataFrame, tasks: DataFrame, n: int, threshold: int) -> DataFrame:
    """Edges (a, b) between vertices that link: verified pairs, and a spanning
    forest of each block task's links. ``docs`` is (vertex, text), a row a vertex."""
    def verify(batches):
        for batch in batches:
            b, left, right = (batch.column(k).to_pylist() for k in range(1, 4))
            good, last, own = [], None, None
            for s, y, t in zip(left, b, right):
                if y != last:  # the join leaves the rows of one document together
                    last, own = y, shingles_of(words_of(t), n)
                other = shingles_of(words_of(s), n)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(100 * both >= threshold * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = (pairs.join(docs.select(F.col("vertex").alias("a"), F.col("text").alias("left")), "a")
           .join(docs.select(F.col("vertex").alias("b"), F.col("text").alias("right")), "b")
           .select("a", "b", "left", "right").mapInArrow(verify, "a long, b long"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates()
        sets = [shingles_of(words_of(t), n) for t in part["text"]]
        vertex = part["vertex"].to_numpy()
        edges = _forest(_linked(sets, threshold))
        return pd.DataFrame({"a": vertex[[x for x, _ in edges]] if edges else np.empty(0, np.int64),
                             "b": vertex[[y for _, y in edges]] if edges else np.empty(0, np.int64)})

    many = (tasks.join(docs, "vertex").select("task", "vertex", "text")
            .groupBy("task").applyInPandas(compare, "a long, b long"))
    return one.union(many).where("a <> b")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id."""
    spark = docs.sparkSession
    prepare_workers(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    seen = materialise(profile(rows, words), "jaccard-profile")
    copies = materialise(seen.where("n_shingles > 0").groupBy("digest").agg(
        F.first("vertex").alias("vertex"), F.min("id").alias("id"), F.first("n_shingles").alias("n")),
        "jaccard-copies")
    small_sizes = {r["n"]: r["count"] for r in copies.where(F.col("n") <= MOST_SMALL)
                   .groupBy("n").count().collect()}
    total = copies.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(parts, total // ENTRIES + 1), 1 << 20)
    buckets = max(buckets, 256)  # a bucket and 32 bits tell 40-bit keys apart
    frequent = materialise(frequent_shingles(rows, words, buckets), "jaccard-frequent")
    ranked = _ranked(frequent)
    repeats = 1 + float((ranked[2].astype(float) ** 2).sum()) / max(total, 1)
    small = boundary(small_sizes, repeats, threshold)
    entries = index(rows, words, buckets, small, ranked, threshold)
    pairs, members = candidates(entries, threshold)
    pairs = materialise(pairs, "jaccard-pairs")
    tasks = materialise(block_tasks(members, threshold), "jaccard-blocks")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("vertex"))
                         .union(tasks.select("vertex")).distinct(), "jaccard-wanted")
    # one row of each wanted vertex, or of each word sequence under one vertex
    first = (copies.join(wanted, "vertex", "left_semi").select("vertex", "digest"))
    texts = _texts_of(rows, first, words)
    found = links(texts, pairs, tasks, words, threshold)
    groups = connected_components(found, "jaccard")
    labels = (copies.join(groups.withColumnRenamed("id", "vertex"), "vertex", "left")
              .withColumn("component", F.coalesce("component_id", "vertex"))
              .select("digest", "component", "id"))
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    by_text = labels.join(smallest, "component").select("digest", "component_id")
    joined = seen.where("n_shingles > 0").join(by_text, "digest")
    alone = seen.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    return joined.select("id", "n_shingles", "component_id").union(
        alone.select("id", "n_shingles", "component_id")).withColumnRenamed("id", key)


def _texts_of(rows: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """(vertex, text) of the wanted word sequences, once each."""
    def run(batches):
        for _, some in _texts(batches):
            some = [w for w in some if w]
            joined = [b" ".join(w) for w in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(j) for j in joined], pa.binary()),
                pa.array([j.decode() for j in joined], pa.string())], names=["digest", "text"])

    every = rows.mapInArrow(run, "digest binary, text string")
    if first.count() <= IDS_SENT:
        first = F.broadcast(first)  # at most IDS_SENT rows of 24 bytes
    return materialise(every.join(first, "digest").dropDuplicates(["digest"]).select("vertex", "text"),
                       "jaccard-texts")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each group that links, directly or not: the first by
    key, nulls last, then by place. Rows, not keys, are decided on, so null and
    repeated keys change no other row; rows without shingles stay."""
    columns = list(docs.columns)
    # written with their numbers, which a task that runs again must not change
    rows = materialise(docs.select(
        F.struct("*").alias("doc"), F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"),
                                             F.monotonically_increasing_id().alias("row")).alias("place")), "jaccard-rows")
    groups = near_groups(rows.select("place", F.col("doc").getField(text).alias("text")), "place", "text")
    lose = groups.where(F.col("place.row") != F.col("component_id.row")).select("place.row")
    return (rows.join(lose, F.col("place.row") == F.col("row"), "left_anti")
            .select([F.col("doc").getField(c).alias(c) for c in columns]))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
