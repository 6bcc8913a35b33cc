"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the training texts into shards of about ``SHARD_WORDS``
words (a text is never cut) and stores, for every word of a shard, the ascending
positions at which it stands. Positions count on through a shard, with one
position left free after each text, so a phrase cannot reach into the next text.

``search`` looks phrases up. Their words' counts over the whole corpus come from
the index; each phrase's words are ordered from the rarest. The rarest word alone
decides in which shards a phrase is a candidate, and only the lists of candidates'
words leave the index. In a shard, the lists are moved by the words' offsets in
the phrase and intersected, rarest first, for all candidates at once. A result is
exact: the words at consecutive positions are the phrase. With ``near``, results
are proximity matches instead: places of the rarest word that have every other
word of the phrase within ``near`` words in the same text, in any order.

A shard's work is bounded by its words, so a passage that a third of all texts
share is spread over their shards. The tables of phrases and of their words are
broadcast where they hold at most ``BROADCAST_BYTES``; beyond, both sides are shuffled.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.
Defined results: null and empty texts have no words, match nothing and stay in
the result; repeated rows are texts of their own; null ids stay null. Items
without words have no windows; items with one id are one item; an item with a
null id is looked for and counted, but not listed in ``items``. Empty tables
give empty results or texts without hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import materialise, prepare_workers, table

WINDOW = 10
SHARD_WORDS = 1 << 20
# Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 23
# Candidate places that are intersected at once.
PLACES = 1 << 20
BROADCAST_BYTES = 16 << 20

# Lower case for A-Z, words' bytes as they are, a blank for all others.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# The key of a shard's list of text beginnings; no word is empty.
BEGINNINGS = ""


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in lists for slices of it."""
    raw = text.encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + SLICE_BYTES
        if end < len(raw):  # a slice ends at a blank
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[at:end].split()
        at = end


class _Numbers(dict):
    """Numbers words by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Shard:
    """Words of texts until there are enough for a shard."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids: list[np.ndarray] = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, text: str) -> int:
        self.starts.append(self.size)
        n = 0
        for words in words_of(text):
            self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            n += len(words)
        self.ids.append(np.array([-1]))  # the free position
        self.size += n + 1
        return n

    def postings(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, the end of each one's list, and all lists one after another."""
        ids = np.concatenate(self.ids)
        at = np.sort((ids << 32) | np.arange(len(ids)))[int((ids < 0).sum()):]
        counts = np.bincount(at >> 32, minlength=len(self.numbers))
        words = [BEGINNINGS, *(w.decode() for w in self.numbers)]
        lists = np.concatenate([np.array(self.starts, "<u4"), (at & 0xFFFFFFFF).astype("<u4")])
        return words, np.cumsum([len(self.starts), *counts]), lists


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index: rows of words (shard, word, n, positions as little-endian
    unsigned 32-bit integers) and rows of texts (shard, place in it, id, n words)."""
    prepare_workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    fields = ["shard", "word", "n", "positions", "place", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = counter(TaskContext.get().partitionId() << 32)
        shard, texts, id_type = _Shard(), [], None

        def stored() -> Iterator[pa.RecordBatch]:
            number = next(numbers)
            ids, sizes = zip(*texts)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * n, pa.int64()), pa.nulls(n, pa.string()), pa.array(sizes, pa.int64()),
                pa.nulls(n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(ids, id_type)], names=fields)
            words, ends, lists = shard.postings()
            counts, raw = np.diff(ends, prepend=0), lists.tobytes()
            for at in range(0, len(words), 65_536):
                some = words[at:at + 65_536]
                edges = 4 * np.concatenate([ends[at - 1:at] if at else [0], ends[at:at + len(some)]])
                n = len(some)
                positions = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer((edges - edges[0]).astype("<i4").tobytes()),
                    pa.py_buffer(raw[edges[0]:edges[-1]])])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * n, pa.int64()), pa.array(some, pa.string()), pa.array(counts[at:at + n], pa.int64()),
                    positions, pa.nulls(n, pa.int64()), pa.nulls(n, id_type)], names=fields)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.append((i, shard.add(t.as_py() or "")))
                if shard.size >= shard_words:
                    yield from stored()
                    shard, texts = _Shard(), []
        if texts:
            yield from stored()

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, f"shard long, word string, n long, positions binary, place long, id {kind}"), "positions")


def windows_of(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: words (array) and the items they stand in."""
    prepare_workers(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.decode() for part in words_of(t or "") for w in part]
                number = max(1, len(words) - window + 1) if words else 0
                for at in range(0, number, 65_536):
                    found = [words[k:k + window] for k in range(at, min(at + 65_536, number))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(found), pa.string()), pa.array(found, pa.list_(pa.string()))], names=["item", "words"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, "item string, words array<string>").distinct()
    # an item without an id keeps its windows: the empty string stands for it
    return found.groupBy("words").agg(F.collect_set(F.coalesce("item", F.lit(""))).alias("items"))


def _sent(rows: DataFrame, size: Column) -> DataFrame:
    """A stored table, to be broadcast when the bytes counted in it are few."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def _ordered(index: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases whose words all occur, with (n, offset, word) from the rarest on; and
    the index rows of phrase words, without their positions."""
    words = materialise(phrases.select(F.explode("words").alias("word")).distinct(), "phrase-words")
    held = materialise(index.select("word", "shard", "n").where("word <> ''").join(
        _sent(words, F.octet_length("word") + 16), "word", "left_semi"), "phrase-shards")
    totals = materialise(held.groupBy("word").agg(F.sum("n").alias("total")), "phrase-totals")
    totals = _sent(totals, F.octet_length("word") + 24)
    parts = phrases.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    parts = parts.join(totals, "word").groupBy("phrase", "length").agg(
        F.sort_array(F.collect_list(F.struct("total", "offset", "word"))).alias("rank"))
    return parts.where(F.size("rank") == F.col("length")).select("phrase", "rank"), held


def _intersect(lists: dict[str, np.ndarray], ranks: list, near: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the phrase, positions found) in one shard."""
    names = {w: k for k, w in enumerate(lists)}
    flat = np.concatenate([*lists.values(), np.empty(0, np.int64)])
    every = (np.repeat(np.arange(len(names)), [len(p) for p in lists.values()]) << 32) | flat
    begins = lists[BEGINNINGS]
    open_ = [k for k, rank in enumerate(ranks) if all(w in names for _, _, w in rank)]
    while open_:
        some, places = [], 0
        while open_ and (not some or places < PLACES):
            some.append(open_.pop())
            places += len(lists[ranks[some[-1]][0][2]])
        longest = max(len(ranks[k]) for k in some)
        words = np.array([[names[w] for _, _, w in ranks[k]] + [-1] * (longest - len(ranks[k])) for k in some])
        offsets = np.array([[o for _, o, _ in ranks[k]] + [0] * (longest - len(ranks[k])) for k in some])
        starts = [lists[ranks[k][0][2]] for k in some]
        owner = np.repeat(np.arange(len(some)), [len(s) for s in starts])
        at = np.concatenate(starts)
        if near is None:
            at = at - offsets[owner, 0]
            owner, at = owner[at >= 0], at[at >= 0]
        else:
            text = np.searchsorted(begins, at, "right")
            low = np.maximum(at - near, begins[text - 1])
            high = np.minimum(at + near, np.r_[begins, np.iinfo(np.int64).max][text] - 1)
        for r in range(1, longest):
            word = words[owner, r]
            if near is None:
                wanted = (word << 32) | (at + offsets[owner, r])
                found = every[np.minimum(np.searchsorted(every, wanted), len(every) - 1)] == wanted
                keep = found | (word < 0)
                owner, at = owner[keep], at[keep]
            else:
                first = np.searchsorted(every, (word << 32) | low)
                keep = (first < np.searchsorted(every, (word << 32) | np.minimum(high, (1 << 32) - 1), "right")) | (word < 0)
                owner, at, low, high = owner[keep], at[keep], low[keep], high[keep]
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        edges = np.searchsorted(owner, np.arange(len(some) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield some[k], at[edges[k]:edges[k + 1]]


def search(index: DataFrame, phrases: DataFrame, near: int | None = None) -> DataFrame:
    """Matches of ``phrases`` (phrase, words, items) in an index, one row per text with any:
    shard, place, n_hit (words inside exact matches, or anchors of proximity matches), items
    (distinct, sorted as strings) and matches, an array of (phrase, position in the text)."""
    prepare_workers(index.sparkSession)
    ranked, held = _ordered(index, phrases)
    ranked = materialise(ranked.join(phrases.select("phrase", "items"), "phrase"), "ranked-phrases")
    # a word may stand in every shard and be the rarest of many phrases
    few = _sent(ranked, F.lit(64) + 48 * F.size("rank") + 24 * F.size("items"))
    candidates = few.join(held.select(F.col("word").alias("rarest"), "shard"),
                             F.element_at("rank", 1)["word"] == F.col("rarest")).drop("rarest")
    candidates = materialise(candidates, "candidate-phrases")
    wanted = candidates.select("shard", F.explode(F.concat("rank.word", F.array(F.lit(BEGINNINGS)))).alias("word")).distinct()
    wanted = materialise(wanted, "candidate-words")
    # the phrases' words first, so that other lists are not shuffled where this table is large
    named = materialise(wanted.select("word").distinct(), "candidate-names")
    lists = index.select("shard", "word", "positions").join(_sent(named, F.octet_length("word") + 16), "word", "left_semi")
    lists = lists.join(_sent(wanted, F.octet_length("word") + 24), ["shard", "word"], "left_semi")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {w: np.frombuffer(p, "<u4").astype(np.int64) for w, p in zip(left["word"], left["positions"])}
        ranks = [[(r["total"], r["offset"], r["word"]) for r in rank] for rank in right["rank"]]
        begins = found[BEGINNINGS] if len(left) else np.empty(0, np.int64)
        hits = list(_intersect(found, ranks, near)) if ranks else []
        if not hits:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("shard", "place", "n_hit", "items", "matches")})
        which = np.repeat([k for k, _ in hits], [len(at) for _, at in hits])
        at = np.concatenate([a for _, a in hits])
        text = np.searchsorted(begins, at, "right") - 1
        order = np.lexsort((at, text))
        which, at, text = which[order], at[order], text[order]
        phrase, items = right["phrase"].to_numpy(), [set(i) for i in right["items"]]
        size = np.array([len(r) if near is None else 1 for r in ranks])[which]
        rows, edges = [], np.r_[np.flatnonzero(np.r_[True, np.diff(text) > 0]), len(text)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            # words inside any match: what each adds beyond the furthest end before it
            ends = np.maximum.accumulate(at[low:high] + size[low:high])
            covered = ends - np.maximum(at[low:high], np.r_[0, ends[:-1]])
            begin = int(begins[text[low]])
            rows.append((int(text[low]), int(np.maximum(covered, 0).sum()),
                         sorted(set().union(*(items[k] for k in np.unique(which[low:high]).tolist()))),
                         [(int(p), int(x) - begin) for p, x in zip(phrase[which[low:high]], at[low:high])]))
        out = pd.DataFrame(rows, columns=["place", "n_hit", "items", "matches"])
        out.insert(0, "shard", right["shard"].iloc[0])
        return out

    return lists.groupBy("shard").cogroup(candidates.groupBy("shard")).applyInPandas(
        match, "shard long, place long, n_hit long, items array<string>, matches array<struct<phrase: long, position: long>>")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per text: key, n_words, n_hit, items, matches."""
    phrases = materialise(windows_of(items, item_key, item_text, window).withColumn(
        "phrase", F.monotonically_increasing_id()), "windows")
    index = build_index(docs, key, text, shard_words)
    found = search(index, phrases)
    texts = index.where("word is null").select("shard", "place", "id", F.col("n").alias("n_words"))
    none = F.array().cast("array<string>")
    return texts.join(found, ["shard", "place"], "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"), "matches")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_remove("items", ""), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH fold AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
windows AS (
  SELECT DISTINCT id AS item_id, words[k:k + 9] AS gram
  FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM fold WHERE kind = 'i' AND len(words) > 0)),
lengths AS (SELECT DISTINCT len(gram) AS n FROM windows),
grams AS (
  SELECT r, k, n, words[k:k + n - 1] AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM fold, lengths WHERE kind = 'd' AND len(words) >= n)),
hits AS (SELECT r, k, n, item_id FROM grams JOIN windows USING (gram)),
covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN covered USING (r) LEFT JOIN named USING (r) WHERE kind = 'd'
"""
