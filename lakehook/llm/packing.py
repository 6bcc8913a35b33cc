"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents stand in the order of (key, digest of the text); their ids, each
document closed by the id ``END``, are one stream. The stream is cut into
windows of at most ``WINDOW`` ids, and every window is a sequence. A sequence is
padded to ``WINDOW``, except when its length is a power of two.

A cut costs nothing at a document's end, ``CUT_SENTENCE`` at a sentence's end
and ``CUT_INSIDE`` elsewhere; a padded id costs 1 and a sequence ``OPEN``. For
cut positions ``j`` the least cost is

    f(j) = cut(j) + min over i of f(i) + OPEN + pad(j - i)

and, with one cut inside after a full window, the same over ``j - i - WINDOW``.
As ``pad`` is linear but for the powers of two, the minimum of ``f(i) + i`` over
a sliding range of positions is kept in a monotone queue, one for each of the
two ranges; the few positions at a power of two are looked up. Stretches without
a sentence end get positions every ``STRIDE`` ids.

Spark deals the documents out by ranges of (key, digest), so that rows with one
key, or none, can be split too, and sorts within each range. A task solves its
range in blocks of ``BLOCK`` ids and carries the last windows of a block on into
the next, so memory is bounded and only a range's last sequence can be short;
there the rest is split at powers of two when that costs less than padding.

Defined results: null and empty texts are the id ``END`` alone; null keys sort
first; repeated rows are packed each; an empty table gives no pieces; a text of
any length is cut as often as needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import prepare_workers, table
from lakehook.llm.byte_tokens import coder

WINDOW = 1024
END = 0
CUT_SENTENCE = 1
CUT_INSIDE = 8
OPEN = 4
STRIDE = 64
BLOCK = 1 << 18
# Ids at the end of a block whose windows are settled with the next block.
TAIL = 8 * WINDOW
SLICE_ROWS = 1024


def padding(length: int) -> int:
    """Ids that a sequence of ``length`` ids is padded with."""
    return 0 if length & (length - 1) == 0 else WINDOW - length


def split_cost(length: int) -> int:
    """Cost of ``length`` ids cut at powers of two, largest first."""
    parts = length.bit_count()
    return parts * OPEN + (parts - 1) * CUT_INSIDE


def _merged(*rising: np.ndarray) -> np.ndarray:
    every = np.sort(np.concatenate(rising), kind="stable")
    return every[np.diff(every, prepend=-1) > 0]


def positions(ends: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions after 0 and their costs, from sentence and document ends."""
    stops = _merged(ends, doc_ends)
    gaps = np.diff(stops, prepend=0)
    wide = np.flatnonzero(gaps > STRIDE)
    extra = [np.arange(stops[k] - gaps[k] + STRIDE, stops[k], STRIDE) for k in wide.tolist()]
    every = _merged(stops, *extra)
    cost = np.full(len(every), CUT_INSIDE)
    cost[np.searchsorted(every, ends)] = CUT_SENTENCE
    cost[np.searchsorted(every, doc_ends)] = 0
    return every, cost


def plan(stops: np.ndarray, costs: np.ndarray, final: bool = True) -> tuple[list[int], int]:
    """Cuts of least cost up to the last stop, and that cost.

    With ``final``, the last window may also be split at powers of two.
    """
    pos = [0, *stops.tolist()]
    cost = [0, *costs.tolist()]
    n = len(pos)
    at = np.array(pos)
    powers: list[tuple[int, int]] = []
    for e in range(WINDOW.bit_length()):
        i = np.searchsorted(at, at - (1 << e))
        hit = at[np.minimum(i, n - 1)] == at - (1 << e)
        powers += zip(np.flatnonzero(hit).tolist(), i[hit].tolist())
    powers.sort()
    powers.append((n, 0))
    best, back, kind = [0] * n, [0] * n, [0] * n
    # i with f(i) + i rising: near for j - i in 1..WINDOW, far in WINDOW+1..2*WINDOW
    near, far = [0], []
    near_head = far_head = 0
    key = [0] * n
    passed, p, next_power = 0, 0, powers[0][0]
    far_cost = WINDOW + OPEN + CUT_INSIDE
    for j in range(1, n):
        x = pos[j]
        while near_head < len(near) and pos[near[near_head]] < x - WINDOW:
            near_head += 1
        while pos[passed] < x - WINDOW:
            v = key[passed]
            while len(far) > far_head and key[far[-1]] >= v:
                far.pop()
            far.append(passed)
            passed += 1
        while far_head < len(far) and pos[far[far_head]] < x - 2 * WINDOW:
            far_head += 1
        least, i, how = None, 0, 0
        if near_head < len(near):
            i = near[near_head]
            least = key[i]
        if far_head < len(far):
            v = key[far[far_head]] + far_cost
            if least is None or v < least:
                least, i, how = v, far[far_head], 1
        least += WINDOW - x + OPEN
        while next_power == j:
            v = best[powers[p][1]] + OPEN
            if v < least:
                least, i, how = v, powers[p][1], 0
            p += 1
            next_power = powers[p][0]
        if final and j == n - 1:
            for k in range(j - 1, -1, -1):
                if x - pos[k] > WINDOW:
                    break
                v = best[k] + split_cost(x - pos[k])
                if v < least:
                    least, i, how = v, k, 2
        back[j], kind[j] = i, how
        best[j] = least = least + cost[j]
        key[j] = least = least + x
        while len(near) > near_head and key[near[-1]] >= least:
            near.pop()
        near.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        i = back[j]
        if kind[j] == 1:
            cuts.append(pos[i] + WINDOW)
        elif kind[j] == 2:
            left, parts = pos[j] - pos[i], []
            while left:
                parts.append(1 << (left.bit_length() - 1))
                left -= parts[-1]
            edge = pos[i]
            ends = []
            for part in parts[:-1]:
                edge += part
                ends.append(edge)
            cuts += ends[::-1]
        j = i
    return cuts[::-1], best[n - 1]


class Packer:
    """Packs a stream of documents; ``feed`` and ``finish`` give pieces."""

    def __init__(self, first_sequence: int = 0):
        self.sequence = first_sequence
        self.ids = b""                       # of the windows not settled yet
        self.fresh: list[bytes] = []
        self.size = 0
        self.docs: list[tuple] = []          # key, ids of the document, where it begins here
        self.sentences: list[np.ndarray] = []
        self.doc_ends: list[int] = []

    def feed(self, key, ids: bytes, sentence_ends: np.ndarray) -> Iterator[tuple]:
        ids += int(END).to_bytes(4, "little")
        n = len(ids) // 4
        self.docs.append((key, n, self.size))
        self.sentences.append(sentence_ends + self.size)
        self.fresh.append(ids)
        self.size += n
        self.doc_ends.append(self.size)
        if self.size >= BLOCK:
            yield from self._settle(final=False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._settle(final=True)

    def _settle(self, final: bool) -> Iterator[tuple]:
        ids = b"".join([self.ids, *self.fresh])
        sentences = np.concatenate(self.sentences)
        cuts, _ = plan(*positions(sentences, np.array(self.doc_ends)), final)
        if not final:
            cuts = [c for c in cuts if c <= self.size - TAIL]
        at, d = 0, 0
        for cut in cuts:
            begin = at
            while at < cut:
                key, n, where = self.docs[d]
                end = min(cut, where + n)
                part = ids[4 * at:4 * end]
                yield key, at - where, end - at, zlib.crc32(part), n, self.sequence, at - begin, part
                at = end
                if at == where + n:
                    d += 1
            self.sequence += 1
        # the rest is seen from the last cut on; a document cut there begins before it
        self.ids, self.fresh = ids[4 * at:], []
        self.docs = [(key, n, where - at) for key, n, where in self.docs[d:]]
        self.sentences = [sentences[sentences > at] - at]
        self.doc_ends = [e - at for e in self.doc_ends if e > at]
        self.size -= at


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text",
         tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``keep_ids``, its ids."""
    prepare_workers(docs.sparkSession)
    path = tokenizer or default_path()
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"id {kind}, " + ", ".join(f"`{n}` long" for n in names[1:])
    if keep_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        packer = Packer(TaskContext.get().partitionId() << 32)
        key_type = None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([p[0] for p in pieces], key_type)]
            columns += [pa.array([p[k] for p in pieces], pa.int64()) for k in range(1, 7)]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(p[7], "<i4") for p in pieces], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[*names, "ids"][:len(columns)])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for k, ids in zip(part.column(0).to_pylist(), code.encode_batch(texts)):
                    if pieces := list(packer.feed(k, ids, code.sentence_ends(ids))):
                        yield rows(pieces)
        if pieces := list(packer.finish()):
            yield rows(pieces)

    ordered = (docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie")
               .sortWithinPartitions("id", "tie").select("id", "text"))
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", key)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
