"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B).

Both tokenizers read the same bytes, a space and the text (B adds the space
itself). Their libraries' spans are coarse cuts: character offsets for A, byte
spans of the result proto for B. Where tokens share a character (a multibyte
character cut by A, byte-fallback tokens of B), the tokens' own decoded bytes
refine the cuts. Byte offsets where tokens of both end cut a text into groups;
an A and a B token are linked when their byte ranges overlap.

Neither vocabulary joins a blank with what stands before it, or plain punctuation
with a letter before it (checked when the
files are read; whole texts are encoded otherwise), so a text is cut before a
blank that follows no blank and before punctuation after a word. Such a segment's tokens, groups and links are found
once and remembered, up to ``CACHE_SEGMENTS`` short ones by a Python worker. A
cut between segments is a cut of both tokenizers, so groups never cross it.

Spark splits the scan; a task writes, for each text, its distinct id pairs with
their numbers of links. In how many documents a pair stands is one aggregate
with map-side sums; the counts are joined to the texts' pairs, broadcast when
the counted rows of that table are at most ``BROADCAST_ROWS`` and by shuffle
beyond.

Defined results: null and empty texts, and texts whose tokens' joined bytes
differ from the text's (as with U+2581 for B), have no tokens: zeros and an
empty ``groups``. Strings of special tokens are plain text. Repeated rows are
documents of their own, null ids stay null, an empty table gives an empty
result, and columns other than key and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.bpe import byte_alphabet
from lakehook.llm.common import Remembered, materialise, prepare_workers, table

CACHE_SEGMENTS = 250_000
# Longer segments are aligned each time they occur.
LONG_SEGMENT = 64
SLICE_ROWS = 256
# Pairs with counts (24 bytes a row) that are sent to every executor at most.
BROADCAST_ROWS = 2_000_000

# A blank begins a segment when no white space stands before it; plain punctuation
# after a word of letters does, too.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
_WORD = rf"[ \n][{LETTERS}]++"
_SEGMENTS = re.compile(rf"{_WORD}(?=[ \n{STOPS}]|\Z)|[{STOPS}]++(?=[ \n]|\Z)|[ \n{STOPS}](?:[^ \n]++|(?<=\s)[ \n])*+")
_WORDS = re.compile(_WORD)
# Words that are aligned as one text.
TOGETHER = 4_096
SPACE_MARK = "▁"
SEGMENT = tuple[int, int, int, str, bytes]  # tokens of A, of B, groups, groups as text, links


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(back[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.is_byte = [self.b.is_byte(i) for i in range(self.b.get_piece_size())]
        self.byte_b = np.array(self.is_byte)
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.segmented = self._separable()
        self.known: Remembered = Remembered(CACHE_SEGMENTS)

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def _separable(self) -> bool:
        """Whether no token can reach over the border of two segments."""
        pieces = [self.b.id_to_piece(i) for i, byte in enumerate(self.is_byte) if not byte]
        across = re.compile(rf"[\n ]|[^{SPACE_MARK}]{SPACE_MARK}|[{LETTERS}][{STOPS}]")
        if any(map(across.search, pieces)):
            return False
        # A splits words by its own pattern, as the library shows on one sample
        split = self.a.pre_tokenizer.pre_tokenize_str(" ab, \n cd\nef  g") if self.a.pre_tokenizer else []
        return self.a.normalizer is None and [s for _, s in split] == [
            (0, 3), (3, 4), (4, 6), (6, 9), (9, 10), (10, 12), (12, 13), (13, 15)]

    # --- spans in bytes ---

    def ends_a(self, text: str, encoding) -> list[int]:
        """Byte offsets at which A's tokens end."""
        offsets = encoding.offsets
        if text.isascii():
            return [e for _, e in offsets]
        at = [0, *accumulate(len(c.encode()) for c in text)]
        ends, here = [], 0
        for k, (i, (_, end)) in enumerate(zip(encoding.ids, offsets)):
            here += len(self.bytes_a[i])
            # a coarse cut holds unless the next token shares the character
            if k + 1 == len(offsets) or offsets[k + 1][0] >= end:
                here = at[end]
            ends.append(here)
        return ends

    def ends_b(self, tokens: list[tuple[int, int]]) -> list[int]:
        """Byte offsets at which B's tokens (id, coarse end) end."""
        ends, here = [], 0
        for i, end in tokens:
            here = here + 1 if self.is_byte[i] else end
            ends.append(here)
        return ends

    def _tokens_b(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(id, end in bytes) of B's tokens for texts whose first blank is a part of the text.

        A line break, which no piece holds, keeps the blank that the library adds apart.
        """
        if not self.segmented:
            found = self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
            return [[(p.id, p.end + 1) for p in f.pieces] for f in found]
        found = self.b.encode(["\n" + t for t in texts], return_type="proto", num_threads=1)
        return [[(p.id, p.end - 1) for p in f.pieces[2:]] for f in found]

    # --- words, many at once ---

    def align_words(self, words: list[str]) -> list[SEGMENT | None]:
        """As ``align``, for segments that are one word each after a blank.

        Such words are as independent side by side as they are alone, so they are
        one text for the libraries; their tokens are cut apart again by byte offsets.
        """
        raw = "".join(words).encode()
        a = self.a.encode(raw.decode(), add_special_tokens=False)
        ids_a = np.array(a.ids, np.int64)
        tokens_b = self._tokens_b([raw.decode()])[0]
        ids_b = np.array([i for i, _ in tokens_b], np.int64)
        if b"".join([self.bytes_a[i] for i in a.ids]) != raw or b"".join([self.bytes_b[i] for i, _ in tokens_b]) != raw:
            return self.align(words)
        # coarse ends, refined by decoded bytes where tokens share a character
        places = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
        offsets = np.array(a.offsets, np.int64)
        coarse = np.append(places, len(raw))[offsets[:, 1]]
        shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        ends_a = np.where(shared, np.cumsum(self.sizes_a[ids_a]), coarse)
        coarse = np.array([e for _, e in tokens_b], np.int64)
        ends_b = np.where(self.byte_b[ids_b], np.cumsum(self.sizes_b[ids_b]), coarse)
        # between two neighbouring ends stand one token of A and one of B: a link
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = (ids_a[of_a] << 32 | ids_b[of_b]).astype("<i8").tobytes()
        cuts = np.flatnonzero((ends_a[of_a] == ends) & (ends_b[of_b] == ends))
        borders = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(ends[cuts], borders)  # each word's last group
        if not np.array_equal(ends[cuts][np.minimum(last, len(cuts) - 1)], borders):
            return self.align(words)
        up_a, up_b, up_links = (of_a[cuts] + 1).tolist(), (of_b[cuts] + 1).tolist(), (cuts + 1).tolist()
        names_a, names_b = list(map(str, a.ids)), [str(i) for i, _ in tokens_b]
        groups = [",".join(names_a[i:j]) + "|" + ",".join(names_b[k:n])
                  for i, j, k, n in zip([0, *up_a], up_a, [0, *up_b], up_b)]
        out: list[SEGMENT | None] = []
        g = i = j = k = 0
        for upto in (last + 1).tolist():
            i2, j2, k2 = up_a[upto - 1], up_b[upto - 1], up_links[upto - 1]
            out.append((i2 - i, j2 - j, upto - g, groups[g] if upto == g + 1 else ";".join(groups[g:upto]), links[8 * k:8 * k2]))
            g, i, j, k = upto, i2, j2, k2
        return out

    # --- groups and links ---

    def align(self, texts: list[str]) -> list[SEGMENT | None]:
        """Tokens, groups and links of each text; None where tokens do not give its bytes."""
        out: list[SEGMENT | None] = []
        coarse_a = self.a.encode_batch(texts, add_special_tokens=False)
        for text, a, b in zip(texts, coarse_a, self._tokens_b(texts)):
            raw, ids_a, ids_b = text.encode(), a.ids, [i for i, _ in b]
            if (b"".join([self.bytes_a[i] for i in ids_a]) != raw
                    or b"".join([self.bytes_b[i] for i in ids_b]) != raw):
                out.append(None)
                continue
            out.append(self._grouped(ids_a, self.ends_a(text, a), ids_b, self.ends_b(b)))
        return out

    @staticmethod
    def _grouped(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> SEGMENT:
        if len(a) == len(b) == 1:
            return 1, 1, 1, f"{a[0]}|{b[0]}", (a[0] << 32 | b[0]).to_bytes(8, "little")
        groups, links = [], []
        i = j = first_i = first_j = 0
        while i < len(a):
            links.append(a[i] << 32 | b[j])
            left, right = ends_a[i], ends_b[j]
            i += left <= right
            j += right <= left
            if left == right:
                groups.append(",".join(map(str, a[first_i:i])) + "|" + ",".join(map(str, b[first_j:j])))
                first_i, first_j = i, j
        return len(a), len(b), len(groups), ";".join(groups), array("q", links).tobytes()

    def segments(self, text: str) -> list[str]:
        return _SEGMENTS.findall(f" {text}") if self.segmented else [f" {text}"]

    def documents(self, texts: list[str | None]) -> list[SEGMENT | None]:
        """The alignment of whole texts; None for those without tokens."""
        cut = [self.segments(t) if t else [] for t in texts]
        out: list[SEGMENT | None] = []
        for k, (text, parts) in enumerate(zip(texts, cut)):
            try:
                got = list(map(self.known.__getitem__, parts))
            except KeyError:
                self._learn(set(chain.from_iterable(cut[k:])))
                got = self._with_long(parts)
            if not parts:
                out.append(None)
            elif None in got:
                # segments whose bytes differ alone may still give the text together
                out.append(self._whole(text))
            else:
                a, b, n, groups, links = zip(*got)
                out.append((sum(a), sum(b), sum(n), ";".join(groups), b"".join(links)))
        return out

    def _learn(self, parts: set[str]) -> None:
        fresh = self.known.unknown([p for p in parts if len(p) <= LONG_SEGMENT])
        words = [p for p in fresh if self.segmented and _WORDS.fullmatch(p)]
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            self.known.update(zip(some, self.align_words(some)))
        rest = [p for p in fresh if p not in self.known]
        self.known.update(zip(rest, self.align(rest)))

    def _with_long(self, parts: list[str]) -> list[SEGMENT | None]:
        long = list({p for p in parts if len(p) > LONG_SEGMENT})
        more = dict(zip(long, self.align(long)))
        return [more[p] if p in more else self.known[p] for p in parts]

    def _whole(self, text: str) -> SEGMENT | None:
        was, self.segmented = self.segmented, False
        try:
            return self.align([f" {text}"])[0]
        finally:
            self.segmented = was


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a Python worker, with the segments it remembers."""
    return Aligner(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text",
            paths: tuple[str, str] | None = None, keep: bool = True) -> DataFrame:
    """One row per row: key, n_a, n_b, n_groups, n_links, groups_sha256, the distinct
    ``pairs`` (A id * 2^32 + B id) with their ``times`` and, with ``keep``, ``groups``
    ('a1,a2|b1;a3|b2,b3')."""
    prepare_workers(docs.sparkSession)
    path_a, path_b = paths or default_paths()
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"]
    schema = (f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, times array<int>" + (", groups string" if keep else ""))
    nothing: SEGMENT = (0, 0, 0, "", b"")

    def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype("<i4")
        flat = np.concatenate(arrays) if arrays else np.empty(0, "<i8")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [f or nothing for f in align.documents(part.column(1).to_pylist())]
                links = [np.unique(np.frombuffer(f[4], "<i8"), return_counts=True) for f in found]
                columns = [part.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)),
                           pa.array([len(f[4]) // 8 for f in found], pa.int64()),
                           pa.array([hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found]),
                           lists([p for p, _ in links], pa.int64()), lists([n for _, n in links], pa.int32())]
                if keep:
                    columns.append(pa.array([f[3] for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names[:len(columns)])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair of its A id stands in more)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    # an A id has at most as many pairs as B has ids
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    paths: tuple[str, str] | None = None, keep: bool = True,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``aligned`` rows (written once) with n_best and count_sum over the whole table."""
    rows = aligned(docs, key, text, paths, keep).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "aligned")
    counts = materialise(pair_counts(rows), "pair-best")
    if counts.count() <= broadcast_rows:
        counts = F.broadcast(counts)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").drop("row").withColumns(
        {c: F.coalesce(F.col(c), none) for c in ("n_best", "count_sum")})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), keep=False)
