"""BPE encoding and decoding by speculation and verification.

A word's ids are proposed by greedy longest match against the vocabulary. Each
adjacent pair of proposed tokens is then tested for compatibility, for all words
of a batch at once: undoing the merges of both sides, newest first, no merge
across their border may have come earlier. A sequence whose pairs are all
compatible is the BPE encoding; only words with a failing pair are merged
exactly. Words repeat, so tasks keep the ids of the pieces they have seen, up to
``CACHE_PIECES``; the work on a text is then one lookup for each of its pieces.

Texts are independent, so Spark only splits the scan: no shuffle, and a lost
executor costs its own splits. The tokenizer file is a parameter and is read
where the tasks run.

Defined results: a null text counts as empty, has 0 ids and decodes to the
empty text. Special tokens' strings in a text are their ids, as in the library.
Repeated rows repeat in the result. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import Remembered, prepare_workers, table

# Pieces whose ids a task remembers, in each of two generations.
CACHE_PIECES = 300_000
# Words of up to so many bytes are merged together, longer ones each by a heap.
SHORT_WORD = 48
# Rows of an Arrow batch that are turned into Python texts at once.
SLICE_ROWS = 1024
# Blanks for str.split() that are no white space for the vocabulary's patterns.
_CONTROL_BLANKS = regex.compile("[\x1c-\x1f]")
# Characters outside the Latin and punctuation blocks. Unicode tables of different
# libraries differ in what is a letter or a capital there, so the tokenizer file's
# own library normalises and splits the pieces that hold one.
_RARE = regex.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = (chr(256 + k) for k in range(256))
    return [names[b] if b in names else next(hidden) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary file (NFC, lower case, no blanks)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.library_normal, self.library_split = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_specials = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        size = max([*self.vocab.values(), *self.specials.values()]) + 1
        self.strings = [""] * size
        for token, i in (self.vocab | self.specials).items():
            self.strings[i] = token
        self.alphabet = byte_alphabet()
        # merges: (left, right) -> rank, and for each token the merge that makes it
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[a + b]
            x, y = self.vocab[a], self.vocab[b]
            self.ranks[x, y], self.made[x, y] = r, made
            self.left[made], self.right[made], self.rank[made] = x, y, r
        self.size = size
        self.rank_made = np.fromiter(self.made.values(), np.int64, len(self.made))
        self._prepare_pairs()
        self.symbol = np.array([self.vocab[c] for c in self.alphabet], np.int64)
        self.last_symbol = np.array([self.vocab[c + self.end] for c in self.alphabet], np.int64)
        self._prepare_match()
        self.pieces = Remembered(CACHE_PIECES)

    # --- proposal: greedy longest match, all words at once ---

    def _prepare_match(self) -> None:
        """Vocabulary by byte length, as sorted hashes of its bytes; a word end is byte 256."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        by_length: dict[int, tuple[list[int], list[int]]] = {}
        for token, i in self.vocab.items():
            if token in self.specials:
                continue
            core, ends = (token[:-len(self.end)], [256]) if self.end and token.endswith(self.end) else (token, [])
            symbols = [back[c] for c in core] + ends
            h = 0
            for s in symbols:
                h = (h * 1_000_003 + s + 1) & 0xFFFFFFFFFFFFFFFF
            hashes, ids = by_length.setdefault(len(symbols), ([], []))
            hashes.append(h)
            ids.append(i)
        self.match: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length, (hashes, ids) in sorted(by_length.items()):
            h = np.array(hashes, np.uint64)
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two tokens share a hash")
            self.match.append((length, h[order], np.array(ids, np.int64)[order]))

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each word's ids."""
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        text = np.empty(int(ends[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.frombuffer(b"".join(words), np.uint8)
        text[~inside] = 256
        room = np.repeat(ends, sizes) - np.arange(len(text))
        best = np.full(len(text), -1, np.int64)
        step = np.ones(len(text), np.int64)
        h = np.zeros(len(text), np.uint64)
        at, known = 0, {length: (hashes, ids) for length, hashes, ids in self.match}
        where = np.arange(len(text))
        with np.errstate(over="ignore"):
            for length in range(1, self.match[-1][0] + 1):
                where = where[room[where] >= length]
                if not len(where):
                    break
                h[where] = h[where] * np.uint64(1_000_003) + (text[where + length - 1] + 1).astype(np.uint64)
                if length not in known:
                    continue
                hashes, ids = known[length]
                found = np.minimum(np.searchsorted(hashes, h[where]), len(hashes) - 1)
                hit = hashes[found] == h[where]
                best[where[hit]] = ids[found[hit]]
                step[where[hit]] = length
        at = ends - sizes
        owner = np.arange(len(words))
        got_owner, got_ids = [], []
        while len(at):
            got_owner.append(owner)
            got_ids.append(best[at])
            at = at + step[at]
            # a lone word end is no symbol of its own: its word is merged exactly
            going = at < ends[owner]
            at, owner = at[going], owner[going]
        owners = np.concatenate(got_owner)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(got_ids)[order], np.bincount(owners, minlength=len(words))

    # --- verification: every adjacent pair ---

    def _prepare_pairs(self) -> None:
        """Merge ranks by pair in a table with open addressing, for lookups by array."""
        keys = np.array([x * self.size + y for x, y in self.ranks], np.int64)
        bits = max(8, len(keys)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, np.iinfo(np.int64).max)
        slots, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):
            at = (slots[waiting] + self.probes) & ((1 << bits) - 1)
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[waiting[free]]
            won = self.slot_key[at] == keys[waiting]
            self.slot_rank[at[won]] = waiting[won]
            waiting, self.probes = waiting[~won], self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = self._slot(key)
        out = np.full(len(key), np.iinfo(np.int64).max)
        left = np.arange(len(key))
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == key
            out[left[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (found >= 0)
            if not on.any():
                break
            left, key, at = left[on], key[on], (at[on] + 1) & (len(self.slot_key) - 1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the joined text of tokens a and b gives just a and b.

        ``a`` and ``b`` walk back through the merges at the border, the later
        merge first. Two neighbours could have joined until the first of them
        was used up: on the left by a merge that goes first among equals, on the
        right by one that goes second.
        """
        good = np.ones(len(a), bool)
        never = np.iinfo(np.int64).max
        left_until = np.full(len(a), never)   # rank at which the left neighbour is used up
        right_until = np.full(len(a), never)
        idx = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(idx):
            r = self._pair_rank(a, b)
            bad = (r < left_until) & (r <= right_until) & (r != never)
            good[idx[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            idx, a, b, ra, rb = idx[go], a[go], b[go], ra[go], rb[go]
            left_until, right_until = left_until[go], right_until[go]
            undo_left = ra >= rb  # of equal merges the right one came later only if made of other tokens
            same = ra == rb
            undo_left &= ~same
            left_until = np.where(undo_left, ra, left_until)
            right_until = np.where(undo_left, right_until, rb)
            a = np.where(undo_left, self.right[a], a)
            b = np.where(undo_left, b, self.left[b])
        return good

    # --- exact merging of the words that fail ---

    def merge(self, word: bytes) -> list[int]:
        """One long word: the candidates wait in a heap by rank, then place."""
        ids = [int(self.symbol[c]) for c in word[:-1]] + [int(self.last_symbol[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1)
                if (r := self.ranks.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = self.made[a, b], -1, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Short words together: each round does every word's best merge, leftmost first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.symbol[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last_symbol[raw[ends]]
        never = np.iinfo(np.int64).max
        done: list[list[int]] = [[]] * len(words)
        while len(ids):
            rank = np.full(len(ids), never)
            rank[:-1] = np.where(owner[:-1] == owner[1:], self._pair_rank(ids[:-1], ids[1:]), never)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            settled = least == never
            for s, n in zip(starts[settled].tolist(), lengths[settled].tolist()):
                done[owner[s]] = ids[s:s + n].tolist()
            keep = np.repeat(~settled, lengths)
            best = keep & (rank == np.repeat(least, lengths))
            at = np.flatnonzero(best)
            at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]] if len(at) else at
            ids[at] = self.rank_made[rank[at]]
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        return done

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: propose, verify, merge what fails."""
        if not words:
            return []
        ids, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        failing = np.zeros(len(words), bool)
        failing[owner[ids < 0]] = True
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        inner = inner[(ids[inner] >= 0) & (ids[inner + 1] >= 0)]
        pairs, which = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)[which]
        failing[owner[inner[~ok]]] = True
        flat, ends = ids.tolist(), np.cumsum(counts).tolist()
        out = [flat[e - c:e] for e, c in zip(ends, counts.tolist())]
        redo = np.flatnonzero(failing).tolist()
        short = [k for k in redo if len(words[k]) <= SHORT_WORD]
        for k, got in zip(short, self.merge_many([words[k] for k in short])):
            out[k] = got
        for k in redo:
            if len(words[k]) > SHORT_WORD:
                out[k] = self.merge(words[k])
        return out

    # --- texts ---

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _cut(self, piece: str) -> list[str]:
        """The words of a piece without blanks."""
        if not piece.isascii() and _RARE.search(piece):
            piece = self.library_normal.normalize_str(piece)
            return [piece[a:b] for _, (a, b) in self.library_split.pre_tokenize_str(piece)]
        return self.words.findall(self.normalise(piece))

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces without blanks; a special token's begins with one."""
        fresh = self.pieces.unknown(pieces)
        special = {p: self.specials[p[1:]] for p in fresh if p[0] == " "}
        fresh = [p for p in fresh if p not in special]
        cut = {p: self._cut(p) for p in fresh if not (p.isascii() and p.isalpha() and p.islower())}
        words = list(dict.fromkeys([p for p in fresh if p not in cut] + [w for ws in cut.values() for w in ws]))
        ids = {w: array("I", i).tobytes() for w, i in zip(words, self.encode_words([w.encode() for w in words]))}
        self.pieces.update([(p, i.to_bytes(4, "little")) for p, i in special.items()])
        self.pieces.update([(p, b"".join(map(ids.__getitem__, cut[p])) if p in cut else ids[p]) for p in fresh])

    def _pieces_of(self, text: str) -> list[str]:
        if text.isascii() or not _RARE.search(text):
            text = self.normalise(text)
        if _CONTROL_BLANKS.search(text):
            return [p for p in regex.split(r"[^\S\x1c-\x1f]+", text) if p]
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for text in texts:
            if self.specials and "<|" in text:
                part: list[str] = []
                at = 0
                for m in self.split_specials.finditer(text):
                    part += self._pieces_of(text[at:m.start()]) + [f" {m.group()}"]
                    at = m.end()
                parts.append(part + self._pieces_of(text[at:]))
            else:
                parts.append(self._pieces_of(text))
        out: list[bytes] = []
        for part in parts:
            try:
                out.append(b"".join(map(self.pieces.__getitem__, part)))
            except KeyError:
                self._learn(set(chain.from_iterable(parts[len(out):])))
                out.append(b"".join(map(self.pieces.__getitem__, part)))
        return out

    def decode(self, ids: bytes) -> str:
        """The file has no decoder: tokens are joined by single spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    """One coder for all tasks of a Python worker, with the pieces it remembers."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """Ids and decoded text of every row of ``docs``.

    Returns key, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, the
    ids (array of int) and the decoded text themselves.
    """
    prepare_workers(docs.sparkSession)
    path = tokenizer or default_path()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                decoded = [bpe.decode(i) for i in ids]
                columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                           pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                           pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                if keep:
                    columns += [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())),
                                pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), keep=False)
