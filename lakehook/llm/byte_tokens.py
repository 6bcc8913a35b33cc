"""Ids of whole texts by a byte-level BPE file of the tokenizers library.

Texts in Latin letters and common punctuation are encoded whole by tiktoken, with the
file's own vocabulary as ranks (where its merges stand in the order of their ids; else
not): for such texts both libraries split words alike, and the tests hold the ids equal.

Other texts are cut: the vocabulary's pattern never joins a word with what stands
before its leading space, so a text is cut into such pieces (punctuation that follows a
word apart) and the tokenizers library encodes each distinct piece once; tasks remember
up to ``CACHE_PIECES`` of them.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from lakehook.llm.bpe import byte_alphabet
from lakehook.llm.common import Remembered

CACHE_PIECES = 400_000

# Letters up to a blank or to plain punctuation, else a word with at most one space
# before it, or white space before that. \x1c-\x1f are white space for Python alone.
_PIECES = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[ \n.,;:!?]|\Z)"
    r"| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
# Characters whose class may differ between the libraries' Unicode tables, and controls.
_RARE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
# Fixed value: how a byte-level pre-tokenizer splits words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A word after its space. Such words are as independent side by side as alone, so the
# library encodes TOGETHER of them as one text.
_WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ɏ]++")
TOGETHER = 4_096
# A sentence is over after these, before a blank, and with a line.
_STOPS = tuple(".!?…。！？")
_CLOSERS = "\"'”’)]"


class ByteCoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_specials = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.ids = Remembered(CACHE_PIECES)
        names = self.library.get_vocab(with_added_tokens=False)
        # byte-level tokens have a character for each byte
        self.sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        self.sizes[list(names.values())] = [len(t) for t in names]
        self.whole = self._by_ranks(path, names)
        strings = [self.library.decode([i]) for i in range(self.library.get_vocab_size())]
        self.line = np.array(["\n" in t for t in strings])
        self.stop = np.array([t.rstrip(_CLOSERS).endswith(_STOPS) for t in strings])
        self.blank = np.array([t[:1].isspace() for t in strings])

    def _by_ranks(self, path: str, names: dict[str, int]):
        """A tiktoken encoding of the same ids, if the file's merges are in the order of ids."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, back = spec["pre_tokenizer"] or {}, {c: b for b, c in enumerate(byte_alphabet())}
        plain = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"]
                 and not split["add_prefix_space"] and not spec["model"].get("ignore_merges"))
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if not plain or {c: names.get(c, 256) < 256 for c in back} != dict.fromkeys(back, True) or any(
                names.get(x + y) != 256 + r for r, (x, y) in enumerate(merges)) or len(names) != 256 + len(merges):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in names.items()}
        return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def sentence_ends(self, ids: bytes) -> np.ndarray:
        """Numbers of ids after which a sentence or a line is over."""
        ids = np.frombuffer(ids, "<u4")
        over = self.line[ids]
        over[:-1] |= self.stop[ids[:-1]] & self.blank[ids[1:]]
        return np.flatnonzero(over) + 1

    def _learn(self, pieces: set[str]) -> None:
        fresh = self.ids.unknown(pieces)
        words = [p for p in fresh if _WORD.fullmatch(p)]
        for at in range(0, len(words), TOGETHER):
            self._learn_words(words[at:at + TOGETHER])
        fresh = [p for p in fresh if p not in self.ids]
        got = self.library.encode_batch_fast(fresh, add_special_tokens=False)
        self.ids.update(zip(fresh, [array("I", g.ids).tobytes() for g in got]))

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words from those of their text, cut where each word's bytes end."""
        text = "".join(words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        borders = np.cumsum([len(w.encode()) for w in words])
        upto = np.searchsorted(ends, borders) + 1
        if upto[-1] == len(ids) and np.array_equal(ends[upto - 1], borders):
            raw, edges = ids.tobytes(), (4 * upto).tolist()
            self.ids.update(zip(words, [raw[i:j] for i, j in zip([0, *edges], edges)]))

    def _cut(self, text: str) -> list[str]:
        if not any(s in text for s in self.specials):
            return _PIECES.findall(text)
        out, at = [], 0
        for m in self.split_specials.finditer(text):
            out += _PIECES.findall(text[at:m.start()]) + [m.group()]
            at = m.end()
        return out + _PIECES.findall(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        plain = [self.whole is not None and not _RARE.search(t) and not any(s in t for s in self.specials) for t in texts]
        cut = [None if p else self._cut(t) for p, t in zip(plain, texts)]
        out = []
        for k, pieces in enumerate(cut):
            if pieces is None:
                out.append(self.whole.encode_to_numpy(texts[k], disallowed_special=()).astype("<u4").tobytes())
                continue
            try:
                out.append(b"".join(map(self.ids.__getitem__, pieces)))
            except KeyError:
                self._learn(set(chain.from_iterable(filter(None, cut[k:]))))
                out.append(b"".join(map(self.ids.__getitem__, pieces)))
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> ByteCoder:
    """One coder for all tasks of a Python worker."""
    return ByteCoder(path)
