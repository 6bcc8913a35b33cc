"""BPE and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakehook.llm import bpe, byte_tokens, packing
from tests.conftest import SMOKE_DIR
from tests.llm.cases import awkward, prose

TEXTS = [":\U0003d000", "a\U0003d000 \U00012550x \U000323b0", "J\u030c \U00010d50\U00010d51", "", "  ", "<|endoftext|>a b", "x<|startoftext|>", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ", "éa don't I'LL we've 123 ½ ²",
         "a\x1cb \x85 c d e", "日本語 テスト 한국어 ́ 👍🏽", "a" * 5000, "aaaa " * 50, "!!!??!! @@@###", "  a   b\n\n\n c \n"]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word():
    path = bpe.default_path()
    return bpe.WordBpe(path), library(path)


@pytest.fixture(scope="module")
def byte():
    path = packing.default_path()
    return byte_tokens.ByteCoder(path), library(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdefgst'. \n<|>"), st.characters(exclude_categories=["Cs"])),
                        max_size=60), max_size=4))
def test_ids_equal_the_librarys(word, byte, texts):
    for own, lib in (word, byte):
        want = lib.encode_batch(texts + TEXTS, add_special_tokens=False)
        got = own.encode_batch(texts + TEXTS)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_words_learned_together_have_the_librarys_ids(byte):
    own, lib = byte
    rng = random.Random(9)
    words = ["".join(rng.choice("aeimnorstZQÀéßøñž") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    texts = [" ".join(words[k:k + 40]) for k in range(0, len(words), 40)]
    want = [w.ids for w in lib.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in own.encode_batch(texts)] == want


def test_ids_of_whole_documents(spark, byte):
    own, lib = byte
    assert own.whole is not None
    texts = [r[0] or "" for r in spark.read.parquet(SMOKE_DIR.replace("sf0.001", "sf0.01") + "/documents.parquet").select("text").collect()]
    texts += [t.upper() for t in texts[:300]] + [t.replace(" ", "  ").replace("e", "'ll ") for t in texts[:300]]
    rng = random.Random(10)
    texts += ["".join(rng.choice("ab c,'.\n\t1ést#") for _ in range(rng.randint(1, 80))) for _ in range(20_000)]
    want = [w.ids for w in lib.encode_batch_fast(texts, add_special_tokens=False)]
    got = own.encode_batch(texts)
    assert [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w] == []


def test_ids_of_every_code_point(word, byte):
    points = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(points), 100_000):
        texts = [f":{c}a{c} {c}" for c in points[at:at + 100_000]]
        for own, lib in (word, byte):
            want = [w.ids for w in lib.encode_batch_fast(texts, add_special_tokens=False)]
            got = own.encode_batch(texts)
            wrong = [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w]
            assert not wrong, wrong[:10]


def test_decoding_equals_the_librarys(word):
    own, lib = word
    for ids in own.encode_batch(TEXTS):
        assert own.decode(ids) == lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_verification_fails_just_the_wrong_proposals(word):
    own, _ = word
    rng = random.Random(1)
    words = ["".join(rng.choice("etaonshr") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    exact = [own.merge(w) for w in words]
    assert own.merge_many(words) == exact
    ids, counts = own.propose(words)
    ends = np.cumsum(counts)
    wrong = 0
    for w, e, c, want in zip(words, ends, counts, exact):
        got = ids[e - c:e]
        ok = bool((got >= 0).all()) and bool(own.compatible(got[:-1], got[1:]).all())
        assert ok == (got.tolist() == want)
        wrong += not ok
    assert 0 < wrong < len(words)


def test_query_columns(spark, word):
    own, lib = word
    rows = bpe.encode_decode(awkward(spark)).collect()
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    text = {r["text"] or "" for r in awkward(spark).collect()}
    assert {tuple(r["ids"]) for r in rows} == {tuple(lib.encode(t, add_special_tokens=False).ids) for t in text}
    assert bpe.encode_decode(awkward(spark).limit(0)).count() == 0


def brute(stops, costs):
    pos, cost = [0, *stops], [0, *costs]
    f = [0] + [10 ** 9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            d = pos[j] - pos[i]
            options = []
            if d <= packing.WINDOW:
                options.append(packing.OPEN + packing.padding(d))
                if j == len(pos) - 1:
                    options.append(packing.split_cost(d))
            elif d <= 2 * packing.WINDOW:
                options.append(2 * packing.OPEN + packing.CUT_INSIDE + 2 * packing.WINDOW - d)
            f[j] = min([f[j], *(f[i] + o + cost[j] for o in options)])
    return f[-1]


@pytest.mark.parametrize("seed", range(40))
def test_plan_costs_as_little_as_all_plans(seed):
    rng = np.random.default_rng(seed)
    stops = np.cumsum(rng.integers(1, rng.choice([5, 40, 300, 1000]), rng.integers(1, 120)))
    docs = np.unique(np.r_[rng.choice(stops, max(1, len(stops) // 5)), stops[-1]])
    every, costs = packing.positions(stops, docs)
    cuts, cost = packing.plan(every, costs)
    assert cost == brute(every.tolist(), costs.tolist())
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == stops[-1] and sizes.min() > 0 and sizes.max() <= packing.WINDOW


def sequence_sizes(pieces):
    """Sizes of the sequences, each gapless from 0 and of at most WINDOW ids."""
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        sizes.append(at)
    return sizes


def test_pieces_hold_every_id_once(spark, byte):
    _, lib = byte
    rng = random.Random(0)
    docs = spark.createDataFrame([(k, prose(rng, rng.randint(1, 900))) for k in range(300)], "doc_id long, text string")
    pieces = [r.asDict() for r in packing.pack(docs, keep_ids=False).collect()]
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for r in docs.collect():
        ids = np.array([*lib.encode(r["text"], add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sizes = sequence_sizes(pieces)
    assert sum(map(packing.padding, sizes)) < 0.03 * sum(sizes)


def test_packing_of_awkward_rows(spark, byte):
    _, lib = byte
    rows = packing.pack(awkward(spark)).collect()
    want = sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in awkward(spark).collect())
    assert sum(r["length"] for r in rows) == want and all(r["length"] == len(r["ids"]) for r in rows)
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1]
    assert packing.pack(awkward(spark).limit(0)).count() == 0
