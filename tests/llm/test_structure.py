"""Prefix tries, decontamination and tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lakehook.llm import alignment, decontamination, prefix_trie
from tests.llm.cases import awkward, prose


# --- conversation prefix trie ---

CONVERSATION_DDL = "conv_id long, turn long, role string, text string"


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, turn_digest(role, text), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(of) - 1) * words
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node],
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                        "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


def conversations(seed, n=60, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(0, 3 * n, 3):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", " x\ty z", "q"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band,longest", [(16, 7), (2, 9), (3, 30)])
def test_trie_against_brute_force(spark, band, longest):
    rows = conversations(band, 40, longest)
    # one conversation far longer than the others, and one much like it
    rows += [(1000, t, "user", f"t{t % 3}") for t in range(70)] + [(1001, t, "user", f"t{t % 3}") for t in range(64)]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(rows, CONVERSATION_DDL), band)) == brute_trie(rows)


def test_trie_of_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", ""), (1, 0, None, "user"), (2, 5, "a", "b"),
            (2, 5, "a", "b"), (2, None, "ab", ""), (None, 1, "user", "lost"), (60, 1, "u", "only"), (61, 0, "u", "short"),
            (7, 1, "", " \t "), (8, 1, "x", "w " * 40_000), (None, None, None, None), (23, 0, "u", "no lender")]
    df = spark.createDataFrame([(*r, "k", 3, b"z", 1) for r in rows], CONVERSATION_DDL + ", key string, pos int, path binary, conv long")
    assert trie_rows(prefix_trie.trie(df)) == brute_trie(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert prefix_trie.trie(df.where("conv_id is null")).count() == 0
    # conversations without any turn of their own are members of the root alone
    bare = [(c, 0, "u", "t") for c in (21, 22, 23, 24, 25)]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(bare, CONVERSATION_DDL))) == brute_trie(bare)


def test_a_list_of_ids_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(b"k", c) for c in range(-5, 900)] + [(b"j", c) for c in range(3)] + [(b"i", 10)]
    got = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie.digest_of_ids(
        spark.createDataFrame(rows, "key binary, conv long")).collect()}
    for k in (b"k", b"j", b"i"):
        ids = ",".join(str(c) for key, c in sorted(rows) if key == k)
        assert got[k] == hashlib.sha256(ids.encode()).hexdigest()


# --- benchmark decontamination ---

def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items, window=10):
    grams = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k:k + window])].add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [64, 1 << 20])
def test_contamination_against_brute_force(spark, shard):
    rng = random.Random(shard)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 11, 30]))) for k in range(25)]
    items += [(3, items[4][1]), (None, items[5][1]), (None, None), (30, ""), (31, "!!"), (32, "THE, the; the"), (33, "é ß 日本語")]
    docs = []
    for k in range(150):
        text = prose(rng, rng.randint(0, 80))
        if k % 5 == 0:
            text += " " + rng.choice(items)[1:][0].__str__().upper().replace(" ", "-") + " " + prose(rng, 5)
        docs.append((k, text))
    docs += [(None, items[1][1]), (7, items[2][1]), (7, items[2][1]), (200, None), (201, "—, . !"), (202, "the the the the é ß 日本語 the")]
    df = spark.createDataFrame([(d, t, 1, 2, "w") for d, t in docs], "doc_id long, text string, shard int, place int, word string")
    got = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), shard_words=shard)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr) == \
        brute_contamination(docs, items)


def test_phrases_stand_where_they_are_said_to_stand(spark):
    rng = random.Random(5)
    docs = [(k, prose(rng, 60)) for k in range(30)]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_words=300)
    phrases = [["the", "river"], ["the", "the"], ["slow", "water", "house"], ["nowhere", "the"]]
    asked = spark.createDataFrame([(k, p, ["x"]) for k, p in enumerate(phrases)], "phrase long, words array<string>, items array<string>")
    texts = index.where("word is null").select("shard", "place", "id")
    for near in (None, 1, 6):
        found = decontamination.search(index, asked, near).join(texts, ["shard", "place"]).collect()
        got = {(r["id"], m["phrase"], m["position"]) for r in found for m in r["matches"]}
        want = set()
        total = Counter(w for _, t in docs for w in words(t))
        for d, text in docs:
            w = words(text)
            for p, phrase in enumerate(phrases):
                rarest = min((total[x], o, x) for o, x in enumerate(phrase))[2]
                for at in range(len(w)):
                    if near is None:
                        ok = w[at:at + len(phrase)] == phrase
                    else:
                        ok = w[at] == rarest and all(x in w[max(0, at - near):at + near + 1] for x in phrase)
                    if ok:
                        want.add((d, p, at))
        assert got == want and got


def test_contamination_of_empty_tables_and_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    none = decontamination.contamination(docs, items.limit(0)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in none) == [(1, 3, 0, []), (2, 0, 0, [])]
    rng = random.Random(2)
    long = prose(rng, 50_000)
    middle = " ".join(words(long)[30_000:30_012])
    row = decontamination.contamination(
        spark.createDataFrame([(1, long)], "doc_id long, text string"),
        spark.createDataFrame([(9, middle)], "item_id long, text string"), shard_words=1000).collect()
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in row] == brute_contamination([(1, long)], [(9, middle)])
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 11)
    assert [w.decode() for part in decontamination.words_of(long[:5000]) for w in part] == words(long[:5000])


@pytest.mark.parametrize("bound", [0, 1 << 24])
def test_phrase_words_beyond_the_broadcast_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(decontamination, "PLACES", 3)
    rng = random.Random(8)
    docs = [(k, prose(rng, 40)) for k in range(20)]
    items = [(k, " ".join(words(docs[k][1])[5:20])) for k in range(6)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"), shard_words=100)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=repr) == \
        brute_contamination(docs, items)


# --- cross-tokenizer alignment ---

@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*alignment.default_paths())


def brute_alignment(aligner, text):
    """Tokens, groups and links of a whole text from the libraries' ids and the tokens' bytes."""
    if not text:
        return None
    a = aligner.a.encode(f" {text}", add_special_tokens=False).ids
    b = aligner.b.encode(text)
    raw = f" {text}".encode()
    if b"".join(aligner.bytes_a[i] for i in a) != raw or b"".join(aligner.bytes_b[i] for i in b) != raw:
        return None

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i])))
            at += len(of[i])
        return out

    sa, sb = spans(a, aligner.bytes_a), spans(b, aligner.bytes_b)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, low = [], 0
    for cut in cuts:
        groups.append(",".join(str(i) for i, (_, e) in zip(a, sa) if low < e <= cut) + "|"
                      + ",".join(str(i) for i, (_, e) in zip(b, sb) if low < e <= cut))
        low = cut
    links = [(i, j) for i, (x, y) in zip(a, sa) for j, (u, v) in zip(b, sb) if x < v and u < y]
    return a, b, groups, links


TEXTS = ["", None, " ", "  ", "\n", "a", "Hello world", "  two  spaces  ", "a\nb\n\n c \n", "don't I'LL 123,456.78", "é ß 日本語 👍🏽 ﬁ ½",
         "x ▁ y", "<|endoftext|> <s> <0x41> </s>", "tab\tand\r\nline\x1c end\x85 nbsp\xa0x", "a" * 300 + " " + "é" * 200,
         "\x00zero", "　wide　space", "𝔘𝔫𝔦 𐍈 \U0003d000", "word" * 30 + " tail ", "   \n  x", "́ combining", "a.b,c;d!e?f"]


def test_alignment_against_brute_force(both):
    rng = random.Random(4)
    alphabet = "ab é\n .,'▁<>0x日👍\t　​1"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += [prose(rng, 50) for _ in range(20)]
    assert both.segmented
    for text, got in zip(texts, both.documents(texts)):
        want = brute_alignment(both, text)
        if want is None:
            assert got is None, text
            continue
        a, b, groups, links = want
        assert got[:3] == (len(a), len(b), len(groups)) and got[3] == ";".join(groups), text
        assert Counter(int(x) for x in alignment.np.frombuffer(got[4], "<i8")) == Counter(i << 32 | j for i, j in links), text


def test_words_together_align_as_words_alone(both):
    rng = random.Random(11)
    words = [rng.choice(" \n") + "".join(rng.choice("aeimnorstZQÀéßøñž") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    words = list(dict.fromkeys(words))
    assert both.align_words(words) == both.align(words)
    assert both.align_words(words[:1]) == both.align(words[:1])


def test_whole_texts_align_as_their_segments(both):
    texts = [t for t in TEXTS if t]
    assert both.documents(texts) == [both._whole(t) for t in texts]


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_alignment_counts(spark, both, bound):
    rng = random.Random(6)
    docs = [(k, prose(rng, rng.randint(1, 25))) for k in range(40)] + [(k, t) for k, t in enumerate(TEXTS)]
    docs += [(r["doc_id"], r["text"][:3000] if r["text"] else r["text"]) for r in awkward(spark).collect()] + [(None, "one two")]
    found = [brute_alignment(both, t) for _, t in docs]
    holds, best = Counter(), Counter()
    for f in found:
        holds.update(set(f[3]) if f else ())
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    want = []
    for (d, _), f in zip(docs, found):
        if f is None:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        want.append((d, len(a), len(b), len(groups), len(links), sum(holds[x] == best[x[0]] for x in links),
                     sum(holds[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, row int, pair int")
    rows = alignment.align_documents(df, broadcast_rows=bound).collect()
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                    r["groups_sha256"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] or not r["groups_sha256"] for r in rows)
    assert alignment.align_documents(df.limit(0)).count() == 0
