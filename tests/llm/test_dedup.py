"""Exact copies, near copies and near vectors against brute force."""

import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from lakehook.llm import common, exact_dedup, jaccard_join, near_vectors
from tests.conftest import SMOKE_DIR
from tests.llm.cases import awkward, prose


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_components_of_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(rng.randrange(-100, 100), rng.randrange(-100, 100)) for _ in range(120)] + [(500 + k, 501 + k) for k in range(40)]
        want = components({v for e in edges for v in e}, edges)
        got = {r["id"]: r["component_id"] for r in common.connected_components(
            spark.createDataFrame(edges, "a long, b long"), "test").collect()}
        assert all(want[v] == c for v, c in got.items()) and set(got) == {v for a, b in edges for v in (a, b) if a != b}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_exact_copies(spark, monkeypatch):
    docs = awkward(spark)
    rows = exact_dedup.decisions(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == Counter(
        (i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert sum(r["kept"] for r in rows) == len(groups)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.decisions(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_hot_digest_leaves_before_the_shuffle(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 2 = 0, 'same', concat('t ', id)) as text")
    rows = {r["doc_id"]: r for r in exact_dedup.decisions(docs).collect()}
    assert rows[4998]["keep_id"] == 0 and rows[4998]["group_size"] == 2500 and not rows[4998]["kept"]
    assert rows[4999]["group_size"] == 1 and exact_dedup.drop_copies(docs).count() == 2501


def shingle_sets(rows, n=5):
    out = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_links(sets):
    lists, links = defaultdict(list), []
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in lists[x]).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                links.append((i, j))
        for x in s:
            lists[x].append(i)
    return links


def same_groups(got, rows):
    sets = shingle_sets(rows)
    want = components(list(sets), brute_links(sets))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {
        i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_groups_of_the_documents(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    same_groups(jaccard_join.near_groups(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_jaccard_groups_with_long_lists_and_small_sets(spark, monkeypatch):
    # a large group of near copies, short texts and a shared passage, with bounds
    # so low that blocks, long lists and subsets are all in use
    monkeypatch.setattr(jaccard_join, "LONG", 6)
    monkeypatch.setattr(jaccard_join, "ALONE_DOCS", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 10)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *a: 6)
    rng = random.Random(5)
    base = prose(rng, 70).split()
    passage = prose(rng, 30)
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(80)]
    texts += [prose(rng, 60) + " " + passage for _ in range(30)]
    texts += [" ".join(prose(rng, rng.randint(1, 12)).split()) for _ in range(60)] + [" ".join(WORDY[:n]) for n in range(1, 14)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same_groups(jaccard_join.near_groups(docs).collect(), rows)


WORDY = [f"v{k}" for k in range(20)]


def test_small_sets_that_link_share_a_subset():
    for small in (3, 6, 9):
        for m in range(1, small + 1):
            for n in range(1, m + 1):
                need = jaccard_join.need(m, n)
                if need <= n:
                    assert need in jaccard_join.subset_sizes(m, small) and need in jaccard_join.subset_sizes(n, small)
                assert all(100 * k < 75 * (m + n - k) for k in range(min(need, n + 1)))


def test_jaccard_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = jaccard_join.near_groups(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[5] == {(1, 4)} and by[None] == {(1, 4), (0, None)}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, None}
    assert jaccard_join.near_groups(docs.limit(0)).count() == 0


def test_one_row_stays_of_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    base = [prose(rng, 80).split() for _ in range(4)]
    near = [[" ".join(w), " ".join(w[:-1] + ["other"]), " ".join(["other"] + w[1:])] for w in base]
    rows = [(None, near[0][0]), (None, near[0][1]), (None, near[0][2]),          # null ids only
            (None, near[1][0]), (7, near[1][1]), (None, near[1][2]),              # one id: it stays
            (3, near[2][0]), (3, near[2][1]), (9, near[2][2]),                    # the smallest id twice
            (2, near[3][0]), (5, near[3][1]),                                     # 5 loses here
            (5, prose(rng, 60)), (None, prose(rng, 60)),                          # and stands elsewhere
            (5, ""), (5, None), (None, " "), (None, None)]                        # without shingles
    docs = spark.createDataFrame([(i, t, n, 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int, place int").coalesce(1)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["row"] for r in kept.collect()) == [0, 4, 6, 9, 11, 12, 13, 14, 15, 16]


def brute_vectors(rows):
    links = []
    for (i, p, x), (j, q, y) in combinations(rows, 2):
        if p is None or p != q or not near_vectors.usable(x) or not near_vectors.usable(y) or len(x) != len(y):
            continue
        a, b = (np.array(v, float) / np.abs(v).max() for v in (x, y))
        if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= near_vectors.COSINE:
            links.append((i, j))
    return links


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 40)
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        centre = rng.normal(size=8)
        rows += [(len(rows) + j, int(k % 2), (centre + 0.25 * rng.normal(size=8)).tolist()) for j in range(12)]
    rows += [(len(rows) + j, 1, rows[0][2]) for j in range(5)]
    odd = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1e300] * 8, [1e-300] * 8, [1.0] * 3]
    rows += [(len(rows) + j, 1, v) for j, v in enumerate(odd)] + [(900, None, rows[0][2]), (901, None, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    links = brute_vectors(rows)
    number = Counter(x for e in links for x in e)
    want = components([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in near_vectors.near_groups(df).collect()}
    for i in want:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (number[i], want[i], want[i] == i)
    assert near_vectors.near_groups(df.limit(0)).count() == 0


def check_vectors(spark, rows, kind="double"):
    links = brute_vectors(rows)
    number = Counter(x for e in links for x in e)
    want = components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, f"vec_id long, label string, embedding array<{kind}>")
    got = {r["vec_id"]: r for r in near_vectors.near_groups(df.repartition(3)).collect()}
    assert len(links) and len(got) == len(rows)
    for i in want:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (number[i], want[i], want[i] == i)


def test_near_vectors_in_many_files(spark, monkeypatch):
    for name, value in {"CELL": 30, "GROUP": 24, "STRIP": 2, "SAMPLE": 200}.items():
        monkeypatch.setattr(near_vectors, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(24):
        centre = rng.normal(size=12)
        rows += [(len(rows) + j, "ab"[k % 2], (centre + 0.3 * rng.normal(size=12)).astype("f4").tolist()) for j in range(10)]
    rows += [(len(rows) + j, "a", (np.ones(12) + 0.05 * rng.normal(size=12)).astype("f4").tolist()) for j in range(60)]
    rows += [(len(rows) + j, "b", rng.normal(size=5).astype("f4").tolist()) for j in range(30)]
    rows += [(len(rows) + j, "a", rows[7 * j][2]) for j in range(20)] + [(9_000 + j, "b", rows[0][2]) for j in range(9)]
    rows += [(10_000 + j, f"alone {j}", rng.normal(size=12).astype("f4").tolist()) for j in range(5)]
    check_vectors(spark, rows, "float")
    check_vectors(spark, [(i, p, [1e200 * x for x in v]) for i, p, v in rows[::2]])


def test_near_vectors_store_each_vertex_once(spark, monkeypatch):
    """What is stored follows the vectors, not the pairs of cells that may hold a link."""
    monkeypatch.setattr(near_vectors, "CELL", 40)
    rng = np.random.default_rng(6)
    rows = [(j, j % 2, v) for j, v in enumerate(rng.normal(size=(2_000, 32)).tolist())]
    before = scratch_folders(spark)
    df = spark.createDataFrame([*rows, *((9_000 + j, 0, rows[0][2]) for j in range(500))],
                               "vec_id long, label int, embedding array<double>")
    assert near_vectors.near_groups(df).where("not kept").count() == 500
    stored = scratch_folders(spark) - before
    most = max(spark.read.parquet(path).count() for path in stored)
    assert most <= len(rows) + 500
    files = [os.path.join(d, f) for path in stored for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert sum(map(os.path.getsize, files)) < 2 * 8 * 32 * len(rows)


def scratch_folders(spark):
    root = f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/lakehook"
    return {os.path.join(root, x) for x in os.listdir(root)} if os.path.isdir(root) else set()


def test_near_vectors_cells_of_copies():
    """Equal vectors have one cell, wherever they stand in a batch."""
    rng = np.random.default_rng(7)
    centres = near_vectors.unit(rng.normal(size=(50, 33)))
    vectors = rng.normal(size=(700, 33))
    vectors[::7] = vectors[0]
    want = near_vectors._home(vectors, centres)
    assert len(set(want[::7])) == 1 and len(set(want)) > 30
    for n in (1, 2, 13, 250):
        assert (np.concatenate([near_vectors._home(vectors[s:s + n], centres) for s in range(0, 700, n)]) == want).all()
    assert (near_vectors._home(vectors * 2.0**-700, centres) == want).all()


def test_near_vectors_compared_by_blocks(monkeypatch):
    """Links across blocks, cells and products, sparse and dense, with weights."""
    for name, value in {"BLOCK": 16, "SMALL": 4, "STEP": 5, "TILE": (6, 10)}.items():
        monkeypatch.setattr(near_vectors, name, value)
    rng = np.random.default_rng(8)
    spots = rng.normal(size=(30, 10))
    vectors = near_vectors.unit(np.concatenate([
        (spots[:, None] + 0.3 * rng.normal(size=(30, 8, 10))).reshape(-1, 10), rng.normal(size=(150, 10)),
        spots[0] + 0.1 * rng.normal(size=(60, 10))]))
    centres = near_vectors.spherical_kmeans(vectors, 12)
    for axes in (np.eye(10)[:, :3], np.eye(10), near_vectors.leading_axes(vectors, near_vectors.COSINE)):
        cell = near_vectors._home(vectors, centres)
        cell[::9] = rng.integers(0, 12, len(cell[::9]))  # no link may hang on the choice of cells
        weight = rng.integers(1, 5, len(vectors)).astype(float)
        sides = []
        for at in (np.arange(0, len(vectors), 2), np.arange(1, len(vectors), 2)):
            at = at[np.argsort(cell[at], kind="stable")]
            sides.append(near_vectors.Rows(at, at, weight[at], cell[at], vectors[at], near_vectors._upper(vectors[at], axes)))
        one, two = sides
        for a, b, same in ((one, two, False), (one, one, True), (two, two, True)):
            linked = a.unit @ b.unit.T >= near_vectors.COSINE
            if same:
                np.fill_diagonal(linked, False)
            got, root = near_vectors._compare(a, b, same, centres, near_vectors.COSINE)
            here, there = linked @ b.weight, linked.T @ a.weight
            assert got.tolist() == (here if same else np.concatenate([here, there])).tolist() and got.any()
            pairs = [(i, j + (0 if same else len(a.v))) for i, j in np.argwhere(linked).tolist()]
            assert root.tolist() == list(components(range(len(got)), pairs).values())
