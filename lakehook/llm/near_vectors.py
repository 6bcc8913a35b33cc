"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors link when their labels are equal and not null and their cosine, in
double precision, is at least ``COSINE``. Equal vectors of a label are one
vertex with a count, so any number of copies costs one row. Centroids are fitted
by spherical k-means on at most ``SAMPLE`` vectors (those with the smallest digest
of their content), about one centroid per ``CELL`` vertices of a label and at most
``CENTROIDS``; every vertex is assigned.

Each vertex is stored once, in files of about ``GROUP`` rows in order of label and
cell. A task takes pairs of files that share a label, reads them, and compares their
blocks (a cell's rows, at most ``BLOCK``). Two cells compare only the rows near their
border:

    linked unit vectors x, y are at most d = sqrt(2 - 2 * COSINE) apart, so if they
    stand in cells c and h, then  (x.c - x.h) + (y.h - y.c) <= d * |c - h|

so no link is lost at a cell's border. Products are taken of the first coordinates
in the sample's principal axes, and what is left of two unit vectors adds the product
of its lengths at most: pairs that this bound leaves are computed in full, and the
result is exact. What is stored grows with the vertices, not with the pairs, and a
label or a cell with a third of all rows is many tasks. A task gives a link count for
each of its rows and the edges of a spanning forest of its links, never the pairs.
Edges become components by star contraction; the smallest id of a component is kept.

Defined results: null labels, null, empty or zero vectors, and vectors with null
or non-finite parts link with nothing and stand alone; so do vectors of unequal
length. Rows that repeat an id are each counted; a null id stays null and links
like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import connected_components, materialise, prepare_workers, table
from lakehook.session import scratch_path
from lakehook.sources.storage import open_store

COSINE = 0.93
SAMPLE = 20_000
CELL = 2_000
CENTROIDS = 1_024
ROUNDS = 8
BLOCK = 2_048
# A file holds about so many rows, fewer of long vectors, and a task up to STRIP files
# of either side; cells of fewer than SMALL rows of a file share a block.
GROUP = 16_384
GROUP_BYTES = 16 << 20
HELD_BYTES = 16 << 20
STRIP = 8
SMALL = 256
# Rows of a cell that are compared with as many of another cell's, nearest border first.
STEP = 256
# Rows and columns of one product: it stays in a core's cache. Beyond DENSE of its pairs
# it is computed again in full.
TILE = (512, 1_024)
DENSE = 0.03


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and bool(np.isfinite(v := np.array(vector, float)).all()) and bool(v.any())


def unit(vectors: np.ndarray) -> np.ndarray:
    # divided by the largest part first: squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell takes the vector worst served."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        own, most = map(np.concatenate, zip(*(  # in parts: the driver never holds all products
            ((dots := vectors[s:s + 1024] @ centres.T).argmax(axis=1), dots.max(axis=1))
            for s in range(0, len(vectors), 1024))))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < 1e-12)
        sums[empty] = vectors[np.argsort(most)[:len(empty)]]
        norms[empty] = 1
        centres = sums / norms[:, None]
    return centres


def leading_axes(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """As many principal axes of unit vectors as make the bound of ``_upper`` cheapest."""
    n = vectors.shape[1]
    axes = np.linalg.eigh(np.cov(vectors, rowvar=False, bias=True).reshape(n, n))[1][:, ::-1]
    some = np.random.default_rng(0).permutation(len(vectors))[:2_000]
    left, right = vectors[some[::2]], vectors[some[1::2]]
    best, least = n, math.inf
    for k in sorted({k for k in (4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512) if k < n} | {n}):
        if not len(right):
            break
        over = (_upper(left, axes[:, :k]) @ _upper(right, axes[:, :k]).T >= cosine).mean()
        # nanoseconds a pair: the product by its length, and a pair that is left
        cost = 0.8 + 0.037 * k + (1_000 + 8 * n) * over
        if cost < least:
            best, least = k, cost
    return np.ascontiguousarray(axes[:, :best])


def _upper(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows whose product is no less than the cosine: coordinates, and the length of the rest."""
    z = units @ axes
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", z, z)))
    return np.column_stack([z, rest]).astype("f4")


def _vertices(batches: Iterator[pa.RecordBatch], part: np.dtype, below: int | None = None) -> Iterator[tuple]:
    """(ids, labels, vertices, vectors) of batches of id, label and vector: a vertex is the
    digest of label and vector, None if unusable or, with ``below``, if its first eight
    bytes are no less."""
    for batch in batches:
        column = batch.column(2)
        labels = batch.column(1).to_pylist()
        start = column.offsets.to_numpy()
        lengths = np.diff(start) * np.asarray(column.is_valid()) * np.asarray(batch.column(1).is_valid())
        # null parts become NaN; -0.0 and 0.0 are equal
        flat = column.values.to_numpy(zero_copy_only=False).astype(part) + part.type(0)
        vertices: list = [None] * len(labels)
        vectors: list = [None] * len(labels)
        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == n)
            some = flat[start[at][:, None] + np.arange(n)]
            good = np.isfinite(some).all(axis=1) & some.any(axis=1)
            for k, v in zip(at[good].tolist(), some[good]):
                raw = v.tobytes()
                digest = xxhash.xxh3_128_digest(f"{labels[k]}\0".encode() + raw)
                if below is None or int.from_bytes(digest[:8], "big") < below:
                    vertices[k], vectors[k] = digest, raw
        yield batch.column(0), labels, vertices, vectors


def _home(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector (any length), about the one of the nearest centre.

    Whole numbers whose products and sums single precision holds: equal vectors get one
    cell in whatever batch and on whatever machine they are."""
    scale = 2**13 // math.sqrt(vectors.shape[1])
    grid = np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * scale).astype("f4")
    return (grid @ np.rint(centres.T * 2**10).astype("f4")).argmax(axis=1)


def _part(rows: DataFrame) -> np.dtype:
    return np.dtype("<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8")


class Rows(NamedTuple):
    """Vertices of one label and length, by cell."""

    v: np.ndarray
    vertex: np.ndarray
    weight: np.ndarray
    cell: np.ndarray
    unit: np.ndarray
    upper: np.ndarray


class Fit(NamedTuple):
    """What was fitted for one length of vectors."""

    centres: np.ndarray
    axes: np.ndarray

    @classmethod
    def none(cls, n: int) -> Fit:
        return cls(np.zeros((1, n)), np.eye(n))


def _read(store, path: str, part: np.dtype, fits: dict[int, Fit]) -> dict[tuple[str, int], Rows]:
    with store.open_input_file(path) as file:
        got = pq.ParquetFile(file).read(["v", "vertex", "copies", "label", "n", "cell", "vector"]).combine_chunks()
    v, copies, length, cell = (got[c].to_numpy() for c in ("v", "copies", "n", "cell"))
    names = pa.array(got["label"].to_pylist(), pa.string()).dictionary_encode()
    label, names, raw = names.indices.to_numpy(), names.dictionary.to_pylist(), got["vector"].to_pylist()
    vertex = np.array(got["vertex"].to_pylist(), object)
    out = {}
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        at = at[np.lexsort((cell[at], label[at]))]
        units = unit(np.frombuffer(b"".join([raw[k] for k in at.tolist()]), part).reshape(-1, n).astype("f8"))
        upper = _upper(units, fits.get(n, Fit.none(n)).axes)
        ends = np.append(np.flatnonzero(np.diff(label[at])) + 1, len(at)).tolist()
        for s, e in zip([0, *ends], ends):
            some = at[s:e]
            out[names[label[some[0]]], n] = Rows(v[some], vertex[some], copies[some].astype("f8"), cell[some], units[s:e], upper[s:e])
    return out


def _blocks(cell: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, cell) of blocks; cell -1: several small ones."""
    ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell)).tolist()
    runs: list[tuple[int, int, int]] = []
    for s, e in zip([0, *ends], ends):
        if e - s >= SMALL or not runs or runs[-1][2] >= 0 or runs[-1][1] - runs[-1][0] >= SMALL:
            runs.append((s, e, int(cell[s]) if e - s >= SMALL else -1))
        else:
            runs[-1] = (runs[-1][0], e, -1)
    return [(k, min(k + BLOCK, e), c) for s, e, c in runs for k in range(s, e, BLOCK)]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component, after links (i, j)."""
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        i, j = i[apart], j[apart]
        if len(i):
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


class _Links:
    """Weights of the links of a's rows, then b's, and the smallest index that each is
    linked to; ``same``: b is a."""

    def __init__(self, a: Rows, b: Rows, same: bool, cosine: float):
        self.a, self.b, self.cosine = a, b, cosine
        self.below = 0 if same else len(a.v)
        self.size = len(a.v) if same else len(a.v) + len(b.v)
        self.least = np.float32(cosine - (a.upper.shape[1] + 16) * 1.2e-7)
        self.weights, self.root = np.zeros(self.size), np.arange(self.size)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.waiting, self.batch = 0, max(1, (1 << 21) // a.unit.shape[1])

    def product(self, rows: np.ndarray, others: np.ndarray, diagonal: bool = False) -> None:
        """Find the links of ``rows`` with ``others``; ``diagonal``: both are one block."""
        right = self.b.upper[others]
        for r in range(0, len(rows), TILE[0]):
            some = rows[r:r + TILE[0]]
            left = self.a.upper[some]
            for t in range(r if diagonal else 0, len(others), TILE[1]):
                self.tile(some, others[t:t + TILE[1]], left @ right[t:t + TILE[1]].T >= self.least, diagonal)

    def tile(self, rows: np.ndarray, others: np.ndarray, over: np.ndarray, diagonal: bool) -> None:
        hits = _set(over)
        if not len(hits):
            return
        dense = len(hits) > DENSE * over.size
        if dense:
            over &= self.a.unit[rows] @ self.b.unit[others].T >= self.cosine
            hits = _set(over)
        i, j = rows[hits // len(others)], others[hits % len(others)]
        if diagonal:
            i, j = i[i < j], j[i < j]
        if dense:
            self.add(i, j)
        else:
            self.left.append(i)
            self.right.append(j)
            self.waiting += len(i)
            if self.waiting >= self.batch:
                self.settle()

    def settle(self) -> None:
        """Compute the cosines of the pairs that wait."""
        if self.waiting:
            i, j = np.concatenate(self.left), np.concatenate(self.right)
            good = np.concatenate([np.einsum("ij,ij->i", self.a.unit[i[k:k + self.batch]], self.b.unit[j[k:k + self.batch]])
                                   for k in range(0, len(i), self.batch)]) >= self.cosine
            self.left, self.right, self.waiting = [], [], 0
            self.add(i[good], j[good])

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.weights, i, self.b.weight[j])
        np.add.at(self.weights, j + self.below, self.a.weight[i])
        self.root = _joined(self.root, i, j + self.below)


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat indices of what is set, seldom much: eight at a time are passed over."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    if not len(words) and not flat[whole:].any():
        return words
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])])


def _compare(a: Rows, b: Rows, same: bool, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the links and smallest linked index of a's rows, then b's; ``same``:
    b is a, and each pair is taken once."""
    found = _Links(a, b, same, cosine)
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    ours, theirs = _blocks(a.cell), _blocks(b.cell)
    cells = [sorted({c for _, _, c in x if c >= 0}) for x in (ours, theirs)]
    # of each row: the product with its own centre, less that with each of the other side's
    less_a = np.einsum("ij,ij->i", a.unit, centres[a.cell]) - centres[cells[1]] @ a.unit.T
    less_b = np.einsum("ij,ij->i", b.unit, centres[b.cell]) - centres[cells[0]] @ b.unit.T
    apart = np.linalg.norm(centres[cells[0]][:, None] - centres[cells[1]][None], axis=2) * reach + 1e-9
    for k, (s, e, c) in enumerate(ours):
        whole = []
        for t, u, h in theirs[k if same else 0:]:
            if c < 0 or h < 0 or c == h:
                whole.append((t, u))
                continue
            p, q = cells[0].index(c), cells[1].index(h)
            left, right, most = less_a[q, s:e], less_b[p, t:u], apart[p, q]
            rows = np.flatnonzero(left <= most - right.min())
            if not len(rows):
                continue
            left = left[rows]
            others = np.flatnonzero(right <= most - left.min())
            right = right[others]
            if len(rows) > STEP and len(others):
                by, to = np.argsort(left), np.argsort(right)
                rows, left, others, right = rows[by], left[by], others[to], right[to]
            for r in range(0, len(rows), STEP):
                if n := int(np.searchsorted(right, most - left[r], "right")) if len(rows) > STEP else len(others):
                    found.product(s + rows[r:r + STEP], t + others[:n])
        if same:
            found.product(np.arange(s, e), np.arange(s, e), True)
            whole = [x for x in whole if x != (s, e)]
        if whole:
            found.product(np.arange(s, e), np.concatenate([np.arange(t, u) for t, u in whole]))
    found.settle()
    return found.weights, found.root


def _found(pairs: list[tuple[str, str]], read, fits: dict[int, Fit], cosine: float) -> pa.RecordBatch:
    """(a, b, links, vertex) of pairs of files: link counts (b null), and the forest's
    edges (links and vertex null)."""
    links: dict[tuple, np.ndarray] = {}
    ids: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    held = {y: read(y) for y in sorted({y for _, y in pairs})}  # a strip of files
    edges, last, one = [], None, {}
    for x, y in sorted(pairs):
        if x != last:
            last, one = x, held[x] if x in held else read(x)
        two = held[y]
        for key in one.keys() & two.keys():
            a, b = one[key], two[key]
            got, root = _compare(a, b, x == y, fits.get(key[1], Fit.none(key[1])).centres, cosine)
            if not got.any():
                continue
            for name, rows, some in ((x, a, got[:len(a.v)]), *([] if x == y else [(y, b, got[len(a.v):])])):
                ids[name, key] = rows.v, rows.vertex
                links[name, key] = links[name, key] + some if (name, key) in links else some
            v = a.v if x == y else np.concatenate([a.v, b.v])
            moved = np.flatnonzero(root != np.arange(len(root)))
            edges.append((v[moved], v[root[moved]]))
    return _spanning(links, ids, edges)


def _spanning(links: dict, ids: dict, edges: list) -> pa.RecordBatch:
    """Link counts, and edges cut down to one for each vertex but the smallest of a component."""
    empty = np.empty(0, np.int64)
    counted = [(*(x[rows] for x in ids[k]), n[rows].astype(np.int64)) for k, n in links.items() if len(rows := np.flatnonzero(n))]
    a, vertex, n = (np.concatenate(x) for x in zip(*counted)) if counted else (empty, empty, empty)
    p, q = (np.concatenate(x) for x in zip(*edges)) if edges else (empty, empty)
    known, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    root = _joined(np.arange(len(known)), at[:len(p)], at[len(p):])
    moved = np.flatnonzero(root != np.arange(len(root)))
    left, right = np.concatenate([a, known[moved]]), np.concatenate([n, known[root[moved]]])
    edge = np.arange(len(left)) >= len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(left), pa.array(right, mask=~edge), pa.array(right, mask=edge),
         pa.array([*vertex.tolist(), *[None] * len(moved)], pa.binary())], names=["a", "b", "links", "vertex"])


def near_groups(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                cosine: float = COSINE) -> DataFrame:
    """One row per row: key, n_links, component_id, kept."""
    spark = rows.sparkSession
    prepare_workers(spark)
    slots = spark.sparkContext.defaultParallelism
    rows = rows.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    if rows.schema["vector"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    part, kind = _part(rows), rows.schema["id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, vertices, _ in _vertices(batches, part):
            yield pa.RecordBatch.from_arrays([ids, pa.array(vertices, pa.binary())], names=["id", "vertex"])

    seen = materialise(rows.mapInArrow(digests, f"id {kind}, vertex binary"), "vectors")
    number = seen.agg(F.approx_count_distinct("vertex")).first()[0]
    # the sample: enough of the smallest digests, in a scan of their own
    below = (1 << 64) if number < SAMPLE else (1 << 64) * SAMPLE * 5 // (4 * number)

    def smallest_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, vertices, vectors in _vertices(batches, part, below):
            found = {d: v for d, v in zip(vertices, vectors) if d is not None}
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in (found, found.values())],
                                             names=["vertex", "vector"])

    sample = (rows.mapInArrow(smallest_digests, "vertex binary, vector binary").groupBy("vertex")
              .agg(F.first("vector").alias("vector")).orderBy("vertex").limit(SAMPLE).toPandas()["vector"])
    by_length: dict[int, list] = {}
    for raw in sample:
        by_length.setdefault(len(raw) // part.itemsize, []).append(np.frombuffer(raw, part).astype("f8"))
    # of the label that the usual row has
    total, squares = (rows.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
                      .agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first())
    cells = int(min(CENTROIDS, max(1, number * (squares or 0) / max(1, (total or 0) ** 2) // CELL)))
    fits = {}
    for n, vs in by_length.items():
        units = unit(np.stack(vs))
        fits[n] = Fit(spherical_kmeans(units, min(cells, len(vs))), leading_axes(units, cosine))
    shared = spark.sparkContext.broadcast(fits)

    def placed_rows(held: dict) -> pa.RecordBatch:
        labels, raws, counts = zip(*held.values())
        length = np.array([len(r) // part.itemsize for r in raws], np.int32)
        cell = np.zeros(len(raws), np.int32)
        for n in np.unique(length).tolist():
            centres, at = shared.value.get(n, Fit.none(n)).centres, np.flatnonzero(length == n)
            for s in range(0, len(at), 1024):
                some = at[s:s + 1024]
                cell[some] = _home(np.frombuffer(b"".join([raws[k] for k in some.tolist()]), part).reshape(-1, n).astype("f8"), centres)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(labels, pa.string()), pa.array(length), pa.array(cell),
             pa.array(counts, pa.int64()), pa.array(raws, pa.binary())],
            names=["vertex", "label", "n", "cell", "copies", "vector"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0  # copies meet before the shuffle as far as memory goes
        for _, labels, vertices, vectors in _vertices(batches, part):
            for label, vertex, raw in zip(labels, vertices, vectors):
                if vertex in held:
                    held[vertex][2] += 1
                elif vertex is not None:
                    held[vertex] = [label, raw, 1]
                    size += len(raw)
            if size >= HELD_BYTES:
                yield placed_rows(held)
                held, size = {}, 0
        if held:
            yield placed_rows(held)

    widest = max(by_length, default=1)
    each = max(1, min(GROUP, GROUP_BYTES // (8 * widest)))
    files = max(1, -(-number // each), min(slots, number // BLOCK))
    order = ["label", "n", "cell", "v", "vertex"]
    placed = (rows.mapInArrow(place, "vertex binary, label string, n int, cell int, copies long, vector binary")
              .withColumn("v", F.xxhash64("vertex")).repartitionByRange(files, *order).sortWithinPartitions(*order)
              .groupBy(*order).agg(F.sum("copies").alias("copies"), F.first("vector").alias("vector")))
    # each vector is stored here only; tasks read the files that they compare
    folder = scratch_path(spark, "llm", "vector-cells")
    placed.write.option("parquet.enable.dictionary", "false").parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    index = materialise(placed.select("label", "n", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
                        .distinct(), "vector-files")
    one, two = index.withColumnRenamed("file", "x"), index.withColumnRenamed("file", "y")
    place_of = lambda c: F.coalesce(F.regexp_extract(c, r"^part-(\d+)", 1).try_cast("int"), F.lit(0))
    strip = max(1, min(STRIP, math.isqrt(index.count() // (2 * slots))))
    tasks = materialise(
        one.join(two, ["label", "n"]).where("x <= y")
        .groupBy(F.floor(place_of("x") / strip).alias("p"), F.floor(place_of("y") / strip).alias("q"))
        .agg(F.collect_set(F.struct("x", "y")).alias("pairs")).select("pairs"), "vector-tasks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        read = lambda name: _read(store, f"{base}/{name}", part, shared.value)
        for batch in batches:
            for pairs in batch.column(0).to_pylist():
                yield _found([(p["x"], p["y"]) for p in pairs], read, shared.value, cosine)

    number = tasks.count()
    found = materialise(tasks.repartition(max(1, min(number, max(4 * slots, number // 4))))
                        .mapInArrow(compare, "a long, b long, links long, vertex binary"), "vector-links")
    links = found.where("b is null").groupBy("vertex").agg(F.first("a").alias("v"), F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"), "vectors")
    linked = links.join(groups.select(F.col("id").alias("v"), F.col("component_id").alias("component")), "v").drop("v")
    usual = seen.where("vertex is not null")
    firsts = usual.groupBy("vertex").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # stored, so that both sides of the joins with names and facts are plain shuffles,
    # in which a large component's or a common vector's rows can be split
    names = materialise(linked.join(firsts, "vertex").groupBy("component").agg(F.min("first").alias("smallest")), "vector-names")
    linked = linked.join(names, "component").select("vertex", "links", "component", "smallest")
    facts = materialise(firsts.join(linked, "vertex", "left").where("copies > 1 or component is not null").select(
        "vertex", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id")), "vector-facts")
    # a row without facts is the only one of its vector, and links with none
    good = usual.join(facts, "vertex", "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    rest = seen.where("vertex is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                               F.col("id").alias("component_id"))
    out = good.union(rest)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull())
                          ).withColumnRenamed("id", key)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links,
       min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id
"""
