"""Quality classifier with supervised subword embeddings.

A text's features are hashed into ``BUCKETS`` learned vectors: its words and the
character n-grams of every word, and the shapes of words (case, punctuation
around them) with those of neighbouring words and whether a word repeats the one
before. Each of the two groups is averaged over the text, the averages are
added, and a softmax layer gives the probabilities of both labels. Vectors and
layer are trained together by stochastic gradient descent in numpy.

Fitting uses a bounded sample: at most ``SAMPLE_ROWS`` labelled documents, those
with the smallest hash of their id; its features (at most BUCKETS a document)
come to the driver. Scoring reads every text whole in one pass without a shuffle:
the model is linear in the averages, so a task needs one number per bucket (the
``2 * BUCKETS * 4`` bytes that are broadcast) and remembers the sums of words.

Defined results: null and empty texts get the score of the bias alone. Labels
that are null or not 0 or 1, and labels without a document, are ignored; of
labels for one id that differ, the smaller counts. Without labels of both
kinds every score is that of the only kind, or 0.5 without any. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakehook.llm.common import Remembered, prepare_workers, table

BUCKETS = 1 << 16
DIMENSIONS = 12
NGRAMS = (3, 4)
SAMPLE_ROWS = 6_000
EPOCHS = 3
RATE = 0.5
THRESHOLD = 0.3
CACHE_WORDS = 150_000
SLICE_ROWS = 512

_CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Case of a word's letters with up to two signs before and three after them."""
    before, core, after = ("", word, "") if word.isalnum() else _CORE.match(word).groups()
    if not core:
        case = ""
    elif not core.isalpha():
        case = "0" if core.isdigit() else "x"
    elif core.islower():
        case = "a"
    elif core.isupper():
        case = "A" if len(core) == 1 else "AA"
    else:
        case = "Aa" if core[1:].islower() else "aA"
    return before[:2] + case + after[:3]


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (values.astype(np.uint64) + np.uint64(salt)) * _MULTIPLY
        h = (h ^ (h >> np.uint64(31))) * _MULTIPLY
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, bucket) of the words and their character n-grams."""
    coded = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    text = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(coded)), sizes)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))
    owners, buckets = [], []
    h = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(NGRAMS)):
            h[:len(text) - k] = h[:len(text) - k] * np.uint64(1_000_003) + text[k:] + np.uint64(1)
            if k + 1 in NGRAMS:
                ok = room >= k + 1
                owners.append(owner[ok])
                buckets.append(_hash(h[ok], k))
        # the whole word: its bytes at their places, summed
        place = (np.arange(len(text)) - np.repeat(ends - sizes, sizes)).astype(np.uint64) + np.uint64(1)
        mixed = (text + np.uint64(257) * place) * _MULTIPLY
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLY
        whole = np.add.reduceat(mixed, ends - sizes)
    owners.append(np.arange(len(coded)))
    buckets.append(_hash(whole, 99))
    return np.concatenate(owners), np.concatenate(buckets)


def shape_code(word: str) -> int:
    """A shape as a number that is the same in every process."""
    return int.from_bytes(shape(word).encode()[:7], "little")


def pair_features(words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Buckets of word shapes, neighbouring shapes, and repeats; ``words`` numbers them."""
    with np.errstate(over="ignore"):
        pairs = shapes[:-1] * np.uint64(31) + shapes[1:]
    repeats = (words[:-1] == words[1:]).astype(np.uint64)
    return np.concatenate([_hash(shapes, 7), _hash(pairs, 11), _hash(repeats, 13)])


@dataclass
class Model:
    """One number per bucket and group: what it adds to the log odds of label 1."""

    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = Remembered(CACHE_WORDS)

    def _learn(self, words) -> None:
        fresh = self.words.unknown(words)
        if fresh:
            owner, bucket = word_features(fresh)
            total = np.bincount(owner, self.model.weights[bucket], len(fresh))
            count = np.bincount(owner, minlength=len(fresh))
            self.words.update(zip(fresh, zip(total.tolist(), count.tolist(), map(shape_code, fresh))))

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of label 1 for each text."""
        split = [t.split() for t in texts]
        known = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        self._learn(known)
        facts = [self.words[w] for w in known]
        total = np.array([f[0] for f in facts])
        count = np.array([f[1] for f in facts], np.int64)
        shapes = np.array([f[2] for f in facts], np.uint64)
        out = []
        for words in split:
            odds = self.model.bias
            if words:
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                odds += total[ids].sum() / count[ids].sum()
                odds += self.model.weights[pair_features(ids, shapes[ids])].mean()
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        return out


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in the sum of both averages."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    owner, bucket = word_features(list(known))
    times = np.bincount(ids, minlength=len(known))[owner].astype(np.float64)
    pairs = pair_features(ids, np.array([shape_code(w) for w in known], np.uint64)[ids])
    weight = np.concatenate([times / times.sum(), np.full(len(pairs), 1 / len(pairs))])
    buckets, inverse = np.unique(np.concatenate([bucket, pairs]), return_inverse=True)
    return buckets, np.bincount(inverse, weight).astype(np.float32)


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> Model:
    """Vectors and softmax layer by stochastic gradient descent."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else math.log(share / (1 - share)))
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    bias = np.array([math.log(1 - share), math.log(share)], np.float32)
    steps, step = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(labels)).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            f, w = features[k], weights[k][:, None]
            hidden = (vectors[f] * w).sum(axis=0)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            vectors[f] -= (rate * 20 * w) * back
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def remainder(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fifth."""
    prepare_workers(docs.sparkSession)
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(key) != 0))
              .groupBy(key).agg(F.min(label).cast("int").alias("label"))
              .orderBy(F.xxhash64(key), key).limit(sample_rows)
              .select(F.col(key).alias("id"), "label"))
    rows = (docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
            .join(F.broadcast(chosen), "id").select("id", "text", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f.astype("<i4").tobytes() for f, _ in got], pa.binary()),
                 pa.array([w.astype("<f4").tobytes() for _, w in got], pa.binary())],
                names=["id", "label", "buckets", "weights"])

    kind = chosen.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, label int, buckets binary, weights binary").toPandas()
    got = got.sort_values(["id", "buckets"]).reset_index(drop=True)
    some = got["buckets"].str.len() > 0
    return fit([np.frombuffer(b, "<i4") for b in got["buckets"][some]],
               [np.frombuffer(w, "<f4") for w in got["weights"][some]], got["label"][some].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability of label 1 of every whole text."""
    if into in docs.columns:
        raise ValueError(f"the table has a column {into}")
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                got = scorer.scores([str(t) if t is not None else "" for t in part.column(at).to_pylist()])
                yield part.append_column(into, pa.array(got, pa.float64()))

    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without those predicted to have label 0; columns as given."""
    into = "quality_score"
    while into in docs.columns:
        into += "_"
    return score(docs, model, text, into).where(F.col(into) >= THRESHOLD).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
