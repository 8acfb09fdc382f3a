"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its hashed features: character
n-grams of two lengths, n-grams of character classes, words, pairs of adjacent
words, and words repeated one after the other.  A softmax layer on the average
gives the class.  Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``SAMPLE_ROWS``).  As the
layer is linear, a trained model is folded into one integer weight per feature,
so scoring a text is a sum of table entries.

Null and empty texts have no features and get the model's bias alone; very long
texts are scored whole, in pieces.  An empty table gives no rows, repeated rows
get a row each.  Rows whose label is null are not learned from; with labels of
one class only, or none, the score is that share (0.5 without labels).  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_map
from .shingles import mixed, powers

#: Labelled rows learned from, at most: those with the smallest hash of their doc_id.
SAMPLE_ROWS = 2000
BITS = 13
DIMENSIONS = 16
_FAMILIES = ((1, 3), (2, 6), (3, 5))  # (family, length) of n-grams; family 2 is of character classes
_LONGEST = 6
_WORDS, _PAIRS = 4, 5  # families of words and of pairs of words
_TOGETHER = 1 << 20

_LETTER = (np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59B)) ** np.uint64(3)
_CLASS = np.arange(256, dtype=np.uint8)
for _first, _last, _to in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
    _CLASS[ord(_first) : ord(_last) + 1] = ord(_to)
_CLASS[0x80:] = ord("a")


def _grams(data: np.ndarray, n: int, family: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(data) - n + 1, family * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (between spaces and line ends), which depends on the order of its letters.

    Sums of letters times powers of an odd base, over all bytes at once; a
    word's part is divided by the power at its start, so that the hash is the
    same wherever the word stands.
    """
    space = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], space + 1]), np.concatenate([space, [len(data)]])
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    power, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * back[starts])


def _word_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words (or of 'repeated' when the word before is the same) and of the pairs of adjacent words."""
    h = word_hashes(data)
    shift = np.uint64(64 - BITS)
    bucket = (h >> shift).astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    with np.errstate(over="ignore"):
        pair = mixed(h[:-1] * np.uint64(3) + h[1:]) >> shift
    return np.where(again, (1 << BITS) - 1, bucket), pair.astype(np.int64)


def _features(text: str | None) -> list[np.ndarray]:
    """Buckets by family; each family has its own range."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return []
    shape = _CLASS[data]
    out = [_grams(shape if f == 2 else data, n, f).astype(np.int64) + ((f - 1) << BITS) for f, n in _FAMILIES]
    words, pairs = _word_features(data)
    return [*out, words + ((_WORDS - 1) << BITS), pairs + ((_PAIRS - 1) << BITS)]


SIZE = _PAIRS << BITS


@dataclass
class Model:
    """Integer weight of each feature (in 1/SCALE) and the bias of the log-odds of class 1."""

    weights: np.ndarray
    bias: float
    SCALE = 1 << 16

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1 for each whole text; the same whatever stands beside it."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total, count = 0, 0
            data = np.frombuffer((text or "").encode(), np.uint8)
            for at in range(0, len(data), _TOGETHER):  # long texts in pieces that overlap by the longest n-gram
                own = data[at : at + _TOGETHER + _LONGEST - 1]
                shape = _CLASS[own]
                for f, n in _FAMILIES:
                    starts = min(_TOGETHER, len(own) - n + 1)
                    if starts > 0:
                        total += int(self.weights[(f - 1) << BITS : f << BITS][_grams(shape if f == 2 else own, n, f)[:starts]].sum())
                        count += starts
            if len(data):
                for f, found in zip((_WORDS, _PAIRS), _word_features(data)):
                    total += int(self.weights[(f - 1) << BITS : f << BITS][found].sum())
                    count += len(found)
            out[i] = self.bias + total / self.SCALE / max(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their share."""
    found = _features(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    buckets, n = np.unique(np.concatenate(found), return_counts=True)
    return buckets, n / n.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 100.0, seed: int = 7) -> Model:
    """Softmax over averaged embeddings, by stochastic gradient descent."""
    share = labels.mean() if len(labels) else 0.5
    if not len(rows) or not 0 < share < 1:
        return Model(np.zeros(SIZE, np.int64), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (SIZE, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            used, inverse = np.unique(np.concatenate([rows[i][0] for i in own]).astype(np.int64), return_inverse=True)
            x = np.zeros((len(own), len(used)), np.float32)
            x[np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own]), inverse] = np.concatenate([rows[i][1] for i in own])
            mean = x @ vectors[used]
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[own]) / len(own)
            vectors[used] -= step * (x.T @ (error @ layer.T))
            layer -= 0.02 * step * (mean.T @ error)
            bias -= 0.02 * step * error.sum(0)
    folded = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(np.round(folded * Model.SCALE).astype(np.int64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels`` (doc_id, label), from at most ``limit`` of their documents.

    Each sampled text comes to the driver as its distinct features, at most
    SIZE of them however long it is, four bytes each (shares have 11 bits).
    """
    sample = labels.select(F.col("doc_id").alias("label_id"), F.col("label").cast("int").alias("label")).filter("label_id is not null and label in (0, 1)")
    sample = sample.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(limit)  # a proven bound: broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()), pa.array([s.astype("<f2").tobytes() for _, s in found], pa.binary())],
                names=["doc_id", "label", "buckets", "shares"],
            )

    got = chosen.transform(arrow_map, count, "doc_id long, label int, buckets binary, shares binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "buckets").limit(limit)
    got = got.toArrow()  # the features stay in its buffers
    rows = [(np.frombuffer(b.as_buffer(), "<u2"), np.frombuffer(s.as_buffer(), "<f2")) for b, s in zip(got["buckets"], got["shares"])]
    return train(rows, got["label"].to_numpy().astype(np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id and score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow_map, score, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(place).to_pylist()) >= least))

    return docs.transform(arrow_map, keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``labels.quality``, without the held-out fold."""
    seen = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    return fit(docs, seen)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and class."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, quality_model(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
