"""Quality by nearest neighbours: broadcast labelled latent-semantic vectors, exact blocked cosines, weighted votes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The classifier is fitted on so many labelled rows at most, chosen by a hash of doc_id.
MAX_LABELLED = 4096
BUCKETS, RANK, NEIGHBOURS, SHARPNESS, SEED = 1024, 48, 25, 8.0, 7
_SHAPES = 128
_BLOCK = 512
#: The column that classify() adds.
SCORE = "quality_score"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN = re.compile(rb"[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")


def shape(word: bytes) -> bytes:
    """Letters become a or A, digits 0, bytes beyond ASCII a; repeats collapse; other signs stay."""
    out = bytearray()
    for c in word.translate(_CLASSES):
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out[:12])


_CLASSES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def features(text: bytes, cache: dict) -> np.ndarray:
    """Term weights of a whole text: hashed lower-cased words and hashed word shapes, each 1 + log of the count,
    each part of length one; and how the text repeats itself. An empty text has only the constant term."""
    import xxhash

    words = text.split()
    v = np.zeros(BUCKETS + _SHAPES + 8)
    if words:
        at = np.empty((len(words), 2), np.int64)
        for k, w in enumerate(words):
            got = cache.get(w)
            if got is None:
                if len(cache) > 500_000:
                    cache.clear()
                got = cache[w] = (xxhash.xxh32_intdigest(w.lower(), SEED) % BUCKETS, BUCKETS + xxhash.xxh32_intdigest(shape(w), SEED) % _SHAPES)
            at[k] = got
        counts = np.bincount(at.ravel(), minlength=len(v)).astype(float)
        v += np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)
        for a, b in ((0, BUCKETS), (BUCKETS, BUCKETS + _SHAPES)):
            v[a:b] /= max(np.linalg.norm(v[a:b]), 1e-12)
        n, lines = len(words), text.split(b"\n")
        v[-8:-1] = [len(set(words)) / n, len(set(lines)) / len(lines), sum(map(len, _RUN.findall(text))) / len(text), sum(w.isupper() for w in words) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, min(np.log1p(n) / 10, 1), sum(map(bytes.isalpha, words)) / n]
    v[-1] = 0.25
    return v


@dataclass
class Model:
    """Projection of term weights, labelled vectors of length one, their labels."""

    scale: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.scale) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest neighbours, each weighing exp(SHARPNESS * (cosine - 1)), with one neighbour's weight of prior."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        z, k = self.latent(x), min(NEIGHBOURS, len(self.labels))
        best, labels = None, None
        for i in range(0, len(self.labels), _BLOCK):
            c = z @ self.vectors[i : i + _BLOCK].T
            l = np.broadcast_to(self.labels[i : i + _BLOCK], c.shape)
            best, labels = (c, l) if best is None else (np.hstack([best, c]), np.hstack([labels, l]))
            if best.shape[1] > k:
                # Ties at the edge go to the earlier labelled row.
                at = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, labels = np.take_along_axis(best, at, 1), np.take_along_axis(labels, at, 1)
        w = np.exp(SHARPNESS * (best.astype(float) - 1))
        return ((w * labels).sum(1) + 0.05 * self.prior) / (w.sum(1) + 0.05)


def _svd(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, from the Gram matrix of terms (BUCKETS + a few wide)."""
    values, vectors = np.linalg.eigh(x.T @ x)
    keep = np.argsort(values)[::-1][:rank]
    return vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-12)]]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, label: str = "quality") -> Model:
    """Learns from documents with a label whose crc32(doc_id as text) mod 3 isn't 1; at most max_labelled of them.

    Rows without doc_id or label, and labels other than 0 and 1, teach nothing; of a document's repeated labels the
    smallest counts, of its repeated rows each. Only term weights of the bounded sample reach the driver.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labelled)
    known = common.cut(known)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            if b.num_rows:
                x = [features(t, cache).astype(np.float32).tobytes() for t in common.texts(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    # A document's rows may repeat without bound, so the sample is bounded once more.
    got = rows.select("doc_id", "text", "y").mapInArrow(work, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "x").limit(max_labelled).toArrow()
    width = BUCKETS + _SHAPES + 8
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, width).astype(float)
    y = got.column("y").to_numpy().astype(float)
    df = (x > 0).sum(0)
    scale = np.where(df > 0, np.log((len(x) + 1) / (df + 1)) + 0.3, 0.0)
    scale[-8:] = 1.5
    basis = _svd(x * scale, RANK) if len(x) else np.zeros((width, 1))
    model = Model(scale, basis, np.zeros((0, basis.shape[1])), y, (y.sum() + 1) / (len(y) + 2))
    model.vectors = model.latent(x)
    return model


def classify(docs: DataFrame, model: Model, score: str = SCORE) -> DataFrame:
    """The rows of docs (doc_id, text and whatever else) and score, the weighted vote for label 1, 0 to 1.

    A column of docs that has the name `score` is replaced. Each whole text is read once; null is empty, and a very long one
    is one text in memory. Each row gives a row. A model without labels scores the prior, 0.5.
    Labels, lang, source and doc_id are no inputs. The model is a few MB, bounded by MAX_LABELLED.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        at = names.index("text")
        for b in batches:
            scores = np.zeros(b.num_rows)
            held: list[np.ndarray] = []
            for k, t in enumerate(common.texts(b.column(at))):
                held.append(features(t, cache))
                if len(held) == 256 or k == b.num_rows - 1:
                    scores[k + 1 - len(held) : k + 1] = shared.value.score(np.array(held))
                    held = []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*names, score])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(work, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    scored = classify(docs, model).select("doc_id", F.col(SCORE).alias("score"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
