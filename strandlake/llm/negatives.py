"""Hard-negative mining: a ball tree for each partition, inner products bounded from both sides, branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .balltree import BallTree, Best

POSITIVES, NEGATIVES = 5, 10
#: A negative scores from LOW to HIGH per cent of its positive.
LOW, HIGH = 30, 90
#: Trees at least; bytes of a tree's vectors at about most (more vectors make more trees); bytes of trees that a task keeps
#: loaded, and of anchors that it holds, while it goes through all trees.
SHARDS, SHARD_BYTES, HELD_BYTES, ANCHOR_BYTES = 8, 256 << 20, 256 << 20, 16 << 20
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, embedding, label -> vec_id, label, key (floor(scale * component) as float64 bytes), of rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, x in enumerate(b.column(2)):
                if x.is_valid and not x.values.null_count:
                    with np.errstate(over="ignore"):
                        v = np.floor(np.array(x.values.to_numpy(zero_copy_only=False), float) * scale)
                    if np.isfinite(v).all():
                        at.append(i)
                        keys.append((v + 0.0).tobytes())
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(keys, pa.binary())], ["vec_id", "label", "key"])

    return rows.where("vec_id is not null and label is not null and e is not null").mapInArrow(work, "vec_id long, label long, key binary")


def _mine(anchors: tuple[np.ndarray, np.ndarray, np.ndarray], trees, positives: int, negatives: int) -> pa.RecordBatch:
    """All triples of anchors of one width. trees() goes through the trees of that width."""
    own, labels, q = anchors
    any_low, any_high = np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), np.iinfo(np.int64).max)
    pos = Best(q, own, labels, True, any_low, any_high, positives)
    for t in trees():
        pos.search(t)
    a, p = np.nonzero(np.arange(positives) < pos.filled[:, None])
    score = pos.scores[a, p]
    # Positives of one score share their negatives.
    key, back = np.unique(np.stack([a, score], 1), axis=0, return_inverse=True)
    back = back.ravel()
    wide = [int(s) for s in key[:, 1]]
    low, high = (np.array(v, np.int64) for v in ([-((-LOW * s) // 100) for s in wide], [HIGH * s // 100 for s in wide]))
    some = np.flatnonzero(low <= high)
    neg = Best(q[key[some, 0]], own[key[some, 0]], labels[key[some, 0]], False, low[some], high[some], negatives)
    for t in trees():
        neg.search(t)
    place = np.full(len(key), -1)
    place[some] = np.arange(len(some))
    n = np.where(place[back] >= 0, neg.filled[place[back]], 0) if len(some) else np.zeros(len(back), np.int64)
    row = np.repeat(np.arange(len(a)), n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    of = place[back[row]]
    cols = [own[a[row]], pos.ids[a[row], p[row]], (rank + 1).astype(np.int32), neg.ids[of, rank], score[row], neg.scores[of, rank]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _OUT.split(", ")])


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, shards: int = SHARDS) -> DataFrame:
    """vec_id, label, key (see integer_vectors) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor; higher scores come first, ties by vec_id. An anchor's
    positives are the first `positives` other rows of its label; for each, the first `negatives` rows of other labels whose score
    is from LOW to HIGH per cent of the positive's. Other rows are rows with another vec_id.

    Rows are dealt to shards by hash; a task builds the ball tree of its shard and writes it to the shared folder. A task
    of anchors goes through all trees, a tree at a time, and carries the best rows found so far on to the next one: a node
    is left out if its ball's largest product lies under the window or strictly beneath the current kth (or is as good,
    with larger ids only), or its least one above the window, or its labels don't fit. So results are exact. Copies, however many,
    are nodes of radius zero in the order of their ids, so ties are settled without looking at all of them. No list grows
    beyond the best k of a query; nothing is collected but a short row a tree.

    Rows that repeat a vec_id are rows of their own, anchors too. Vectors of different length have no score with each
    other; empty vectors score zero. Products beyond 2**62 count as that. An anchor without positives, or without rows in
    the window, gives no rows; an empty table gives an empty one. Other columns are ignored. Anchors times trees is the work
    that the method asks for: it grows with both.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    rows = common.cut(rows.select("vec_id", "label", "key"))
    shards = max(shards, -(-(rows.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // SHARD_BYTES))
    folder = common.scratch(spark, "balls")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        groups: dict[tuple[int, int], list] = {}
        for b in batches:
            for s, v, l, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.setdefault((s, len(k)), []).append((v, l, k))
        store, root = fs.FileSystem.from_uri(folder)
        done = []
        for (s, width), got in sorted(groups.items()):
            got.sort()  # a task that runs again writes the same bytes under the same name
            x = np.frombuffer(b"".join(k for *_, k in got), float).reshape(len(got), width // 8)
            data = BallTree(x, np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)).dump()
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{s}-{width}", compression=None) as f:
                f.write(data)
            done.append((f"{folder}/{s}-{width}", width, len(data)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "width", "size"])

    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "key"), F.lit(shards)).alias("s"), "vec_id", "label", "key").repartitionById(shards, F.col("s").cast("int"))
    built = common.cut(dealt.mapInArrow(build, "path string, width long, size long"))
    found = sorted((r["path"], r["width"], r["size"]) for r in built.collect())  # one short row a tree

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: dict[str, BallTree] = {}

        def trees(width: int) -> Iterator[BallTree]:
            room = HELD_BYTES
            for path, w, size in found:
                if w == width:
                    t = held.get(path)
                    if t is None:
                        store, name = fs.FileSystem.from_uri(path)
                        with store.open_input_stream(name, compression=None) as f:
                            t = BallTree.load(f.read())
                    room -= size
                    if room >= 0:
                        held[path] = t
                    yield t

        def mined(got: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for width in sorted({len(k) for *_, k in got}):
                held.clear()
                some = [g for g in got if len(g[2]) == width]
                q = np.frombuffer(b"".join(g[2] for g in some), float).reshape(len(some), width // 8)
                yield _mine((np.array([g[0] for g in some], np.int64), np.array([g[1] for g in some], np.int64), q), lambda w=width: trees(w), positives, negatives)

        got: list[tuple[int, int, bytes]] = []
        size = 0
        for b in batches:
            got += zip(*(c.to_pylist() for c in b.columns), strict=True)
            size += b.column(2).nbytes
            if size >= ANCHOR_BYTES:
                yield from mined(got)
                got, size = [], 0
        if got:
            yield from mined(got)

    anchors = rows.where(is_anchor).repartition(max(12, spark.sparkContext.defaultParallelism), F.xxhash64("vec_id", "key")).select("vec_id", "label", "key")
    out = common.cut(anchors.mapInArrow(search, _OUT))
    common.remove(spark, folder)
    return out


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = {
    "op12_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
"""
}
QUERIES = {"op12_negatives": op12_negatives}
