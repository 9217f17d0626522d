"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near

WORDS, MAX_BITS, SEED = 4, 4, 42
#: A bucket with more fingerprints than this is cut into chunks, which meet chunk by chunk.
CHUNK = 4096
_ROWS = 4096


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of `words` lower-cased words, repeats included; fewer words: the whole sequence; none: nothing."""
    ws = text.lower().split()
    if not ws:
        return []
    if len(ws) <= words:
        return [b" ".join(ws)]
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))) + np.arange(len(ws))
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set if over half of the shingles' hashes have it; no shingle gives zero."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles(text, words)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), _ROWS):
        counts += np.unpackbits(h[k : k + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text -> doc_id, fp (the fingerprint as a signed long), for each row."""
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in common.texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(work, "doc_id long, fp long")


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Into how many blocks 64 bits are cut so that a bucket of shared blocks gets few of n unrelated fingerprints.

    Of b blocks at least b - max_bits are equal in any pair within max_bits: with more blocks the keys hold more bits
    and there are more keys.
    """
    b = max_bits + 2
    while b < max_bits + 5 and n > 2 ** (64 * (b - max_bits) / b - 2):
        b += 1
    return b


def block_keys(fp: Column, blocks: int, max_bits: int = MAX_BITS) -> list[tuple[int, Column]]:
    """A number and the bits of each choice of blocks - max_bits blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    full = (1 << 64) - 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [((full >> (64 - (cuts[k + 1] - cuts[k]))) << cuts[k]) for k in range(blocks)]
    return [(k, fp.bitwiseAND(F.lit(signed(sum(masks[i] for i in c))))) for k, c in enumerate(combinations(range(blocks), blocks - max_bits))]


def _forest(fps: np.ndarray, ids: np.ndarray, max_bits: int, split: int) -> tuple[list[int], list[int]]:
    """Links that connect what lies within max_bits, one fewer than nodes at most.

    split: only fingerprints before that place meet those from it on (two chunks); 0: all meet.
    Breadth first, each node against all nodes not yet reached, so a dense bucket costs a few passes.
    """
    src: list[int] = []
    dst: list[int] = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if split:
                near &= (left < split) != (at < split)
            if near.any():
                got = left[near]
                src += [int(ids[at])] * len(got)
                dst += ids[got].tolist()
                queue += got.tolist()
                left = left[~near]
    return src, dst


def links(reps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fp -> (src, dst): fingerprints that a chain of pairs within max_bits joins.

    A fingerprint goes to one bucket for each choice of blocks. Buckets of one are dropped before anything is
    gathered. A bucket of over `chunk` fingerprints is cut into p chunks by hash, and each pair of chunks is a group
    of its own, so no task gathers more than two chunks and no pair is left out. Each group gives a spanning forest of
    verified links instead of all pairs.
    """
    reps = common.cut(reps.select("fp"))
    blocks = blocks_for(reps.count(), max_bits)
    keyed = reps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.alias("b")) for k, b in block_keys(F.col("fp"), blocks, max_bits)])).alias("x")).select("fp", "x.k", "x.b")
    crowded = keyed.groupBy("k", "b").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(crowded, ["k", "b"]).select("k", "b", "fp", F.ceil(F.col("n") / chunk).cast("int").alias("p"))
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("p")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
    held = held.withColumn("c", part).withColumn("o", other).withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.runs(batches, 4):
            _, _, lo, hi, c, fp = g
            fps = fp.view(np.uint64)
            if len(fps) == 2 and lo[0] == hi[0]:
                src, dst = ([fp[0]], [fp[1]]) if np.bitwise_count(fps[0] ^ fps[1]) <= max_bits else ([], [])
            else:
                src, dst = _forest(fps, fp, max_bits, int((c == lo).sum()) if lo[0] != hi[0] else 0)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(src, np.int64)), pa.array(np.array(dst, np.int64))], ["src", "dst"])

    keys = ["k", "b", "lo", "hi"]
    # Sorted groups stream through a task, many small ones in a batch.
    grouped = held.select(*keys, "c", "fp").repartition(*keys).sortWithinPartitions(*keys, "c", "fp")
    return grouped.mapInArrow(common.packed(work), "src long, dst long").distinct()


def simhash_components(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint, component_id (smallest doc_id that is reachable), for each row.

    Null and empty texts, and texts of white space, have fingerprint zero, which links like any other. Rows that share
    a doc_id each keep their row. A null doc_id is no candidate for component_id; a group of only such rows has null.
    Copies meet by their fingerprint (combined before the shuffle), so only distinct fingerprints are compared. A very long
    text is one text in memory; other columns are ignored; an empty table gives an empty one.
    """
    fps = common.cut(fingerprints(docs, words))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = common.components(links(reps, max_bits)).select(F.col("id").alias("fp"), F.col("component_id").alias("root"))
    linked = reps.join(roots, "fp")
    firsts = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    named = reps.join(firsts, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, words: int, similarity: float = near.SIMILARITY) -> DataFrame:
    """docs without the rows whose component of near copies (near.near_components) holds a smaller doc_id; of repeated rows of
    a kept doc_id one stays, the first by text. Rows without doc_id stay as they are: nothing tells which of them came first.

    Rows that stay are not shuffled while the ids that go are few enough to name to every task (common.small_side).
    """
    found = common.cut(near.near_components(docs.select("doc_id", "text"), words, similarity).where("doc_id is not null"))
    ids = common.cut(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id")))
    gone = common.small_side(ids.where("n > 1 or doc_id <> component_id").select(F.col("doc_id").alias("gone_id")))
    rest = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.gone_id"), "left_anti")
    again = common.small_side(found.where("doc_id = component_id").join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("kept_id")).distinct())
    if again.isEmpty():
        return rest
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("kept_id"), "text").join(again, "kept_id", "left_semi")
    once = rows.groupBy("kept_id").agg(F.min_by("row", F.struct(F.xxhash64("text"), "text")).alias("row"))
    return rest.unionByName(once.select("row.*"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.documents(spark, sf_dir))


QUERIES = {"op1_simhash": op1_simhash}
