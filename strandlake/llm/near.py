"""Near copies by SimHash and exact similarity: long fingerprints, blocks, Hamming distance, exact Jaccard, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, passages

SIMILARITY = 0.8
#: Of pairs at the similarity, whatever their sizes, at least this part is to share a block; and at most MISSED of them
#: is to lie beyond the radius.
RECALL, MISSED = 0.99, 0.001
#: Unrelated texts of a block's bucket, about; bits of a block at least and at most; bits that distances are taken of.
LOAD, LEAST_BITS, MOST_BITS, CHECKED = 128, 8, 30, 128
#: Texts and shingles of a chunk; a candidate group with more is cut into chunks, which meet chunk by chunk.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 20
#: A bucket with more texts than this is cut into chunks likewise; one with up to _SMALL is compared along with others.
BUCKET, _SMALL = 4096, 512
#: Hashes that are added up at a time, and in how many lanes.
_SLICE, _LANES = 1 << 16, 15


def shingle_sets(batch: list[bytes], words: int, cache: dict[bytes, int]) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (64 bits): runs of `words` lower-cased words; fewer words: the whole
    sequence; none: a value of its own, so that texts without words equal each other."""
    hs = [passages.word_hashes(t, cache) for t in batch]
    out = []
    for h in hs:
        if len(h) >= words:
            out.append(np.unique(passages._grams(h, words)[: len(h) - words + 1]))
        else:
            out.append(passages._mix(passages._grams(h, len(h))[:1] + np.uint64(len(h))) if len(h) else np.zeros(1, np.uint64))
    return out


@lru_cache
def flip(similarity: float) -> float:
    """The most that a fingerprint's bit differs with, of two sets at the similarity or above: that of large sets of one size
    (by the angle between them), or of small ones, whose votes tie more often (counted out)."""
    if similarity >= 1:
        return 0.0
    most = math.acos(2 * similarity / (1 + similarity)) / math.pi
    votes = lambda n: np.array([math.comb(n, i) for i in range(n + 1)]) / 2**n
    for both in range(1, math.ceil(similarity / (1 - similarity)) + 9):
        others = int(both * (1 - similarity) / similarity + 1e-9)
        for x in range(others + 1):
            for y in range(min(x, others - x) + 1):
                # Chances that either set's bit is 1, for each number of votes of what both hold.
                n = np.arange(both + 1)[:, None]
                a = (votes(x) * (2 * (n + np.arange(x + 1)) > both + x)).sum(1)
                b = (votes(y) * (2 * (n + np.arange(y + 1)) > both + y)).sum(1)
                most = max(most, float(votes(both) @ (a * (1 - b) + b * (1 - a))))
    return most


def layout(n: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """How fingerprints of n texts are cut: (blocks, bits of a block, radius in the CHECKED bits that follow the blocks).

    A block has so many bits that a bucket gets about LOAD of n unrelated texts, and there are so many blocks that a pair at the
    similarity shares one with probability RECALL. No bit is in two blocks.
    """
    p = flip(similarity)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / LOAD))))
    shared = (1 - p) ** bits
    blocks = math.ceil(math.log(1 - RECALL) / math.log(1 - shared)) if shared < 1 else 1
    radius, beyond = 0, 1 - (1 - p) ** CHECKED
    while beyond > MISSED:
        radius += 1
        beyond -= math.comb(CHECKED, radius) * p**radius * (1 - p) ** (CHECKED - radius)
    return blocks, bits, radius


def _votes(h: np.ndarray, begins: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Sets' hashes end to end -> (sets, 64 * salts) how many of each set's hashes have a bit. A hash gives 64 bits a salt.

    Lanes of hashes are added by full adders, bit by bit in whole words, before anything is unpacked.
    """
    sizes = np.diff(np.append(begins, len(h)))
    groups = -(-sizes // _LANES)
    first = np.cumsum(groups) - groups
    row = np.arange(len(h)) - np.repeat(begins, sizes)
    at = (row % _LANES, np.repeat(first, sizes) + row // _LANES)
    lanes, held = np.zeros((2, _LANES, int(groups.sum())), np.uint64)
    lanes[at], held[at] = h, np.uint64(0xFFFFFFFFFFFFFFFF)
    weights = [list(passages._mix(lanes[:, :, None] ^ salts) & held[:, :, None])]
    total = np.zeros((lanes.shape[1], 64 * len(salts)), np.uint8)
    for k, planes in enumerate(weights):
        while len(planes) > 1:
            a, b, c = planes.pop(), planes.pop(), planes.pop()
            u = a ^ b
            planes.insert(0, u ^ c)
            if len(weights) == k + 1:
                weights.append([])
            weights[k + 1].append((a & b) | (u & c))
        total += np.unpackbits(np.ascontiguousarray(planes[0]).view(np.uint8), axis=1, bitorder="little") << np.uint8(k)
    return np.add.reduceat(total, first, axis=0, dtype=np.int32)


def fingerprints(sets: list[np.ndarray], n_bits: int) -> np.ndarray:
    """(texts, n_bits) SimHash fingerprints: a bit is set if over half of the set's hashes have it."""
    words = -(-n_bits // 64)
    salts = passages._mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    out = np.zeros((len(sets), 64 * words), np.int32)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    step = max(_LANES, _SLICE // words)
    for i in range(0, len(flat), step):
        j = min(i + step, len(flat))
        a, b = int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, j, "left")) + 1
        out[a:b] += _votes(flat[i:j], np.maximum(ends[a:b] - sizes[a:b] - i, 0), salts)
    return (2 * out > sizes[:, None])[:, :n_bits]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray], split: int) -> tuple[list[int], list[int]]:
    """Places of links that connect all that is near; split as for fingerprints' buckets. near tells it of one and many places."""
    src: list[int] = []
    dst: list[int] = []
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            may = (left < split) != (at < split) if split else np.ones(len(left), bool)
            may[may] = near(at, left[may])
            if may.any():
                got = left[may]
                src += [int(at)] * len(got)
                dst += got.tolist()
                queue += got.tolist()
                left = left[~may]
    return src, dst


def _bucket_links(checks: np.ndarray, begins: np.ndarray, sizes: np.ndarray, splits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect, within each bucket, what lies within the radius."""
    ends = np.repeat(begins + sizes, sizes)
    alone = (sizes > _SMALL) | (splits > 0)
    at = np.flatnonzero(~np.repeat(alone, sizes))
    src, dst, step = [at[:0]], [at[:0]], 0
    while len(at):
        # All pairs of small buckets, those at the same distance in the order at once.
        step += 1
        at = at[at + step < ends[at]]
        hit = at[_distance(checks[at], checks[at + step]) <= radius]
        src.append(hit)
        dst.append(hit + step)
    src, dst = np.concatenate(src), np.concatenate(dst)
    bucket = np.searchsorted(begins, src, "right") - 1
    # Of dense buckets a forest is enough.
    dense = np.bincount(bucket, minlength=len(begins)) > 2 * sizes
    src, dst = [src[~dense[bucket]]], [dst[~dense[bucket]]]
    for k in np.flatnonzero(alone | dense).tolist():
        own = checks[begins[k] : begins[k] + sizes[k]]
        a, b = _forest(len(own), lambda i, left: _distance(own[left], own[i]) <= radius, int(splits[k]))  # noqa: B023
        src.append(begins[k] + np.array(a, np.int64))
        dst.append(begins[k] + np.array(b, np.int64))
    return np.concatenate(src), np.concatenate(dst)


def candidates(reps: DataFrame, bits: int, radius: int) -> DataFrame:
    """t, blocks, c1, c2 -> (src, dst): links that connect what shares a block and lies within the radius.

    A text goes to one bucket a block. A bucket of over BUCKET texts is cut into chunks by hash, and each pair of chunks is a
    cell of its own, so no task gathers more than two chunks and no pair is left out.
    """
    keyed = reps.select("t", "c1", "c2", F.posexplode("blocks").alias("k", "x"))
    keyed = keyed.select(F.shiftleft(F.col("k").cast("long"), bits).bitwiseOR(F.col("x").cast("long")).alias("b"), "t", "c1", "c2")
    crowded = common.small_side(keyed.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("b", F.ceil(F.col("n") / BUCKET).cast("int").alias("p")))
    common.release(reps.sparkSession)
    held = keyed.select("b", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("c"), "t", "c1", "c2")
    if not crowded.isEmpty():
        held = keyed.join(crowded, "b", "left").withColumn("p", F.coalesce("p", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("t", F.lit(7)), F.col("p")).cast("int"))
        held = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
        held = held.select("b", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c", "t", "c1", "c2")
    by = ["b", "lo", "hi"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, begins, sizes in common.segments(common.packed(lambda x: x)(batches), 3):
            _, lo, hi, c, t, c1, c2 = cols
            lower = np.add.reduceat((c == lo).astype(np.int64), begins)
            # A cell with texts of one of its two chunks only has no pairs.
            splits = np.where(lo[begins] == hi[begins], 0, np.where(lower > 0, lower, sizes))
            src, dst = _bucket_links(np.stack([c1, c2], 1).view(np.uint64), begins, sizes, splits, radius)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(t[src]), pa.array(t[dst])], ["src", "dst"])

    grouped = held.repartition(*by).sortWithinPartitions(*by, "c", "t")
    return grouped.mapInArrow(common.packed(work), "src long, dst long").distinct()


def _similar(sets: list[np.ndarray], checks: np.ndarray, radius: int, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """For _forest: what lies within the radius and reaches the Jaccard similarity, by the whole sets."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))

    def near(at: int, left: np.ndarray) -> np.ndarray:
        out = _distance(checks[left], checks[at]) <= radius
        out &= np.minimum(size[left], size[at]) >= similarity * np.maximum(size[left], size[at]) - 1e-9
        which = np.flatnonzero(out)
        for i in range(0, len(which), 256):
            w = which[i : i + 256]
            flat = np.concatenate([sets[k] for k in left[w]])
            n = size[left[w]]
            found = np.minimum(np.searchsorted(sets[at], flat), size[at] - 1)
            both = np.add.reduceat((sets[at][found] == flat).astype(np.int64), np.cumsum(n) - n)
            out[w] = both >= similarity * (n + size[at] - both) - 1e-9
        return out

    return near


def near_components(docs: DataFrame, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text -> doc_id, component_id (smallest doc_id that is reachable), for each row.

    Texts link whose fingerprints lie within a Hamming distance that fits the similarity and whose sets of shingles have a
    Jaccard similarity of `similarity` or more, which is computed from the whole sets; they are found if a chain of texts that
    share blocks joins them. Null and empty texts and texts of white space are copies of each other. Rows that share a doc_id
    each keep their row. A null doc_id is no candidate for component_id; a group of only such rows has null.

    (1) A task gives each text's SimHash fingerprint, as long as the number of rows asks (layout), cut into blocks and the bits
    that distances are taken of; equal texts are combined before the shuffle and are one from there on. (2) Texts that share
    a block and lie within the radius are joined into candidate groups, by numbers alone (candidates). (3) Texts of these
    groups go to their group once, as sets of shingles; a group with many texts or shingles is cut into p chunks, and each
    pair of chunks is a group of its own, so no task gathers more than two chunks and no pair is left out. Texts within the
    radius are compared, by a search that gives a spanning forest. (4) Components of these links.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.xxhash64(text).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    blocks, bits, radius = layout(docs.count(), similarity)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            sets = shingle_sets(list(common.texts(b.column(2))), words, cache)
            fp = fingerprints(sets, blocks * bits + CHECKED)
            cuts = (fp[:, : blocks * bits].reshape(-1, blocks, bits) @ (1 << np.arange(bits))).astype(np.int32)
            checks = np.packbits(fp[:, blocks * bits :], axis=1, bitorder="little").view(np.int64)
            cuts = pa.FixedSizeListArray.from_arrays(pa.array(cuts.ravel()), blocks).cast(pa.list_(pa.int32()))
            sizes = pa.array(list(map(len, sets)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, cuts, pa.array(checks[:, 0]), pa.array(checks[:, 1])], ["t", "doc_id", "n", "blocks", "c1", "c2"])

    rows = common.cut(source.mapInArrow(sketch, "t long, doc_id long, n long, blocks array<int>, c1 long, c2 long"))
    reps = common.cut(rows.groupBy("t").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "blocks", "c1", "c2")]))
    rows = rows.select("t", "doc_id")
    groups = common.components(candidates(reps, bits, radius))
    reps = reps.drop("blocks")
    common.release(spark)
    groups = common.cut(groups.select(F.col("id").alias("t"), F.col("component_id").alias("g")).join(reps, "t"))
    sizes = groups.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("p"))
    # Texts without candidates aren't shuffled while the others are few enough to name to every task.
    wanted = common.small_side(groups.join(sizes, "g").select("t", "least", "g", "p", "c1", "c2"))
    # A text is sent by its first document only.
    held = source.alias("s").join(wanted.alias("w"), (F.col("s.t") == F.col("w.t")) & F.col("s.doc_id").eqNullSafe(F.col("w.least"))).select("g", "p", "s.t", "c1", "c2", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            sets = shingle_sets(list(common.texts(b.column(5))), words, cache)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([s.tobytes() for s in sets], pa.binary())], ["g", "p", "t", "c1", "c2", "shingles"])

    held = held.mapInArrow(gather, "g long, p int, t long, c1 long, c2 long, shingles binary")
    held = held.withColumn("c", F.pmod(F.xxhash64("t", F.lit(7)), F.col("p")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    by = ["g", "lo", "hi"]
    grouped = held.withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o")).select(*by, "c", "t", "c1", "c2", "shingles").repartition(*by).sortWithinPartitions(*by, "c", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lo, hi, c, t, c1, c2, shingles in common.runs(batches, 3):
            _, once = np.unique(t, return_index=True)
            once = np.sort(once)
            sets = [np.frombuffer(shingles[k], np.uint64) for k in once.tolist()]
            split = int((c[once] == lo[0]).sum()) if lo[0] != hi[0] else 0
            src, dst = _forest(len(sets), _similar(sets, np.stack([c1, c2], 1)[once].view(np.uint64), radius, similarity), split)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(t[once][src]), pa.array(t[once][dst])], ["src", "dst"])

    roots = common.components(grouped.mapInArrow(common.packed(compare), "src long, dst long").distinct()).select(F.col("id").alias("t"), F.col("component_id").alias("root"))
    common.release(spark)
    linked = reps.join(roots, "t").select("t", "root", "least")
    firsts = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("t", "component_id")
    named = reps.join(firsts, "t", "left").select("t", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "t", "left").select("doc_id", "component_id")
