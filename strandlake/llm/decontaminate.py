"""Benchmark decontamination: CGK walks from edit to Hamming distance, bit sampling, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Edits that an item of 5 words bears: one; in general a fifth of its words (a similarity of 0.8).
SIMILARITY = 0.8
#: Recall that repetitions are computed for at an item's most edits, sampled steps of a repetition, steps that the first of them is one of, seed.
RECALL, SAMPLED, NEAR, SEED = 0.99, 2, 6, 11
#: Items and edited copies on which the recall of so many repetitions is measured, and repetitions at most.
_ITEMS, _TRIALS, _MOST = 16, 480, 200
#: Bytes of text that are searched at once.
_SLICE = 2 << 20
#: Items and words that are broadcast at once (a table of one byte for each pair); more items go in further passes.
BLOCK_ITEMS, BLOCK_WORDS = 2_000, 50_000
_ENDS = ".,;:!?\"'()[]{}<>*#|%&$_-"
_OTHER, _PAD = 0, 1


def normal(word: bytes) -> bytes:
    """Case folded, without signs at its ends."""
    return word.decode("utf-8", "replace").casefold().strip(_ENDS).encode()


def item_words(text: str | None) -> list[bytes]:
    return [w for w in map(normal, (text or "").encode().split()) if w]


def best_match(item: list, text: list) -> tuple[int, int, int]:
    """The least edit distance of item to any run of text, and that run's begin and end. Bit-parallel, exact.

    Among the best ends the first one counts, and the longest run that reaches it at that distance.
    """

    def least(pattern: list, words: list, free: bool) -> list[int]:
        m = len(pattern)
        at: dict = {}
        for k, w in enumerate(pattern):
            at[w] = at.get(w, 0) | 1 << k
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, d, out = full, 0, m, [m]
        for w in words:
            eq = at.get(w, 0)
            x = eq | down
            h = (((x & up) + up) ^ up) | x
            more, fewer = down | (~(h | up) & full), up & h
            d += 1 if more & top else -1 if fewer & top else 0
            more = (more << 1 | (not free)) & full
            fewer = (fewer << 1) & full
            up, down = fewer | (~(x | more) & full), more & x
            out.append(d)
        return out

    ends = least(item, text, True)
    d = min(ends)
    end = ends.index(d)
    back = least(item[::-1], text[:end][::-1], False)
    return d, end - (len(back) - 1 - back[::-1].index(d)), end


@dataclass
class Index:
    """The sampled keys of some items. Entry e belongs to item, repetition and offset; tokens are ids of item words."""

    ids: dict[bytes, int]
    names: list[int]
    words: list[list[int]]
    first: np.ndarray
    begin: np.ndarray
    order: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    rep: np.ndarray
    steps: np.ndarray
    keys: np.ndarray
    sizes: np.ndarray
    has: np.ndarray


_A, _B, _C, _D, _FULL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def _bit(rep: int, step: int, word: int) -> int:
    """Whether the walk of a repetition moves on at a step when it stands on a word."""
    h = (word * _A + rep * _B + step * _C) & _FULL
    return ((h ^ h >> 29) * _D & _FULL) >> 40 & 1


def _bits(rep: np.ndarray, step: int, word: np.ndarray) -> np.ndarray:
    h = word.astype(np.uint64) * np.uint64(_A) + rep.astype(np.uint64) * np.uint64(_B) + np.uint64(step * _C & _FULL)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(_D)) >> np.uint64(40) & np.uint64(1)).astype(np.int64)


def _entry(c: list[int], offset: int, rep: int, sampled: int) -> tuple[list[int], list[int]]:
    """Steps that a repetition samples over the item from an offset on, and what the walk writes there (-1: the item has ended).

    The first is one of the NEAR first steps, so that most walks that begin like it by chance end soon; the others are
    any later ones of the whole walk.
    """
    rng = np.random.default_rng([SEED, rep, len(c), offset])
    n = len(c)
    steps = np.arange(1, 2 * (n - offset))
    at = [int(rng.choice(steps[:NEAR]))] if len(steps) else []
    rest = steps[steps > at[0]] if at else steps
    at += sorted(rng.choice(rest, size=min(sampled - 1, len(rest)), replace=False).tolist())
    at += [at[-1] if at else 0] * (sampled - len(at))
    k, written = offset, []
    for j in range(at[-1] + 1):
        w = c[k] if k < n else -1
        written.append(w)
        k += 1 if w < 0 else _bit(rep, j, w)
    return at, [written[j] for j in at]


def _offsets(n: int) -> tuple[int, int]:
    """Offsets that repetitions may begin at (the first half of an item and the word in its middle), and how many of them an
    item uses: the half whose words few windows begin with, three at least if there are."""
    within = max(1, n - n // 2)
    return within, min(within, max(3, -(-within // 2)))


def _index(items: list[list[int]], entries: list[tuple[int, int, int]], words: int, sampled: int, ids: dict, names: list[int]) -> Index:
    got = [(*e, *_entry(items[e[0]], e[1], e[2], sampled)) for e in entries]
    first = np.array([items[i][o] for i, o, *_ in got], np.int64)
    tokens = np.bincount(first, minlength=words)
    has = np.zeros((len(items), words), bool)
    for i, c in enumerate(items):
        has[i, c] = True
    columns = [np.array([g[k] for g in got], np.int64) for k in range(3)]
    return Index(ids, names, items, tokens, np.concatenate([[0], np.cumsum(tokens)]), np.argsort(first, kind="stable"), *columns[:2], columns[2], np.array([g[3] for g in got], np.int64).reshape(-1, sampled), np.array([g[4] for g in got], np.int64).reshape(-1, sampled), np.array([len(c) for c in items], np.int64), has)


@lru_cache(maxsize=4096)
def repetitions(n: int, most: int, recall: float = RECALL, sampled: int = SAMPLED) -> int:
    """How many repetitions an item of n words needs, so that a run with `most` edits is a candidate with this probability.

    Measured on edited copies of items of n different words: words are changed, dropped or added at random places.
    Repetitions take a random choice of offsets in turn, so this holds for whichever offsets an item prefers.
    """
    rng = np.random.default_rng([SEED, n, most])
    items = [list(range(2 + n * i, 2 + n * (i + 1))) for i in range(_ITEMS)]
    within, used = _offsets(n)
    order = [np.resize(rng.permutation(within)[:used], _MOST) for _ in items]
    texts = []
    for k in range(_TRIALS):
        t = list(items[k % _ITEMS])
        for kind in rng.integers(0, 3, most):
            at = int(rng.integers(0, max(1, len(t))))
            t[at : at + int(kind < 2)] = [0] * int(kind != 1)
        texts.append([0] + t + [0] * (n + 2))
    missing = np.arange(_TRIALS)
    done = 0
    while done < _MOST and len(missing) > (1 - recall) * _TRIALS:
        more = max(1, min(done, 4))
        ix = _index(items, [(i, int(order[i][r]), r) for i in range(_ITEMS) for r in range(done, min(done + more, _MOST))], n * _ITEMS + 2, sampled, {}, [])
        x = np.concatenate([np.array([*texts[k], _PAD]) for k in missing])
        begins = np.cumsum([0] + [len(texts[k]) + 1 for k in missing])
        pos, _ = _candidates(x, ix)
        missing = np.delete(missing, np.unique(np.searchsorted(begins, pos, side="right") - 1))
        done += more
    return min(done, _MOST)


def build(items: list[tuple[int, list[bytes]]], similarity: float = SIMILARITY, recall: float = RECALL, sampled: int = SAMPLED) -> Index:
    """Each repetition embeds an item from an offset of its own to its end, so that an edited word breaks few of them.

    CGK: at step j the walk writes the word that it stands on and moves on if a random bit of (repetition, step, word)
    says so; equal runs write equal words, and after an edit two walks meet again. A repetition's key holds the words
    at step 0 and at `sampled` random steps of the whole walk over the item. Offsets prefer long words, which few
    windows begin with. An item gets as many repetitions as repetitions() finds for its size.
    """
    rng = np.random.default_rng(SEED)
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids) + 2) for w in ws] for _, ws in items]
    count = np.bincount(np.concatenate([np.unique(c) for c in coded] or [np.zeros(0, int)]).astype(int), minlength=len(ids) + 2)
    entries = []
    for i, c in enumerate(coded):
        # Long words first, which are rare in any text, then those that few items have.
        within, used = _offsets(len(c))
        chosen = sorted(range(within), key=lambda o: (-len(items[i][1][o]), count[c[o]], rng.random()))[:used]
        entries += [(i, chosen[r % len(chosen)], r) for r in range(repetitions(len(c), int((1 - similarity) * len(c) + 1e-9), recall, sampled))]
    return _index(coded, entries, len(ids) + 2, sampled, ids, [k for k, _ in items])


def _candidates(x: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """x: token ids of texts, with pads after each. Positions and entries whose whole key agrees with the walk there.

    A repetition's walk runs on only where all steps sampled so far agree, which gives the same as walking everywhere.
    """
    per = ix.first[x]
    at = np.flatnonzero(per)
    n = per[at]
    pos = np.repeat(at, n)
    inside = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
    entry = ix.order[np.repeat(ix.begin[x[at]], n) + inside]
    walk, j, k = pos.copy(), 0, np.zeros(len(pos), np.int64)
    steps = int(ix.steps.max(initial=0)) + 1
    done_pos, done_entry = [], []
    for j in range(steps):
        now = x[walk]
        while True:
            due = (k < ix.steps.shape[1]) & (ix.steps[entry, np.minimum(k, ix.steps.shape[1] - 1)] == j)
            if not due.any():
                break
            key = ix.keys[entry, np.minimum(k, ix.steps.shape[1] - 1)]
            keep = ~due | (key == -1) | (key == now)
            pos, entry, walk, k, now, due = pos[keep], entry[keep], walk[keep], k[keep], now[keep], due[keep]
            k = k + due
        full = k >= ix.steps.shape[1]
        if full.any():
            done_pos.append(pos[full]), done_entry.append(entry[full])
            pos, entry, walk, k, now = pos[~full], entry[~full], walk[~full], k[~full], now[~full]
        if not len(pos):
            break
        walk = np.minimum(walk + _bits(ix.rep[entry], j, now), len(x) - 1)
    if not done_pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_pos), np.concatenate(done_entry)


_PADS = np.array([_PAD], np.int64)


def _coded(words: list[bytes], ix: Index, cache: dict[bytes, int]) -> np.ndarray:
    """Token ids of the words, those of signs only left out."""
    try:
        got = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    except KeyError:
        if len(cache) > 400_000:
            cache.clear()
        for w in words:
            if w not in cache:
                v = normal(w)
                cache[w] = ix.ids.get(v, _OTHER) if v else -1
        got = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    return got[got >= 0]


def _search(texts: list[bytes], ix: Index, cache: dict, similarity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, number of words) for the best run of each text that an item matches."""
    begins, parts, n = [], [], 0
    for t in texts:
        x = _coded(t.split(), ix, cache)
        begins.append(n)
        parts += [x, _PADS]
        n += len(x) + 1
    x = np.concatenate(parts or [_PADS])
    first = np.array(begins, np.int64)
    pos, entry = _candidates(x, ix)
    doc = np.searchsorted(first, pos, side="right") - 1
    item, start = ix.item[entry], pos - ix.offset[entry]
    size = ix.sizes[item]
    most = ((1 - similarity) * size + 1e-9).astype(np.int64)
    lo = np.maximum(first[doc], start - most)
    hi = np.minimum(np.append(first[1:], n)[doc] - 1, start + size + 2 * most)
    # An item within `most` edits of a run has all but `most` of its words in it.
    held = np.zeros(len(pos), np.int64)
    for k in range(int((hi - lo).max(initial=0))):
        at = lo + k
        held += ix.has[item, x[np.minimum(at, n - 1)]] & (at < hi)
    keep = held >= size - most
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, a, b, m in sorted(set(zip(*(y[keep].tolist() for y in (doc, item, lo, hi, most)), strict=True))):
        edits, begin, end = best_match(ix.words[i], x[a:b].tolist())
        got = (edits, a - begins[d] + begin, end - begin)
        if edits <= m and ((d, i) not in best or got < best[d, i]):
            best[d, i] = got
    for (d, i), got in sorted(best.items()):
        yield d, ix.names[i], *got


def _sliced(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Some MB of texts at a time, or one text."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(texts: Iterator[bytes], ix: Index, cache: dict, similarity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """_search() over slices of texts."""
    at = 0
    for part in _sliced(texts):
        for d, *x in _search(part, ix, cache, similarity):
            yield at + d, *x
        at += len(part)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        words = item_words(r["text"])
        if words:
            held.append((r["item_id"], words))
            n += len(words)
        if n >= BLOCK_WORDS or len(held) >= BLOCK_ITEMS:
            yield held
            held, n = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text and item_id, text -> doc_id, item_id, edits, start_word, n_words: the best run of a document for
    each item that has one within (1 - similarity) * words edits (words added, dropped or changed).

    Words are case folded and lose signs at their ends; words of signs only don't count. An item without words
    matches nothing; items of under 5 words match exactly. Null and empty texts match nothing; a very long text is one text
    in memory. Repeated rows and items give their rows each; other columns are ignored. The benchmark is the query set: it is broadcast in blocks of bounded size, and every window
    of every whole document is searched against each block, without a shuffle.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start_word int, n_words int"
    out = None
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(build(block, similarity))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, int] = {}
            for b in batches:
                names = b.column(0)
                found = [(names[d].as_py(), *x) for d, *x in _found(common.texts(b.column(1)), shared.value, cache, similarity)]
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edits", "start_word", "n_words"])

        part = source.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return common.empty(spark, schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows in which contaminated() finds an item, all their columns kept. No shuffle: each pass over
    a block of the benchmark drops rows where they are."""
    spark = docs.sparkSession
    common.small_batches(spark)
    at = docs.columns.index("text")
    out = docs
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(build(block, similarity))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, int] = {}
            for b in batches:
                hit = {d for d, *_ in _found(common.texts(b.column(at)), shared.value, cache, similarity)}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(work, docs.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
