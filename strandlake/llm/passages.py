"""Passages that repeat across documents: windows at content-defined anchors, MinHash bands, exact Jaccard, and runs extended
word by word to where a passage ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
#: Words of a shingle, of a window, of an anchor; positions in a row of which one at least is an anchor, so a passage of
#: REACH - 1 + WINDOW = 50 words holds a whole window at the same anchor in every document.
SHINGLE, WINDOW, GRAM, REACH = 5, 24, 2, 27
#: A passage has so many words at least.
MIN_WORDS = 50
#: Words that are looked at on either side of a run's core, first and at most in one round; words between windows of one run;
#: words that must agree after an edit.
CONTEXT, WIDEST, GAP, RESYNC = 44, 2816, 8, 5
#: Runs whose places are broadcast at most (some tens of bytes each); with more, texts meet them by document.
BROADCAST_SPANS = 1_000_000
#: Linked windows may differ in their outer words or be shifted by some: runs grow from so many words within; they may be
#: shifted by SHIFT words, and how is seen from the ALIGN words from there on.
TRIM, SHIFT, ALIGN = 10, 5, 15
#: Recall that bands are tuned for, at SIMILARITY.
RECALL = 0.95
CHUNK, SEED = 2048, 9
_SMALL = 4
_CACHE = 500_000


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands of one MinHash each: the fewest that find a pair of this similarity with this probability."""
    b = 1
    while 1 - (1 - similarity) ** b < recall:
        b += 1
    return b


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; the last n - 1 places hold what has no meaning."""
    out = h.copy()
    for j in range(1, n):
        nxt = np.zeros_like(h)
        nxt[:-j] = h[j:]
        out = _mix(out + np.uint64(0x2545F4914F6CDD1D)) ^ nxt
    return _mix(out)


def word_hashes(text: bytes, cache: dict[bytes, int]) -> np.ndarray:
    words = text.lower().split()
    try:
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(cache) > _CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w, SEED)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def anchors(h: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' word hashes end to end -> text and place of each window: where a gram's hash is the least of REACH in a
    row, in the text; a whole window must follow."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _grams(h, GRAM)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(h)) - begins[doc]
    room = lengths[doc] - place
    at = np.zeros(0, np.int64)
    if len(h) >= REACH + GRAM - 1:
        view = np.lib.stride_tricks.sliding_window_view(g, REACH)
        ok = np.flatnonzero(room[: len(view)] >= REACH + GRAM - 1)
        at = np.unique(np.concatenate([ok[i : i + 50_000] + view[ok[i : i + 50_000]].argmin(1) for i in range(0, len(ok), 50_000)] or [at]))
    at = at[room[at] >= WINDOW]
    return doc[at], at


def minhashes(h: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bands) least hashes of the windows' shingles, and the shingles' hashes."""
    shingles = _grams(h, SHINGLE)[at[:, None] + np.arange(WINDOW - SHINGLE + 1)[None, :]]
    out = np.empty((len(at), bands), np.uint64)
    for k in range(bands):
        # A band's number is part of its value, so that different bands never meet.
        out[:, k] = _mix(shingles ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64))).min(1) if len(at) else 0
    return out, shingles


def _flat(batch: list[bytes], cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hs = [word_hashes(t, cache) for t in batch]
    lengths = np.fromiter(map(len, hs), np.int64, len(hs))
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    return h, np.cumsum(lengths) - lengths, lengths


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sets(shingles: np.ndarray) -> np.ndarray:
    """Each row's distinct shingles, sorted, the rest of the row filled with the largest value."""
    s = np.sort(shingles, axis=1)
    s[:, 1:][s[:, 1:] == s[:, :-1]] = _NONE
    return np.sort(s, axis=1)


def _shared(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of own (sorted, distinct) each row of others holds."""
    at = np.minimum(np.searchsorted(own, others), len(own) - 1)
    return (own[at] == others).sum(1)


def _close(sets: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of rows a[k] and b[k] reaches the threshold."""
    out, width = np.zeros(len(a), bool), sets.shape[1]
    for i in range(0, len(a), 4_000):
        x, y = a[i : i + 4_000], b[i : i + 4_000]
        own, twice = sets[x], np.hstack([sets[y], sets[y]])
        hit = np.zeros(own.shape, bool)
        for k in range(width):
            hit |= own == twice[:, k : k + width]
        both = (hit & (own != _NONE)).sum(1)
        out[i : i + 4_000] = both >= similarity * (size[x] + size[y] - both) - 1e-9
    return out


def _forest(sets: np.ndarray, ids: np.ndarray, similarity: float, split: int) -> tuple[list[int], list[int]]:
    """Links that connect all whose Jaccard similarity reaches the threshold; split as for fingerprints' buckets."""
    size = (sets != _NONE).sum(1)
    src: list[int] = []
    dst: list[int] = []
    left = np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            both = _shared(sets[at][: size[at]], sets[left])
            near = both >= similarity * (size[left] + size[at] - both) - 1e-9
            if split:
                near &= (left < split) != (at < split)
            if near.any():
                got = left[near]
                src += [int(ids[at])] * len(got)
                dst += ids[got].tolist()
                queue += got.tolist()
                left = left[~near]
    return src, dst


def grown(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, more: tuple[bool, bool] = (False, False), words: int = 0, edits: int = 0) -> tuple[int, int, int, bool]:
    """How far two runs of words go on alike from their first words, one of which may begin up to SHIFT words later: words of
    a, words of b, edits, whether it takes more words to know. After a difference of one or two words (changed, added or
    dropped) they go on if RESYNC words agree again, as long as no more than 1 - similarity of the words are edits.

    more: whether the texts go on after a and after b. words, edits: of a that were passed already; a run that goes on
    from where it was open ends where it would have ended with all words at hand.
    """
    i = j = 0
    if not words:
        best = RESYNC - 1
        for di, dj in _SHIFTS:
            n = min(ALIGN, len(a) - di, len(b) - dj)
            agree = int((a[di : di + n] == b[dj : dj + n]).sum()) if n > best else 0
            if agree > best:
                i, j, best = di, dj, agree
            if best == ALIGN:
                break
    while True:
        n = min(len(a) - i, len(b) - j)
        same = a[i : i + n] == b[j : j + n]
        m = n if same.all() else int(same.argmin())
        i, j = i + m, j + m
        if m == n:
            return i, j, edits, (more[0] or i < len(a)) and (more[1] or j < len(b))
        if (more[0] and len(a) - i < _AHEAD) or (more[1] and len(b) - j < _AHEAD):
            return i, j, edits, True
        for di, dj in _EDITS:
            x, y = a[i + di : i + di + RESYNC], b[j + dj : j + dj + RESYNC]
            if len(x) == len(y) == RESYNC and (x == y).all() and edits + max(di, dj) <= (1 - similarity) * (words + i + di + RESYNC) + 1e-9:
                i, j, edits = i + di, j + dj, edits + max(di, dj)
                break
        else:
            return i, j, edits, False


_SHIFTS = ((0, 0), *(s for k in range(1, SHIFT + 1) for s in ((0, k), (k, 0))))
_EDITS = ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (1, 2), (2, 1))
_AHEAD = max(map(max, _EDITS)) + RESYNC


def contexts(source: DataFrame, wanted: DataFrame, width: int = CONTEXT) -> DataFrame:
    """doc_id, text and distinct (doc_id, lo, hi), with back and on -> doc_id, lo, hi, before, after: hashes of the `width` words
    before lo (if back) and from hi on (if on), as bytes, nearest first; and n_words of the text."""
    wanted = common.cut(wanted)
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "back", "on")).alias("spans"))
    if wanted.count() <= BROADCAST_SPANS:
        asked = F.broadcast(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "lo", "hi", "before", "after", "n_words"])

        for b in batches:
            rows: list[tuple] = []
            for doc, t, spans in zip(b.column(0).to_pylist(), common.texts(b.column(1)), b.column(2), strict=True):
                h = word_hashes(t, cache)
                for x in spans.as_py():
                    lo, hi = x["lo"], x["hi"]
                    rows.append((doc, lo, hi, h[max(0, lo - width) : lo][::-1].tobytes() if x["back"] else b"", h[hi : hi + width].tobytes() if x["on"] else b"", len(h)))
                    if len(rows) * width >= 1 << 20:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    found = source.join(asked, "doc_id").select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, lo int, hi int, before binary, after binary, n_words int")
    return found.dropDuplicates(["doc_id", "lo", "hi"])


def runs_of(spans: DataFrame, source: DataFrame, similarity: float, context: int = CONTEXT) -> DataFrame:
    """Linked windows' spans (doc_id, lo, hi; rep, rep_lo, rep_hi) -> the same, each grown on both sides as long as the two
    texts agree. Words around a span of a text that many others repeat are looked up once.

    Runs grow in rounds: those that still agree where the words looked at end go on with four times as many (WIDEST at
    most), until none is left. A round reads the texts of the runs that are left. Runs of two documents that have met are
    one from then on, so what they hold is not passed again by each of them.
    """
    spark = spans.sparkSession
    core = [(F.col(c) + d).cast("int").alias(c) for c, d in (("lo", TRIM), ("hi", -TRIM), ("rep_lo", TRIM), ("rep_hi", -TRIM))]
    zero = [F.lit(0).alias(c) for c in ("back_words", "back_edits", "on_words", "on_edits")]
    runs, width = spans.select("doc_id", "rep", *core, *zero, F.lit(True).alias("back"), F.lit(True).alias("on")), context
    schema = "doc_id long, rep long, lo int, hi int, rep_lo int, rep_hi int, back_words int, back_edits int, on_words int, on_edits int, back boolean, on boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    while True:
        left = runs.where("back or on")
        if left.isEmpty():
            return runs.select("doc_id", "lo", "hi", "rep", "rep_lo", "rep_hi")
        ends = left.select("doc_id", "lo", "hi", "back", "on").unionByName(left.select(F.col("rep").alias("doc_id"), F.col("rep_lo").alias("lo"), F.col("rep_hi").alias("hi"), "back", "on"))
        ends = ends.groupBy("doc_id", "lo", "hi").agg(F.max("back").alias("back"), F.max("on").alias("on"))
        at = common.scratch(spark, "around")
        contexts(source, ends, width).write.parquet(at)
        around = spark.read.parquet(at)
        rep = around.select(F.col("doc_id").alias("rep"), F.col("lo").alias("rep_lo"), F.col("hi").alias("rep_hi"), *[F.col(c).alias(f"rep_{c}") for c in ("before", "after", "n_words")])
        both = left.join(around, ["doc_id", "lo", "hi"]).join(rep, ["rep", "rep_lo", "rep_hi"]).select(*names, "before", "rep_before", "after", "rep_after", "n_words", "rep_n_words")

        def work(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc, r, lo, hi, rlo, rhi, bw, be, ow, oe, back, on, *words, n, rn in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    p, q, x, y = (np.frombuffer(w, np.uint64) for w in words)
                    if back:
                        i, j, be, back = grown(p, q, similarity, (lo > width, rlo > width), bw, be)
                        lo, rlo, bw = lo - i, rlo - j, bw + i
                    if on:
                        i, j, oe, on = grown(x, y, similarity, (n - hi > width, rn - rhi > width), ow, oe)
                        hi, rhi, ow = hi + i, rhi + j, ow + i
                    out.append((doc, r, lo, hi, rlo, rhi, bw, be, ow, oe, back, on))
                if out:
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 8 + [pa.bool_()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        runs = common.cut(_met(both.mapInArrow(work, schema).unionByName(runs.where("not back and not on")), names))
        # The round's words and their shuffles go before the next round's come.
        common.remove(spark, at)
        del ends, around, rep, both, left
        common.release(spark)
        width = min(width * 4, max(WIDEST, context))


def _met(runs: DataFrame, names: list[str]) -> DataFrame:
    """Runs of the same two documents that overlap, and go on there as they began, as one, which goes on at its own ends."""
    order = Window.partitionBy("doc_id", "rep").orderBy("lo", "hi", "rep_lo", "rep_hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("hi", "rep_hi")).over(before)
    meets = (F.col("lo") <= last["hi"]) & (F.abs(F.col("rep_lo") - F.col("lo") - last["rep_hi"] + last["hi"]) <= GAP)
    part = runs.withColumn("_new", F.when(meets, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(order))
    first = F.min(F.struct("lo", "rep_lo", "back_words", "back_edits", "back")).alias("_a")
    final = F.max(F.struct("hi", "rep_hi", "on_words", "on_edits", "on")).alias("_z")
    one = part.groupBy("doc_id", "rep", "_part").agg(first, final)
    at = {"lo": "_a", "rep_lo": "_a", "back_words": "_a", "back_edits": "_a", "back": "_a"}
    return one.select(*[c if c in ("doc_id", "rep") else F.col(f"{at.get(c, '_z')}.{c}").alias(c) for c in names])


def _merged(df: DataFrame, keys: list[str], lo: str, hi: str, *more) -> DataFrame:
    """Overlapping ranges of a key as one."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    new = F.coalesce((F.col(lo) > F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    part = df.withColumn("_new", new).withColumn("_part", F.sum("_new").over(order))
    return part.groupBy(*keys, "_part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), *more).drop("_part")


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text -> doc_id, component_id, component_start, start_word, n_words, kept: the runs of min_words words or more
    that other documents hold too.

    A passage is kept in the smallest doc_id that holds it, component_id; component_start is the word with which the kept run
    begins, so both name a passage. The other documents' runs of it aren't kept. Words are split at ASCII white space, A-Z
    in lower case. A run may hold edits: words changed, added or dropped, one or two at a place, RESYNC words apart.
    Null, empty and short texts and rows without doc_id have no passage; rows that repeat a doc_id are the same document,
    which doesn't repeat itself. Very long texts are one text in memory; other columns are ignored; an empty table gives an
    empty one.

    Windows of WINDOW words stand at anchors that the words themselves choose, so a passage is cut alike wherever it
    stands; windows with a Jaccard similarity of their five-word shingles of `similarity` or more link. (1) A task emits
    a window's MinHashes, one row for each band. The least and largest doc_id of each value are combined before the
    shuffle; values that only one document has go. (2) The windows that are left meet the texts once more and become
    contents (equal windows are one, however many), with their shingles. (3) Contents that share a value are compared
    exactly in streamed groups, cut into chunk pairs where large, that give spanning forests. (4) Components are joined
    back to the windows. (5) Windows that follow one another in a document and in the first document of their components
    are a run, which grows on both sides as long as the two texts agree.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bands = bands_for(similarity, recall)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            h, begins, lengths = _flat(list(common.texts(b.column(1))), cache)
            doc, at = anchors(h, begins, lengths)
            values, _ = minhashes(h, at, bands)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[doc]), pa.array((at - begins[doc]).astype(np.int32)), *[pa.array(np.ascontiguousarray(values[:, k]).view(np.int64)) for k in range(bands)]], ["doc_id", "pos", *names])

    names = [f"v{k}" for k in range(bands)]
    kinds = ", ".join(f"{n} long" for n in names)
    # Written once, as it is read twice: to find the values that documents share, and for the windows that have them.
    first = common.scratch(spark, "sketches")
    source.mapInArrow(sketch, f"doc_id long, pos int, {kinds}").write.parquet(first)
    rows = spark.read.parquet(first).select(F.explode(F.array(*names)).alias("v"), "doc_id", "pos")
    shared = rows.groupBy("v").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("v")
    places = common.cut(rows.join(shared, "v", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("at")))
    common.remove(spark, first)
    common.release(spark)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        seen: set[int] = set()
        weights = _mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            if not b.num_rows:
                continue
            h, begins, _ = _flat(list(common.texts(b.column(1))), cache)
            places = b.column(2)
            n = np.fromiter((len(x) for x in places), np.int64, b.num_rows)
            at = places.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), n)
            where = begins[doc] + at
            for i in range(0, len(at), 50_000):
                w = where[i : i + 50_000]
                values, shingles = minhashes(h, w, bands)
                content = _mix((h[w[:, None] + np.arange(WINDOW)[None, :]] * weights).sum(1, dtype=np.uint64))
                # A task gives a content's shingles once; equal windows that follow only name it.
                _, first = np.unique(content, return_index=True)
                first = first[[c not in seen for c in content[first].tolist()]]
                if len(seen) > _CACHE:
                    seen.clear()
                seen.update(content[first].tolist())
                new = np.zeros(len(w), bool)
                new[first] = True
                sets: list[bytes | None] = [None] * len(w)
                for k, x in zip(first.tolist(), _sets(shingles[first]), strict=True):
                    sets[k] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(content.view(np.int64)), pa.array(b.column(0).to_numpy()[doc[i : i + 50_000]]), pa.array(at[i : i + 50_000].astype(np.int32)), pa.array(sets, pa.binary()),
                        *[pa.array(np.ascontiguousarray(values[:, k]).view(np.int64), mask=~new) for k in range(bands)],
                    ], ["content", "doc_id", "pos", "sets", *names],
                )

    at = common.scratch(spark, "passages")
    source.join(places, "doc_id").select("doc_id", "text", "at").mapInArrow(contents, f"content long, doc_id long, pos int, sets binary, {kinds}").write.parquet(at)
    common.release(spark)
    windows = spark.read.parquet(at)
    keyed = windows.where("sets is not null").select("content", "sets", F.explode(F.array(*names)).alias("v"))
    # Values with more contents than a chunk: one in CHUNK at most, so they are few; broadcast if so, else joined.
    large = common.cut(windows.where("sets is not null").select(F.explode(F.array(*names)).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    held = keyed.join(F.broadcast(large) if large.count() <= 100_000 else large, "v", "left")
    held = held.select("v", "content", "sets", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int").alias("p"))
    held = held.withColumn("c", F.pmod(F.xxhash64("content", F.lit(7)), F.col("p")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    keys = ["v", "lo", "hi"]
    grouped = held.withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o")).select(*keys, "c", "content", "sets").repartition(*keys).sortWithinPartitions(*keys, "c", "content")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi, c, content, sets), begins, sizes in common.segments(batches, 3):
            s = np.frombuffer(b"".join(sets), np.uint64).reshape(len(sets), -1)
            full = (s != _NONE).sum(1)
            src, dst = [], []
            # Small groups together, pair by pair; the others each by a search that gives a forest.
            small = (sizes <= _SMALL) & (lo[begins] == hi[begins])
            for n in range(2, _SMALL + 1):
                g = begins[small & (sizes == n)]
                for i in range(n):
                    for j in range(i):
                        x, y = g + i, g + j
                        ok = content[x] != content[y]
                        ok[ok] = _close(s, full, x[ok], y[ok], similarity)
                        src += content[x[ok]].tolist()
                        dst += content[y[ok]].tolist()
            for i, n in zip(begins[~small].tolist(), sizes[~small].tolist(), strict=True):
                part = slice(i, i + n)
                _, once = np.unique(content[part], return_index=True)
                once = np.sort(once)
                split = int((c[part][once] == lo[i]).sum()) if lo[i] != hi[i] else 0
                a, b = _forest(s[part][once], content[part][once], similarity, split)
                src += a
                dst += b
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    roots = common.components(common.cut(grouped.mapInArrow(common.packed(compare), "src long, dst long").distinct()))
    common.release(spark)
    named = windows.select("content", "doc_id", "pos").join(roots, windows["content"] == roots["id"], "left").select("doc_id", "pos", F.coalesce("component_id", "content").alias("root"))
    firsts = named.groupBy("root").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("doc_id").alias("hi")).where("at.doc_id <> hi").select("root", F.col("at.doc_id").alias("rep"), F.col("at.pos").alias("rep_pos"))
    found = named.join(firsts, "root").where("doc_id <> rep").select("doc_id", "rep", "pos", "rep_pos").distinct()
    order = Window.partitionBy("doc_id", "rep").orderBy("pos", "rep_pos")
    apart = (F.col("pos") > F.lag("pos").over(order) + WINDOW + GAP) | (F.abs(F.col("pos") - F.lag("pos").over(order) - F.col("rep_pos") + F.lag("rep_pos").over(order)) > GAP)
    spans = found.withColumn("new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(order)).groupBy("doc_id", "rep", "span")
    spans = spans.agg(F.min("pos").alias("lo"), (F.max("pos") + WINDOW).alias("hi"), F.min_by("rep_pos", "pos").alias("rep_lo"), (F.max_by("rep_pos", "pos") + WINDOW).alias("rep_hi"))
    spans = common.cut(spans.select("doc_id", "lo", "hi", "rep", "rep_lo", "rep_hi"))
    # Windows and their shuffles aren't needed any more.
    common.remove(spark, at)
    common.release(spark)
    runs = common.cut(runs_of(spans, source, similarity).where(F.col("hi") - F.col("lo") >= min_words).distinct())
    others = _merged(runs, ["doc_id", "rep"], "lo", "hi", F.min("rep_lo").alias("rep_lo"))
    kept = common.cut(_merged(runs.select("rep", "rep_lo", "rep_hi").distinct(), ["rep"], "rep_lo", "rep_hi"))
    spot = kept.select(F.col("rep").alias("r"), F.col("rep_lo").alias("a"), F.col("rep_hi").alias("z"))
    others = others.join(spot, (F.col("rep") == F.col("r")) & (F.col("rep_lo") >= F.col("a")) & (F.col("rep_lo") < F.col("z")))
    out = others.select("doc_id", F.col("rep").alias("component_id"), F.col("a").alias("component_start"), F.col("lo").alias("start_word"), (F.col("hi") - F.col("lo")).alias("n_words"), F.lit(False).alias("kept"))
    return out.unionByName(kept.select(F.col("rep").alias("doc_id"), F.col("rep").alias("component_id"), F.col("rep_lo").alias("component_start"), F.col("rep_lo").alias("start_word"), (F.col("rep_hi") - F.col("rep_lo")).alias("n_words"), F.lit(True).alias("kept")))


def drop_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and repeated_passages() -> row (the row as it came), text without the runs that aren't kept.

    Words and the white space after them go; the rest of the text stays as it is. Other rows keep their text.
    """
    runs = spans.where("not kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("cuts"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).join(runs, "doc_id", "left")
    # Pieces: a word with the space that follows it, the first with what stands before it as well.
    pieces = F.regexp_extract_all("t", F.lit(r"(^[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    left = F.filter(pieces, lambda x, i: ~F.exists("cuts", lambda c: (i >= c["start_word"]) & (i < c["start_word"] + c["n_words"])))
    return rows.select("row", F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.array_join(left, "")).alias("text"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.documents(spark, sf_dir))


QUERIES = {"op4_passages": op4_passages}
