"""Language-model scores: an add-one word model, and a causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A word is broadcast if it makes up 1/HEAVY of the training tokens at least, so no more than HEAVY words are.
HEAVY = 1_000_000
#: Places of a window, output classes, pairs of classes with values of their own, classes and bands of pairs by which
#: places are matched, width of queries and keys. Values are tables of CLASSES + PAIRS + PLACES * COARSE rows.
PLACES, CLASSES, PAIRS, COARSE, BANDS, WIDTH = 6, 1024, 4096, 256, 16, 16
#: What a window attends to: the sink, the own place by its class, the own place by its pair, the places before.
SLOTS = PLACES + 2
#: A row's values begin with a more general distribution, as if so many tokens had been seen.
SMOOTH = 4.0
#: A document's tokens are stored in runs of so many; so many are held at a time, and so many are a step of training.
RUN, HELD, STEP, RATE, SEED = 65_536, 262_144, 8192, 0.05, 5
_BEGIN, _PAD, _END = CLASSES, CLASSES + 1, 0
_CACHE, _SLICE = 400_000, 2 << 20
#: Cells of a block of counts; tasks whose parameters are averaged at once.
_BLOCK, _FAN = 1 << 16, 512
_HIDDEN = np.float32(-1e9)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A byte-level BPE from a file of ranks. A piece is a space and what follows it up to the next."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("words", pat_str=r" [^ ]*", mergeable_ranks=ranks, special_tokens={}), max(ranks.values())


def shipped(path: str) -> str:
    """Where an executor has the file that the driver sent along."""
    return SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=2)
def _begins(path: str) -> np.ndarray:
    """Which ids from 1 are of tokens that begin with a space."""
    encoding, most = tokenizer(path)
    return np.array([False] + [encoding.decode_single_token_bytes(k)[:1] == b" " for k in range(most + 1)])


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids from 1 of each word with a space before it, end to end, and each word's number of them; 0 is left for the end.

    Words hold no space of ASCII, so all are encoded at once, a piece each, and a token with a space begins a word.
    """
    ids = np.array(tokenizer(path)[0].encode_ordinary("".join([" " + w.decode("utf-8", "replace") for w in words])), np.int32) + 1
    at = np.flatnonzero(_begins(path)[ids])
    return ids, np.diff(np.append(at, len(ids)))


def _kind(path: str) -> type:
    return np.uint16 if tokenizer(path)[1] + 2 <= 1 << 16 else np.int32


# --- The attention model -------------------------------------------------------------------------------------------


def shapes() -> dict[str, tuple[int, ...]]:
    """Queries by the class of the last token; keys of the own place, of its pair's band and of the places before."""
    return {"q": (COARSE, WIDTH), "own": (COARSE, WIDTH), "pair": (BANDS, WIDTH), "far": (COARSE, WIDTH), "bias": (COARSE, SLOTS), "place": (SLOTS,)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = math.prod(s)
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = {k: rng.normal(0, 0.1, s) for k, s in shapes().items()}
    parts["bias"] *= 0
    parts["place"] = np.array([-3.0, 0.0, 2.0] + [-2.0] * (PLACES - 1))
    return np.concatenate([p.ravel() for p in parts.values()]).astype(np.float32)


#: Classes, the begin mark and the pad -> classes by which places are matched. Classes go by falling frequency.
_COARSE_OF = np.append(np.minimum(np.arange(CLASSES), COARSE - 2), [COARSE - 1, COARSE])


@dataclass
class Model:
    """What a task needs: each subword's class and log10 share of it, values, parameters, the heavy words' base scores.

    values: probabilities of the next class for each row of a slot (own, pair, then the places before); sizes: what
    each row's probabilities were divided by. row: the pair slot's row of (class before, class), 0 where it has none.
    """

    path: str
    of: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    row: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES + 2, CLASSES + 2), np.int16))
    band: np.ndarray = field(default_factory=lambda: np.full(PAIRS + 1, BANDS))
    values: list[np.ndarray] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    flat: np.ndarray = field(default_factory=initial)
    heavy: dict[bytes, float] = field(default_factory=dict)


class Texts:
    """Texts' classes end to end, before each PLACES - 1 pads and the begin mark, as indices into a model's tables.

    valid: which tokens are targets. A target's window is the PLACES tokens before it, so each target has its own, which
    overlaps the next one's in all places but one; pads are masked.
    """

    def __init__(self, m: Model, classes: np.ndarray, lengths: np.ndarray, skips: np.ndarray | int = 0):
        at = np.arange(len(classes)) + np.repeat(PLACES * np.arange(1, len(lengths) + 1), lengths)
        begins = np.cumsum(lengths + PLACES) - lengths
        self.c = np.full(len(classes) + PLACES * len(lengths), _PAD)
        self.c[begins - 1] = _BEGIN
        self.c[at] = classes
        self.valid = np.zeros(len(self.c), bool)
        self.valid[at] = np.arange(len(classes)) >= np.repeat(np.cumsum(lengths) - lengths + skips, lengths)
        self.y = np.minimum(self.c, CLASSES - 1)
        self.own = np.minimum(self.c, _BEGIN)
        self.z = _COARSE_OF.take(self.c)
        self.far = np.minimum(self.z, COARSE - 1)
        self.pair = np.zeros(len(self.c), np.int64)
        self.pair[1:] = m.row.ravel().take(self.c[:-1] * (CLASSES + 2) + self.c[1:])
        self.band = m.band.take(self.pair)

    def steps(self, size: int) -> Iterator[tuple[int, int]]:
        for lo in range(PLACES, len(self.c), size):
            yield lo, min(len(self.c), lo + size)

    def rows(self, lo: int, hi: int) -> list[np.ndarray]:
        """Of each slot after the sink, the row of its values that the targets lo to hi look at."""
        return [self.own[lo - 1 : hi - 1], self.pair[lo - 1 : hi - 1], *(self.far[lo - 1 - d : hi - 1 - d] for d in range(1, PLACES))]


def tables(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Attention scores of each slot, by the class of the query and the key (the own place's is the query's); hidden
    where the key is a pad or there is no pair."""
    scale = np.float32(1 / math.sqrt(WIDTH))
    by = p["bias"] + p["place"]
    hidden = np.full((COARSE, 1), _HIDDEN, np.float32)
    pair, far = ((p["q"] @ p[k].T) * scale for k in ("pair", "far"))
    return [by[:, 0].copy(), (p["q"] * p["own"]).sum(1) * scale + by[:, 1], np.hstack([pair + by[:, 2:3], hidden]), *(np.hstack([far + by[:, j : j + 1], hidden]) for j in range(3, SLOTS))]


def attend(m: Model, scores: list[np.ndarray], t: Texts, lo: int, hi: int, leave_out: bool = False) -> tuple[np.ndarray, ...]:
    """For the targets lo to hi: weights (SLOTS, n) of a masked softmax, the slots' probabilities of the targets, and
    places in the scores of the slots that have a table of them.

    The model's probability of a target is the weighted sum of its slots' probabilities. leave_out: values are those
    of all other tokens, as training must see them.
    """
    y, q, rows = t.y[lo:hi], t.far[lo - 1 : hi - 1], t.rows(lo, hi)
    wide = q * (COARSE + 1)
    at = [q * (BANDS + 1) + t.band[lo - 1 : hi - 1], *(wide + t.z[lo - 1 - d : hi - 1 - d] for d in range(1, PLACES))]
    s, v = np.empty((SLOTS, hi - lo), np.float32), np.empty((SLOTS, hi - lo), np.float32)
    s[0], v[0] = scores[0].take(q), m.prior.take(y)
    for j in range(1, SLOTS):
        s[j] = scores[j].take(at[j - 2] if j > 1 else q)
        v[j] = m.values[j - 1].take(rows[j - 1] * CLASSES + y)
        if leave_out:
            n = m.sizes[j - 1].take(rows[j - 1])
            v[j] *= n
            v[j] -= 1
            v[j] /= n - 1
    if leave_out:
        np.maximum(v, np.float32(1e-9), out=v)
    s -= s.max(0)
    np.exp(s, out=s)
    s /= s.sum(0)
    return s, v, q, at


def gradient(m: Model, flat: np.ndarray, t: Texts, lo: int, hi: int) -> np.ndarray:
    """Of the mean negative log probability over the valid targets from lo to hi, each left out of its values."""
    p, valid = unpack(flat), t.valid[lo:hi]
    s, v, q, at = attend(m, tables(p), t, lo, hi, True)
    g = s * (1 - v / (s * v).sum(0))
    g *= (valid / max(1, valid.sum())).astype(np.float32)
    scale = np.float32(1 / math.sqrt(WIDTH))

    def met(where: list[np.ndarray], by: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(np.concatenate(where), by.ravel(), COARSE * (n + 1)).reshape(COARSE, n + 1)[:, :n].astype(np.float32) * scale

    bias = np.bincount((q + COARSE * np.arange(SLOTS)[:, None]).ravel(), g.ravel(), COARSE * SLOTS).reshape(SLOTS, COARSE).T.astype(np.float32)
    own, pair, far = bias[:, 1:2] * scale, met(at[:1], g[2], BANDS), met(at[1:], g[3:], COARSE)
    parts = {
        "q": own * p["own"] + pair @ p["pair"] + far @ p["far"], "own": own * p["q"], "pair": pair.T @ p["q"], "far": far.T @ p["q"],
        "bias": bias, "place": bias.sum(0),
    }
    return np.concatenate([parts[k].ravel() for k in shapes()])


def log_probabilities(m: Model, t: Texts) -> np.ndarray:
    """log10 of P(class | tokens before it in its text) of all targets."""
    scores, out = tables(unpack(m.flat)), np.empty(len(t.c))
    for lo, hi in t.steps(STEP):
        s, v, *_ = attend(m, scores, t, lo, hi)
        s *= v
        out[lo:hi] = np.log10(s.sum(0))
    return out[t.valid]


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of subword ids -> class, log10 of the share in its class, class shares. All by add-one counts.

    The most frequent ids are a class each, by falling count; all others share the last class.
    """
    of = np.empty(len(counts), np.int64)
    of[np.argsort(-counts, kind="stable")] = np.minimum(np.arange(len(counts)), CLASSES - 1)
    total = np.bincount(of, counts + 1.0, CLASSES)
    return of, np.log10((counts + 1) / total[of]).astype(np.float32), (total / total.sum()).astype(np.float32)


def with_pairs(m: Model, own: np.ndarray) -> Model:
    """own: counts of (class, next class). The PAIRS most frequent pairs get rows; bands go by the logarithm of the count."""
    n = own[:CLASSES].ravel()
    top = np.argsort(-n, kind="stable")[:PAIRS]
    top = top[n[top] > 1]
    m.row[top // CLASSES, top % CLASSES] = np.arange(1, len(top) + 1)
    m.band[1 : len(top) + 1] = np.minimum(np.log2(n[top]) / 2, BANDS - 1)
    return m


def with_values(m: Model, counts: list[np.ndarray]) -> Model:
    """Counts of (row, next class) -> values: a class's and a distant class's begin with the corpus shares, a pair's with its class's."""
    for k, c in enumerate(counts):
        n = (c.sum(1) + SMOOTH).astype(np.float32)
        v = c.astype(np.float32)
        if k == 1:
            pairs = np.nonzero(m.row)
            own = np.zeros(len(v), np.int64)
            own[m.row[pairs]] = pairs[1]
            for i in range(0, len(v), 1024):
                v[i : i + 1024] += np.float32(SMOOTH) * m.values[0][own[i : i + 1024]]
        else:
            v += np.float32(SMOOTH) * m.prior
        v /= n[:, None]
        m.values.append(v), m.sizes.append(n)
    return m


# --- Passes over the training tokens ---------------------------------------------------------------------------------


def runs_of(seq: np.ndarray) -> list[tuple[int, bytes]]:
    """A document's tokens, the end among them -> runs: how many leading tokens only give context, and the ids."""
    return [(min(i, PLACES), seq[max(0, i - PLACES) : i + RUN].tobytes()) for i in range(0, len(seq), RUN)]


def laid(batches: Iterator[pa.RecordBatch], m: Model, kind: type) -> Iterator[Texts]:
    """(skip, run) rows -> about HELD tokens at a time."""
    seqs: list[np.ndarray] = []
    skips: list[int] = []
    size = 0

    def out() -> Texts:
        return Texts(m, m.of.take(np.concatenate(seqs)), np.fromiter(map(len, seqs), np.int64, len(seqs)), np.array(skips))

    for b in batches:
        for skip, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            seqs.append(np.frombuffer(run.as_buffer(), kind))
            skips.append(skip)
            size += len(seqs[-1])
            if size >= HELD:
                yield out()
                seqs, skips, size = [], [], 0
    if seqs:
        yield out()


def _sums(runs: DataFrame, m: Model, cells: int, picked: Callable[[Texts, int, int], list[np.ndarray]]) -> np.ndarray:
    """How often picked(texts, from, to) names each of the cells, over all runs.

    A task counts its own runs in one array and gives what isn't zero, by blocks; blocks are summed by tasks as they
    stream in. The sums, of a fixed number of cells, reach the driver.
    """
    shared = runs.sparkSession.sparkContext.broadcast(m)

    def rows(block: int, n: np.ndarray) -> tuple[int, bytes, bytes]:
        at = np.flatnonzero(n)
        return block, at.astype(np.uint16).tobytes(), n[at].astype(np.int64).tobytes()

    def given(found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        a, b, c = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["b", "i", "n"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(-(-cells // _BLOCK) * _BLOCK, np.uint32)
        for t in laid(batches, m, _kind(shipped(m.path))):
            for lo, hi in t.steps(4 * STEP):
                for at in picked(t, lo, hi):
                    np.add.at(total, at, np.uint32(1))
        for k in range(0, len(total) // _BLOCK, 16):
            found = [rows(j, total[j * _BLOCK : (j + 1) * _BLOCK]) for j in range(k, min(k + 16, len(total) // _BLOCK))]
            if found := [r for r in found if r[1]]:
                yield given(found)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, i, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                at = np.frombuffer(i.as_buffer(), np.uint16)
                total.setdefault(k, np.zeros(_BLOCK, np.int64))[at] += np.frombuffer(n.as_buffer(), np.int64)
        for k, n in total.items():
            yield given([rows(k, n)])

    kind = "b long, i binary, n binary"
    out = np.zeros(-(-cells // _BLOCK) * _BLOCK, np.int64)
    for b, i, n in runs.mapInArrow(local, kind).repartition("b").mapInArrow(combine, kind).toLocalIterator():
        out[b * _BLOCK + np.frombuffer(i, np.uint16).astype(np.int64)] = np.frombuffer(n, np.int64)
    shared.destroy()
    return out[:cells]


def _own_cells(t: Texts, lo: int, hi: int) -> list[np.ndarray]:
    return [(t.own[lo - 1 : hi - 1] * CLASSES + t.y[lo:hi])[t.valid[lo:hi]]]


def _other_cells(t: Texts, lo: int, hi: int) -> list[np.ndarray]:
    """Cells of the pairs' table, then of the tables of the places before; what is masked counts nowhere."""
    _, pair, *far = t.rows(lo, hi)
    y, valid = t.y[lo:hi], t.valid[lo:hi]
    out = [(pair * CLASSES + y)[valid & (pair > 0)]]
    for d, r in enumerate(far, 1):
        out.append((r * CLASSES + y + (PAIRS + 1 + (d - 1) * COARSE) * CLASSES)[valid & (t.z[lo - 1 - d : hi - 1 - d] < COARSE)])
    return out


def _trained(runs: DataFrame, m: Model) -> np.ndarray:
    """Parameters after one pass over all runs: each task passes over its own, by Adam; tasks' parameters, each the mean
    over its steps, later ones weighing more, are averaged by targets, _FAN tasks at a time."""
    shared = runs.sparkSession.sparkContext.broadcast(m)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part = shared.value, TaskContext.get().partitionId()
        flat = m.flat.copy()
        a, v, mean = np.zeros_like(flat), np.zeros_like(flat), np.zeros(len(flat))
        n = t = 0
        for x in laid(batches, m, _kind(shipped(m.path))):
            for lo, hi in x.steps(STEP):
                targets = int(x.valid[lo:hi].sum())
                if not targets:
                    continue
                g = gradient(m, flat, x, lo, hi)
                t, n = t + 1, n + targets
                a += np.float32(0.1) * (g - a)
                v += np.float32(0.01) * (g * g - v)
                flat -= np.float32(RATE / math.sqrt(1 + t / 100) / (1 - 0.9**t)) * a / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-8))
                mean += (flat - mean) * (2 / (t + 1))
        if n:
            yield _weighed(part // _FAN, mean * n, n)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for g, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = sums.setdefault(g, [0.0, 0])
                s[0], s[1] = s[0] + np.frombuffer(p), s[1] + n
        for g, (p, n) in sums.items():
            yield _weighed(g // _FAN, p, n)

    kind = "g long, p binary, n long"
    rows = runs.mapInArrow(local, kind)
    for _ in range(2):
        rows = rows.repartition("g").mapInArrow(combine, kind)
    got = rows.collect()
    shared.destroy()
    total = sum(r["n"] for r in got)
    return (sum(np.frombuffer(r["p"]) for r in got) / total).astype(np.float32) if total else m.flat


def _weighed(group: int, p: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([p.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "p", "n"])


def learn(runs: DataFrame, counts: np.ndarray, path: str) -> Model:
    """The attention model of stored runs (skip, run) and the counts of their subword ids.

    Three passes over all tokens: pairs of classes are counted; then what follows the frequent pairs and each of the
    places before; then queries, keys and biases are trained, with each target left out of the values it looks at.
    """
    m = Model(path, *classes_of(counts))
    own = _sums(runs, m, (CLASSES + 1) * CLASSES, _own_cells).reshape(CLASSES + 1, CLASSES)
    with_pairs(m, own)
    rows = PAIRS + 1 + (PLACES - 1) * COARSE
    other = _sums(runs, m, rows * CLASSES, _other_cells).reshape(rows, CLASSES)
    with_values(m, [own, other[: PAIRS + 1], *np.split(other[PAIRS + 1 :], PLACES - 1)])
    m.flat = _trained(runs, m)
    return m


# --- The corpus ----------------------------------------------------------------------------------------------------


def gather(docs: DataFrame, path: str) -> DataFrame:
    """Training documents (doc_id, text) -> rows of (word, c) partial counts and rows of (skip, run).

    The end is the empty word. Counts of a task are flushed when they hold _CACHE words, so memory is bounded. A
    document's runs hold its whole text and the end; one that isn't the first repeats the PLACES tokens before it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shipped(path)
        kind, seen, total, ends = _kind(local), _Words(local), np.zeros(0, np.int64), 0

        def counts() -> pa.RecordBatch:
            n = len(total) + 1
            return pa.RecordBatch.from_arrays([pa.array([*seen.names, b""], pa.binary()), pa.array(np.append(total, ends)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["word", "c", "skip", "run"])

        for b in batches:
            for docs_words in _sliced(common.texts(b.column(1))):
                sizes = np.fromiter(map(len, docs_words), np.int64, len(docs_words))
                w = seen.look_up([w for ws in docs_words for w in ws])
                total = np.append(total, np.zeros(len(seen.names) - len(total), np.int64)) + np.bincount(w, minlength=len(seen.names))
                ends += len(sizes)
                subs, lengths = seen.sequences(w, sizes)
                runs = [r for s in np.split(subs.astype(kind), np.cumsum(lengths)[:-1]) for r in runs_of(s)]
                n = len(runs)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([s for s, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], ["word", "c", "skip", "run"])
                if len(seen.names) > _CACHE:
                    yield counts()
                    seen.clear()
                    total, ends = np.zeros(0, np.int64), 0
        if ends:
            yield counts()

    return docs.mapInArrow(work, "word binary, c long, skip int, run binary")


def _subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """Counts of subword ids over all training words; a row for each id, at most the vocabulary, reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shipped(path)
        total = np.zeros(tokenizer(local)[1] + 2, np.int64)
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            end = np.array([not w for w in words], bool)
            total[_END] += int(c[end].sum())
            ids, n = subwords([w for w in words if w], local)
            total += np.bincount(ids, np.repeat(c[~end], n), len(total)).astype(np.int64)
        found = np.flatnonzero(total)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["i", "c"])

    got = words.mapInArrow(work, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(tokenizer(path)[1] + 2)
    out[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return out


class _Ids(dict):
    """Words -> numbers by first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Words:
    """A task's words seen so far: subword ids and base scores of heavy ones (NaN for others), for numpy to gather."""

    def __init__(self, path: str, heavy: dict[bytes, float] | None = None):
        self.path, self.heavy = path, heavy or {}
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids()
        self.base, self.start, self.count = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.subs = np.zeros(0, np.int32)
        self.names: list[bytes] = []

    def look_up(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        new = list(islice(self.ids, len(self.names), None))
        subs, counts = subwords(new, self.path)
        self.start = np.concatenate([self.start, len(self.subs) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.subs = np.concatenate([self.subs, subs])
        self.base = np.concatenate([self.base, np.fromiter((self.heavy.get(w, math.nan) for w in new), float, len(new))])
        self.names += new
        return out

    def sequences(self, w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of texts of these sizes, end to end -> subword ids, an end after each text, and each text's number of them."""
        c = self.count[w]
        subs = self.subs[np.repeat(self.start[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        per = np.bincount(np.repeat(np.arange(len(sizes)), sizes), c, len(sizes)).astype(np.int64)
        return np.insert(subs, np.cumsum(per), _END), per + 1


def score_texts(m: Model, subs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of subword ids, which are laid end to end (each one's last is the end)."""
    each = log_probabilities(m, Texts(m, m.of.take(subs), lengths)) + m.share.take(subs)
    return np.add.reduceat(each, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)


def _sliced(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """Texts' words, some MB of text at a time or one text."""
    held: list[list[bytes]] = []
    size = 0
    for t in texts:
        held.append(t.lower().split())
        size += len(t)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row.

    Training documents are those whose crc32(doc_id as text) mod 7 isn't 2; a null doc_id counts as an empty text of
    it, so it trains. Null texts are empty: one end. Without training documents N is 0 and every token has count 0.
    Repeated rows count and are scored each; other columns are ignored, and an empty table gives an empty one. A very
    long text is one document's words in memory; its tokens are stored and learned in runs.

    Word counts: each task counts its own, then one shuffle of counts. Frequent words' scores (a proven bound of
    HEAVY words) are broadcast; the rest of a document's words go as (row, word, tf) through one join with the
    counts. Subword counts come from the word counts. The attention model learns from every token of every training
    document, which are stored once as subword ids; see learn(). Its tables have a fixed size.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    spark.sparkContext.addFile(path)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))

    first = common.scratch(spark, "lm-corpus")
    gather(source.where(~F.col("held_out")).select("doc_id", "text"), path).write.option("compression", "zstd").parquet(first)
    kept = spark.read.parquet(first)
    counts = common.cut(kept.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base = math.log10(n + v + 1)
    heavy = counts.where(F.col("c") * HEAVY >= n).toArrow() if n else None
    table = dict(zip(heavy.column("word").to_pylist(), (np.log10(heavy.column("c").to_numpy() + 1) - base).tolist(), strict=True)) if n else {}
    model = learn(kept.where("run is not null").select("skip", "run"), _subword_counts(counts, path), path)
    common.remove(spark, first)
    model.heavy = table
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, row = shared.value, TaskContext.get().partitionId() << 36, 0
        seen = _Words(shipped(path), model.heavy)
        ends = model.heavy.get(b"", math.nan)
        for b in batches:
            at = 0
            for docs_words in _sliced(common.texts(b.column(1))):
                ids, held = b.column(0).slice(at, len(docs_words)), b.column(2).slice(at, len(docs_words))
                at += len(docs_words)
                sizes = np.fromiter(map(len, docs_words), np.int64, len(docs_words))
                w = seen.look_up([w for ws in docs_words for w in ws])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                known = ~np.isnan(seen.base[w])
                partial = np.bincount(doc[known], seen.base[w[known]], len(sizes)) + (0.0 if math.isnan(ends) else ends)
                n_known = np.bincount(doc[known], minlength=len(sizes)) + (not math.isnan(ends))
                scores = score_texts(model, *seen.sequences(w, sizes))
                rows = part + row + np.arange(len(sizes))
                row += len(sizes)
                # What isn't heavy: one row for each word of a document.
                pairs, tf = np.unique(doc[~known] * (len(seen.names) + 1) + w[~known], return_counts=True)
                rest = [seen.names[i] for i in (pairs % (len(seen.names) + 1)).tolist()]
                tail_rows = rows[pairs // (len(seen.names) + 1)]
                if math.isnan(ends):
                    rest, tf, tail_rows = rest + [b""] * len(rows), np.concatenate([tf, np.ones(len(rows), np.int64)]), np.concatenate([tail_rows, rows])
                a, z = len(rows), len(rest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, tail_rows])), pa.concat_arrays([ids, pa.nulls(z, pa.int64())]), pa.concat_arrays([held, pa.nulls(z, pa.bool_())]),
                        pa.concat_arrays([pa.array(sizes + 1), pa.array(tf.astype(np.int64))]), pa.concat_arrays([pa.array(n_known.astype(np.int64)), pa.nulls(z, pa.int64())]),
                        pa.concat_arrays([pa.array(partial), pa.nulls(z, pa.float64())]), pa.concat_arrays([pa.array(scores), pa.nulls(z, pa.float64())]), pa.array([None] * a + rest, pa.binary()),
                    ], ["row", "doc_id", "held_out", "n", "n_known", "base", "score", "word"],
                )
                if len(seen.names) > _CACHE:
                    seen.clear()

    second = common.scratch(spark, "lm-scores")
    source.mapInArrow(work, "row long, doc_id long, held_out boolean, n long, n_known long, base double, score double, word binary").write.parquet(second)
    scored = spark.read.parquet(second)
    tail = scored.where("word is not null").select("row", "word", F.col("n").alias("tf")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - base)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"))
    out = scored.where("word is null").join(tail, "row", "left")
    out = out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
    out = common.cut(out)
    shared.destroy()
    common.remove(spark, second)
    return out


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))


QUERIES = {"op6_lm": op6_lm}
