"""Toxicity: a lexicon learned from labels, found however it is spelled, and weighed by the words around each place."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .lexicon import _EDGE, Lexicon

#: The classifier is fitted on the documents of so many labelled rows at most, chosen by a hash of doc_id.
MAX_LABELLED = 8192
#: Terms that are considered and that the lexicon holds at most; letters of a stem; documents and evidence that a term needs.
MAX_CANDIDATES, MAX_TERMS, STEM, MIN_DOCS, MIN_EVIDENCE, MIN_ODDS = 50_000, 500, (4, 12), 3, 14.0, 1.2
#: Candidates with the most evidence whose documents are looked up; what a document counts for a term if it holds a better one;
#: MinHashes of three-word shingles, of which near copies share one.
MAX_PLACED, COVERED, SIGNS = 2000, 0.5, 4
#: Misspelled forms that clean documents hold, kept at most.
MAX_KNOWN = 20_000
#: Words before and after a place that tell quotation from abuse; before it, that report or address.
WINDOW, REPORT, ADDRESS = 12, 4, 3
SCORE = "toxic_score"
THRESHOLD = 0.3
_OPEN, _CLOSE = "\"'“„‘‚«‹»›", "\"'”“’‘»›«‹"
_REPORTS = frozenset("said says saying say wrote writes called calls calling word words term terms quote quoted quoting quotes slur slurs insult insults means meaning reported allegedly sagte sagt schrieb nannte wort dit disait appelle mot dijo dice llama palabra".split())
_ADDRESSES = frozenset("you your you're youre yourself u ur du dich dein ihr euch tu toi vous votre tú te usted ustedes".split())


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _clean(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower()


def mention(words: list[bytes], i: int) -> float:
    """How likely the word at i is quoted or reported (0 to 1), or, if it is addressed to somebody, -1.

    Within quotation marks that open and close in the window it is quoted; a word of saying just before makes
    a report; a word of address near it, outside quotation, makes it abuse.
    """
    near = [_clean(w).rstrip(".,;:!?") for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
    at = min(i, WINDOW)
    opened = False
    for j in range(at, -1, -1):
        if j < at and len(near[j]) > 1 and near[j][-1] in _CLOSE:
            break
        if near[j] and near[j].lstrip("([{")[:1] and near[j].lstrip("([{")[0] in _OPEN:
            opened = True
            break
    closed = opened and any(w and w.rstrip(")]}")[-1:] and w.rstrip(")]}")[-1] in _CLOSE for w in near[at:])
    around = [w.strip(_EDGE) for w in near]
    reported = any(w in _REPORTS for w in around[max(0, at - REPORT) : at])
    if opened and closed:
        return 0.95 if reported else 0.9
    if any(w in _ADDRESSES for w in [*around[max(0, at - ADDRESS) : at], *around[at + 1 : at + 1 + ADDRESS]]):
        return -1.0
    return 0.6 if reported else 0.0


@dataclass
class Model:
    """The lexicon with its weights, as they are spelled and misspelled, and the weights of a document's evidence."""

    terms: list[tuple[str, bool]]
    weights: np.ndarray  # (terms, 2)
    known: frozenset[str]
    beta: np.ndarray
    lexicon: Lexicon | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None}

    def features(self, text: bytes) -> np.ndarray:
        """Evidence by context (plain, mentioned, addressed), per word, kinds of terms, and length, of a whole text."""
        if self.lexicon is None:
            self.lexicon = Lexicon(self.terms, self.known)
        words = text.split()
        plain = told = direct = 0.0
        kinds = set()
        for i, (t, wrong, _) in self.lexicon.hits(words):
            w, m = self.weights[t, int(wrong)], mention(words, i)
            if m < 0:
                direct += w
            else:
                plain, told = plain + w * (1 - m), told + w * m
            if w > 1 and m < 0.5:
                kinds.add(t)
        n = max(1, len(words))
        return np.array([np.log1p(plain + direct), np.log1p(told), np.log1p(direct), min(1.0, 10 * (plain + direct) / n), np.log1p(len(kinds)), np.log1p(n) / 10, 1.0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


#: Coefficients that a document's evidence has without labels; labels move them from here.
_PRIOR = np.array([2.0, 0.1, 0.5, 2.0, 0.5, -1.0, -3.0])
_RIDGE = np.array([2.0, 5.0, 2.0, 0.5, 2.0, 1.0, 2.0])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for logistic regression with a ridge around _PRIOR."""
    beta = _PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + np.diag(_RIDGE), x.T @ (p - y) + _RIDGE * (beta - _PRIOR))
        beta = beta - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _words(text: bytes) -> Counter:
    out: Counter = Counter()
    for t, n in Counter(text.split()).items():
        w = _clean(t).strip(_EDGE)
        if w:
            out[w] += n
    return out


def _terms(text: bytes) -> dict[str, int]:
    """A text's words, with $ at the end, and their beginnings, with their counts: candidates of the lexicon."""
    out: dict[str, int] = {}
    for w, n in _words(text).items():
        out[w + "$"] = n
        for k in range(STEM[0], min(len(w), STEM[1]) + 1):
            out[w[:k]] = out.get(w[:k], 0) + n
    return out


def _signs(text: bytes) -> list[int]:
    import xxhash

    words = text.lower().split()
    shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh3_64_intdigest(s, k) for s in shingles) >> 1 for k in range(SIGNS)]


def _evidence(a, b, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood ratio, log odds ratio) of terms in a toxic and b clean documents."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    rate = (a + b) / max(1.0, n_toxic + n_clean)
    parts = [np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(rate * n, 1e-9)), 0) for k, n in ((a, n_toxic), (b, n_clean), (n_toxic - a, 0), (n_clean - b, 0)) if n]
    miss = [np.where(n - k > 0, (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum((1 - rate) * n, 1e-9)), 0) for k, n in ((a, n_toxic), (b, n_clean))]
    return 2 * sum([*parts, *miss]), np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))


def ranked_terms(words: list[str], a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> list[int]:
    """Places of the candidates by falling evidence. a, b: (words, 2) toxic and clean documents that hold a term at all, and more
    than once; the better of the two is its evidence. Of words in equally many documents the longest comes first."""
    g = np.maximum(*[_evidence(a[:, k], b[:, k], n_toxic, n_clean)[0] for k in (0, 1)])
    odds = np.maximum(*[_evidence(a[:, k], b[:, k], n_toxic, n_clean)[1] for k in (0, 1)])
    every = _evidence(a[:, 0], b[:, 0], n_toxic, n_clean)[1]
    fit = np.flatnonzero((a[:, 0] >= MIN_DOCS) & (g >= MIN_EVIDENCE) & (odds >= MIN_ODDS) & (every >= 1))
    return sorted(fit.tolist(), key=lambda i: (-round(float(g[i]), 6), -len(words[i]), words[i]))[:MAX_PLACED]


def chosen_terms(words: list[str], a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int, order: list[int], places: list[list[int]]) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """Of a term and its own beginnings and continuations that with the most evidence, if toxic documents without a better
    term need it. places: the groups of near copies among the toxic documents that hold each candidate of order; a group counts
    once. -> terms (text, stem), their log odds."""
    taken: set[str] = set()  # chosen terms, and all beginnings of chosen terms
    ends: set[str] = set()
    out, covered = [], set()
    for i, docs in zip(order, places, strict=True):
        w = words[i]
        if w in taken or any(w[:k] in ends for k in range(1, len(w))):
            continue
        groups = set(docs)
        count = sum(1.0 if d not in covered else COVERED for d in groups)
        share = count / max(1, len(docs))
        if count < MIN_DOCS or max(float(_evidence(a[i, k] * share, b[i, k], n_toxic, n_clean)[0]) for k in (0, 1)) < MIN_EVIDENCE:
            continue
        ends.add(w)
        taken.update(w[:k] for k in range(1, len(w) + 1))
        covered.update(docs)
        out.append(i)
        if len(out) == MAX_TERMS:
            break
    odds = _evidence(a[out, 0], b[out, 0], n_toxic, n_clean)[1] if out else np.zeros(0)
    return [(words[i].removesuffix("$"), not words[i].endswith("$")) for i in out], odds


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, label: str = "toxic") -> Model:
    """Learns from documents with a label whose crc32(doc_id as text) mod 4 isn't 2; at most max_labelled of them.

    Rows without doc_id or label, and labels other than 0 and 1, teach nothing; of a document's repeated labels the
    largest counts, of its repeated rows each. The sample's texts stay in the shared folder; the driver gets at most
    MAX_CANDIDATES counted terms, MAX_KNOWN forms, which of MAX_PLACED terms a sampled toxic document holds, and a
    few numbers a sampled document.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = common.cut(known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = common.cut(texts.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def counted(wanted=None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n: Counter = Counter()
                twice: Counter = Counter()
                for t in common.texts(b.column(0)):
                    got = {w: k for w, k in _terms(t).items() if wanted is None or w in wanted.value}
                    n.update(got.keys())
                    twice.update(w for w, k in got.items() if k > 1)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([twice[w] for w in n], pa.int64())], ["term", "n", "twice"])

        return work

    def totals(y: int, wanted=None) -> DataFrame:
        return sample.where(F.col("y") == y).select("text").mapInArrow(counted(wanted), "term string, n long, twice long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("twice").alias("twice"))

    got = totals(1).where(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES).toArrow().to_pydict()
    wanted = spark.sparkContext.broadcast(frozenset(got["term"]))
    clean = {t: (n, k) for t, n, k in zip(*totals(0, wanted).toArrow().to_pydict().values(), strict=True)}
    wanted.destroy()
    a, b = np.array([got["n"], got["twice"]], float).T.reshape(-1, 2), np.array([clean.get(t, (0, 0)) for t in got["term"]], float).reshape(-1, 2)
    order = ranked_terms(got["term"], a, b, n_toxic, n_clean)
    place = spark.sparkContext.broadcast({got["term"][i]: k for k, i in enumerate(order)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in common.texts(b.column(0)):
                rows.append((_signs(t), sorted(place.value[w] for w in _terms(t) if w in place.value)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32())))], ["signs", "at"])

    toxic = sample.where("y = 1").select("text").mapInArrow(held, "signs array<long>, at array<int>").toArrow().to_pylist() if order else []
    place.destroy()
    places: list[list[int]] = [[] for _ in order]
    first: dict[tuple[int, int], int] = {}
    for n, row in enumerate(toxic):
        group = min((first[k, v] for k, v in enumerate(row["signs"]) if (k, v) in first), default=n)
        for k, v in enumerate(row["signs"]):
            first.setdefault((k, v), group)
        for k in row["at"]:
            places[k].append(group)
    terms, odds = chosen_terms(got["term"], a, b, n_toxic, n_clean, order, places)

    # Misspelled forms: those that clean documents use are words of their own; the others count as the term's labels say.
    lexicon = spark.sparkContext.broadcast(terms)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(lexicon.value)
        for b in batches:
            n: Counter = Counter()
            for y, t in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                n.update((y, h[0], h[2]) for h in {h for _, h in lex.hits(list(set(t.split()))) if h[1]})
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.int32()), pa.array([k[2] for k in n]), pa.array(list(n.values()), pa.int64())], ["y", "term", "form", "n"])

    seen = sample.select("y", "text").mapInArrow(forms, "y int, term int, form string, n long").groupBy("term", "form").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "a"), (0, "b"))])
    seen = common.cut(seen)
    own = (F.col("b") >= 1) & (F.col("a") * n_clean <= 3 * F.col("b") * max(1, n_toxic))
    words = frozenset(seen.where(own).orderBy(F.desc("b"), "form").limit(MAX_KNOWN).toArrow().column("form").to_pylist())
    rest = {r["term"]: (r["a"], r["b"]) for r in seen.where(~own).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}  # a row a term
    known_forms = {r["term"]: r["b"] for r in seen.where(own).groupBy("term").agg(F.sum("b").alias("b")).collect()}
    weights = np.zeros((len(terms), 2))
    for t in range(len(terms)):
        a, b_ = rest.get(t, (0, 0))
        weights[t, 0] = np.clip(odds[t], 0, 6)
        # A term that many clean words lie near has many more such words that the sample doesn't show.
        trust = (a + 2) / (a + b_ + 2 + 0.1 * known_forms.get(t, 0))
        weights[t, 1] = weights[t, 0] * 0.8 * trust
    model = Model(terms, weights, words, _PRIOR.copy())
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = [shared.value.features(t).tobytes() for t in common.texts(b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    table = sample.mapInArrow(rows, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "x").limit(max_labelled).toArrow()
    lexicon.destroy()
    if table.num_rows:
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), float).reshape(-1, len(_PRIOR))
        model.beta = _logistic(x, table.column("y").to_numpy().astype(float))
    shared.destroy()
    return model


def classify(docs: DataFrame, model: Model, score: str = SCORE) -> DataFrame:
    """The rows of docs (doc_id, text and whatever else) and score, 0 to 1.

    A column of docs that has the name `score` is replaced. Each whole text is read once, a batch at a time; null is
    empty, and a very long one is one text in memory. Each row gives a row; repeated rows score alike. Labels, lang,
    source and doc_id are no inputs. Without labels the lexicon is empty and texts score by length alone. The model is
    bounded by MAX_TERMS and MAX_KNOWN; nothing is shuffled.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    names = docs.columns
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(_PRIOR)))
            for k, t in enumerate(common.texts(b.column(at))):
                x[k] = shared.value.features(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], [*names, score])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(work, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs, model).select("doc_id", F.col(SCORE).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
