"""Toxicity, hard negatives and the prefix trie on small fixtures, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import negatives, toxicity, trie
from strandlake.llm.balltree import BallTree, Best
from strandlake.llm.lexicon import LOOK_ALIKES, Lexicon, edits

from ..compare import SF, duck, rows_of

TURNS = "conv_id long, turn long, role string, text string"


def test_queries_equal_their_sql(spark):
    for module in (negatives, trie):
        (name, sql), *_ = module.ORACLE.items()
        df = module.QUERIES[name](spark, SF)
        cur = duck().execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


# Prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    convs = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(q) == len(path) + 1 for q in under), len(leaves),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 90), 10**12, 10**12 + 5]:
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é€", "", None])))
    same = [(t, "user", f"long {t} " * 50) for t in range(12)]
    rows += [(c, *x) for c in range(200, 260, 5) for x in same]
    rows += [(None, 0, "user", "lost"), (0, 1, "user", "a"), (0, 1, "user", "a"), (91, 1, "user", "x" * 200_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("of the caller")).withColumn("k1", F.lit(1)).withColumn("n", F.lit(2))
    got = trie.prefix_trie(df.repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(40, t, "user", f"t{t}") for t in range(3000)] + [(c, 0, "user", "same") for c in range(100, 400)]
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert max(d for _, d in got) == 3000 and got[40, 0]["n_convs"] == 301 and got[40, 0]["parent_conv_id"] is None
    # Each borrows the one turn or keeps its own, the same.
    assert got[100, 1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(100, 400))).encode()).hexdigest()


def test_trie_without_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


# Hard negatives


def brute_negatives(rows, anchor, p, n):
    out = []
    rows = [(i, l, [int(x) for x in np.frombuffer(k, float)]) for i, l, k in rows]
    for a in rows:
        if anchor(a[0]):
            scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2]))
            for s, i, _ in [r for r in scored if r[2]][:p]:
                fit = [r for r in scored if not r[2] and -30 * s <= -100 * r[0] <= -90 * s][:n]
                out += [(a[0], i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("copies", [1, 40])
def test_hard_negatives_equal_brute_force(spark, copies):
    rng = np.random.default_rng(copies)
    base = rng.normal(size=(420 // copies, 6)) / 2
    rows = [(int(i), [float(x) for x in base[i % len(base)]], int(rng.integers(0, 5))) for i in rng.permutation(420)]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 6, 1), (503, [0.1] * 6, None), (None, [0.1] * 6, 1), (504, [0.5] * 3, 1), (505, [0.4] * 3, 2), (506, [0.9] * 3, 1), (507, [], 1), (508, [], 1), (509, [], 2)]
    rows += [(510 + 10 * k, [1e200 * (k + 1)] * 4, k % 2) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("clash")).withColumn("rank", F.lit(0))
    vectors = negatives.integer_vectors(df)
    held = [tuple(r) for r in vectors.collect()]
    assert {r[0] for r in held} == {*range(420), *range(504, 511), 520}
    got = negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, 4, 6, shards=3).collect()
    small = [r for r in held if r[0] < 510]
    assert sorted(tuple(r) for r in got if r["anchor_id"] < 510) == brute_negatives(small, lambda i: i % 10 == 0, 4, 6)


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(negatives.integer_vectors(df), F.col("vec_id") % 2 == 0).count() == 0


def test_ball_tree_prunes_and_finds_all(spark):
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.normal(size=(60, 12)), 100, 0) + rng.normal(size=(6000, 12)) / 30))
    ids, labels = rng.permutation(6000), rng.integers(0, 3, 6000)
    trees = [BallTree.load(BallTree(x[k::2], ids[k::2], labels[k::2]).dump()) for k in (0, 1)]
    q = np.arange(0, 6000, 97)
    edge = np.full(len(q), 2**62)
    best = Best(x[q], ids[q], labels[q], True, -edge, edge, 5)
    compared = sum(best.search(t) for t in trees)
    for j, a in enumerate(q):
        s = (x @ x[a]).astype(np.int64)
        want = [i for i in np.lexsort((ids, -s)) if labels[i] == labels[a] and i != a][:5]
        assert best.ids[j].tolist() == ids[want].tolist() and best.scores[j].tolist() == s[want].tolist()
    assert compared < 0.2 * len(q) * 6000


def test_copies_are_settled_by_their_ids(spark):
    x = np.ones((4096, 4))
    t = BallTree(x, np.arange(4096)[::-1].copy(), np.zeros(4096, np.int64))
    best = Best(x[:1], np.array([4095]), np.array([0]), True, np.array([-(2**62)]), np.array([2**62]), 5)
    assert best.search(t) < 512 and best.ids[0].tolist() == [0, 1, 2, 3, 4]


# Toxicity

TERMS = [("idiot", False), ("clown", False), ("disgusting", False), ("scum", False), ("bomente", True), ("chlla", True), ("worthless", False)]


def distances(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1] or b[j - 1] in LOOK_ALIKES.get(a[i - 1], "")
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return [r[-1] for r in d]


def test_the_automaton_finds_what_distances_say():
    rng = random.Random(1)
    lex = Lexicon(TERMS)
    for _ in range(4000):
        text, stem = rng.choice(TERMS)
        w = list(text) + list("xyz"[: rng.randint(0, 3)] if stem else "")
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(w)), rng.randint(0, 3)
            if kind == 0:
                w.insert(i, rng.choice("abcdeilo10t"))
            elif kind == 1 and len(w) > 1:
                w.pop(i)
            elif kind == 2:
                w[i] = rng.choice("abcdeilo10t")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        w = "".join(w)
        found = [(min(d) if s else d[-1], t) for t, (x, s) in enumerate(TERMS) for d in [distances(w, x)] if (min(d) if s else d[-1]) <= edits(len(x), s)]
        assert lex.nearest(w) == min(found, default=None), w


def test_context_tells_quotation_from_abuse():
    told = lambda s, w: toxicity.mention(s.encode().split(), s.split().index(w))
    assert told('the word "idiot" is rude', '"idiot"') > 0.9 and told("he wrote “ what an idiot ” on it", "idiot") >= 0.9
    assert told("they said idiot twice", "idiot") == 0.6 and told("you total idiot go home", "idiot") == -1 and told("what an idiot", "idiot") == 0


def planted(rng, i):
    words = [rng.choice(["lan", "tor", "mi", "ses", "ko"]) + rng.choice(["ra", "ven", "dil", "po"]) for _ in range(40)]
    kind = i % 4
    if kind == 0:
        for _ in range(3):
            words[rng.randrange(40)] = rng.choice(["grobnik", "shmeker", "vul" + rng.choice(["tan", "ter", "mo", "sip", "dax"])])
    return " ".join(words), int(kind == 0)


def test_toxicity_learns_terms_and_finds_misspellings(spark):
    rng = random.Random(4)
    rows = [(i, *planted(rng, i)) for i in range(800)]
    clean = "lanra torven midil sespo kora " * 5
    extra = [(900, clean + "grobnlk shmekre shmeeker"), (901, clean + "Grobnik! SHMEKER?"), (902, clean), (903, None), (904, ""), (905, "lanra " * 50_000), (None, clean), (906, clean + 'the word "grobnik" is an insult')]
    df = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn(toxicity.SCORE, F.lit("old"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (0, None, None), (902, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert {("grobnik", False), ("shmeker", False)} <= set(model.terms) and any(s and t.startswith("vul") for t, s in model.terms)
    got = toxicity.classify(df, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r[toxicity.SCORE] <= 1 for r in got) and got[0]["lang"] == "x"
    by = {r["doc_id"]: r[toxicity.SCORE] for r in got}
    held = [(by[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([(s >= toxicity.THRESHOLD) == bool(y) for s, y in held]) > 0.98
    assert min(by[900], by[901]) > 0.8 and max(by[902], by[903], by[904], by[905], by[None], by[906]) < 0.3


def test_toxicity_ignores_held_out_labels_and_other_columns(spark):
    rng = random.Random(5)
    rows = [(i, *planted(rng, i)) for i in range(240)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = []
    for flip, lang in ((False, "en"), (True, "de")):
        df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("lang", F.lit(lang)).withColumn("source", F.lit(lang))
        labels = spark.createDataFrame([(i, int(flip), 1 - y if flip and held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
        scores.append({r["doc_id"]: r[toxicity.SCORE] for r in toxicity.classify(df, toxicity.fit(df, labels)).collect()})
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert all(r[toxicity.SCORE] < 0.3 for r in toxicity.classify(df, toxicity.fit(df, none)).collect())
    assert toxicity.classify(df.limit(0), toxicity.fit(df.limit(0), none)).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    seen = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("accuracy"), F.sum(F.expr("predicted * toxic")).alias("hits"), F.sum("toxic").alias("toxic"), F.sum(F.expr("predicted * (1 - toxic)")).alias("wrong")
    ).first()
    # The labels mark some documents that hold none of the terms.
    assert seen["accuracy"] > 0.985 and seen["hits"] / seen["toxic"] > 0.9 and seen["wrong"] <= 4
