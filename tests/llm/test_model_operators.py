"""Classifier, language model, graph index, mixing and pipeline on small fixtures, against brute force where there is one."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import common, embedding, hnsw, lm, mixing, quality
from strandlake.llm.hnsw import Graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, source=lambda i: f"s{(i or 0) % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "walks", "slowly", "bright", "and"]) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    return " ".join(rng.choice(["THE", "OF", "BUY", "NOW"]) + rng.choice(["!!", "$$$", "%%%"]) for _ in range(n))


def test_quality_learns_held_out_labels(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 3 else junk(rng, 60)) for i in range(300)]
    extra = [(900, None), (901, ""), (None, prose(rng, 40)), (902, "word " * 40_000), (5, rows[5][1])]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(0, None, None), (None, 1, 0), (1, 1, 0), (7, 5, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs(spark, rows + extra), lab)
    got = quality.classify(docs(spark, rows + extra), model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r[quality.SCORE] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(r[quality.SCORE] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]) > 0.97
    assert got[0].asDict().keys() >= {"lang", "source", "n_chars"}


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) if i % 2 else junk(rng, 30)) for i in range(120)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    a = [(i, i % 2, 0) for i in range(120)]
    b = [(i, 1 - i % 2 if held(i) else i % 2, 1) for i in range(120)]
    scores = []
    for lab, src in ((a, "x"), (b, "y")):
        d = docs(spark, rows, lambda i: src)
        m = quality.fit(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
        scores.append({r["doc_id"]: r[quality.SCORE] for r in quality.classify(d, m).collect()})
    assert scores[0] == scores[1]


def test_a_column_of_the_score_s_name_is_replaced_or_kept(spark):
    rng = random.Random(13)
    d = docs(spark, [(i, prose(rng, 30) if i % 2 else junk(rng, 30)) for i in range(40)]).withColumn(quality.SCORE, F.lit("mine"))
    m = quality.fit(d, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert dict(quality.classify(d, m).dtypes)[quality.SCORE] == "double"
    both = quality.classify(d, m, "other").first()
    assert both[quality.SCORE] == "mine" and 0 <= both["other"] <= 1


def test_neighbour_votes_are_exact():
    rng = np.random.default_rng(3)
    n, w = 1200, quality.BUCKETS + quality._SHAPES + 8
    x, y = rng.random((n, w)), rng.integers(0, 2, n).astype(float)
    basis = np.linalg.qr(rng.normal(size=(w, 8)))[0]
    m = quality.Model(np.ones(w), basis, np.zeros((0, 8)), y, 0.5)
    m.vectors = m.latent(x)
    q = rng.random((5, w))
    got = m.score(q)
    for k in range(5):
        cos = m.latent(q[k : k + 1])[0] @ m.vectors.T
        top = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        wt = np.exp(quality.SHARPNESS * (cos[top] - 1))
        assert math.isclose(got[k], ((wt * y[top]).sum() + 0.05 * 0.5) / (wt.sum() + 0.05), rel_tol=1e-9)


def test_quality_without_labels_or_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, [(1, "a")])
    assert quality.classify(d, quality.fit(d, lab)).collect()[0][quality.SCORE] == 0.5
    e = docs(spark, [])
    assert quality.classify(e, quality.fit(e, lab)).collect() == []


def brute_links(vectors, least=0.95):
    fit = {}
    for k, (i, v) in enumerate(vectors):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            u = u / abs(u).max()
            fit[k] = u / np.linalg.norm(u)
    n = collections.Counter()
    up = {k: k for k in fit}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    keys = list(fit)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] >= least:
                n[a] += 1
                n[b] += 1
                up[root(a)] = root(b)
    least_of = {}
    for k in fit:
        least_of[root(k)] = min(least_of.get(root(k), 10**9), vectors[k][0])
    return [(i, n[k], least_of[root(k)] if k in fit else i) for k, (i, _) in enumerate(vectors)]


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for c in range(30):
        centre = rng.normal(size=16)
        vectors += [(12 * c + k, (centre + rng.normal(scale=s, size=16)).tolist()) for k, s in enumerate(rng.choice([0.05, 0.2, 0.3], 12))]
    vectors += [(5, v) for _, v in vectors[200:203]]  # an id that repeats, with other vectors
    vectors += [(1000 + k, vectors[3][1]) for k in range(20)]  # copies
    vectors += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (None, vectors[0][1]), (2006, [1.0] * 4), (2007, [2.0] * 4), (2008, [1e300] * 16), (2009, [1e-300] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, n int")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.link_vectors(df).collect()]
    assert sorted(got, key=str) == sorted(brute_links(vectors), key=str)
    assert embedding.link_vectors(df.where("false")).collect() == []


def test_graph_recall_and_beams_wider_than_the_first(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=32) + rng.normal(scale=s, size=(n, 32)) for n, s in ((400, 0.09), (150, 0.12), (3, 0.12))] + [rng.normal(size=(1500, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.load(Graph(x).dump())
    want = x @ x.T >= 0.95
    np.fill_diagonal(want, False)
    a, b, dense = g.found(x, 0.95, 16)
    assert not len(dense) and want[a[a != b], b[a != b]].all() and len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True))) and (a != b).sum() >= 0.99 * want.sum()
    weight = np.arange(len(x))
    for wide in (1024, 64):  # with the second, dense queries are compared with all nodes
        monkeypatch.setattr(hnsw, "WIDE", wide)
        count, src, dst, (there, seen) = g.search(x, np.arange(len(x)), weight, 0.95, 16, 0.995)
        assert there >= 6 and seen >= 0.99 * there
        assert abs(count - want @ weight).sum() <= 0.01 * (want @ weight).sum() and len(src) < len(x)
        linked = lambda s, d: sorted(map(sorted, components_of(len(x), s, d)))
        assert want[src, dst].all() and linked(src, dst) == linked(*np.nonzero(want))


def components_of(n, src, dst):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        up[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(n):
        groups[root(k)].append(k)
    return groups.values()


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60))) for i in range(900)] + [(1000, None), (1001, " \n"), (1002, "w " * 20_000), (None, "a b c"), (7, "x y z"), (7, "x y z")]
    source = lambda i: None if i is None else "ä" if i == 1002 else "tiny" if i in (1, 2) else f"s{min(i % 9, 4)}"
    d = docs(spark, rows, source)
    run = lambda **how: [r.asDict() for r in mixing.mixed_words(mixing.mix(d, shards=8, block_words=64, **how)).collect()]
    got, again, other = run(), run(), run(seed=1)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    # Another seed draws other blocks.
    assert sum(a != b for a, b in zip(sorted(map(key, got)), sorted(map(key, other)), strict=True)) > 100
    size = collections.Counter()
    for i, t in rows:
        size[source(i)] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = sum(size.values()) - sum(target.values())
        over = [s for s in free if weight[s] * rest / sum(weight[t] for t in free) > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.remove(s)
    rest = sum(size.values()) - sum(target.values())
    target |= {s: weight[s] * rest / sum(weight[t] for t in free) for s in free}
    taken = collections.Counter()
    by = {i: source(i) for i, _ in rows}
    for r in got:
        s = by[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        # No word of a row is taken twice in a repeat, and none beyond its end.
        for k in range(3):
            spans = sorted((p["start_word"], p["words"]) for p in r["parts"] if p["repeat"] == k)
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and all(a + n <= r["size"] for a, n in spans)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    assert all(len(c.collect()) == 0 for c in mixing.mix(d.where("false")))


def test_drawn_blocks_are_those_of_the_permutation_and_the_quotas(spark):
    sized = spark.createDataFrame([(0, "a", 64 * 40 - 9), (1, "b", 64 * 13), (2, "c", 5), (3, "d", 0)], "doc_id long, source string, size long")
    by = mixing.blocks_of(mixing.targets(sized), 64, 3)
    info = {r["i"]: r for r in by.collect()}
    drawn = mixing.drawn_blocks(by, 8, 64, 3).collect()
    quota = {(r["i"], r["shard"]): r["blocks"] for r in mixing.quotas(by, 8, 3).collect()}
    assert collections.Counter((r["i"], r["shard"]) for r in drawn) == +collections.Counter(quota)
    for i, s in info.items():
        mine = [r for r in drawn if r["i"] == i]
        assert len({(r["repeat"], r["block"]) for r in mine}) == len(mine) == s["blocks"]  # disjoint
        for k in range(s["whole"]):
            assert sorted(r["block"] for r in mine if r["repeat"] == k) == list(range(s["n_blocks"]))
        words = sum(min(r["block_words"], min(64, s["source_size"] - 64 * r["block"])) for r in mine)
        assert words == round(s["target"])
    assert info[2]["target"] == 15.0 and info[3]["blocks"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 22, 63, 100, 1001])
def test_permutations_are_whole_seeded_and_can_be_undone(spark, n):
    many = lambda seed: spark.range(n).select("id", mixing._permuted(F.col("id"), F.lit(n).cast("long"), mixing._key(seed, F.lit(3), F.lit(0))).alias("y"))
    back = many(7).select("id", "y", mixing._permuted(F.col("y"), F.lit(n).cast("long"), mixing._key(7, F.lit(3), F.lit(0)), back=True).alias("z")).collect()
    assert sorted(r["y"] for r in back) == list(range(n)) and all(r["z"] == r["id"] for r in back)
    if n > 20:
        assert [r["y"] for r in back] != [r["y"] for r in many(8).collect()] and [r["y"] for r in back] != sorted(r["y"] for r in back)


def test_shards_hold_the_texts_that_the_mix_takes(spark):
    rng = random.Random(12)
    d = docs(spark, [(i, "  " + " ".join(f"w{i}.{k}" for k in range(rng.randrange(1, 200))) + "\n") for i in range(60)] + [(3, "twice told"), (3, "twice told"), (None, None)])
    d = d.withColumn("size", F.lit("of another kind"))
    mixed = mixing.mixed_documents(d, shards=4, block_words=32)
    assert mixed.columns == [*(c for c in d.columns if c != "size"), "size", "source_size", "target", "taken", "parts"]
    mixed = common.cut(mixed)
    assert mixed.count() == 63
    parts = mixing.shard_texts(mixed).collect()
    places = collections.defaultdict(list)
    taken = collections.Counter()
    for r in parts:
        places[r["shard"]].append(r["place"])
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    want = collections.Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += r["taken"]
    assert taken == +want
    # Shuffled: a shard's documents aren't in the order of their ids.
    assert any(a["doc_id"] > b["doc_id"] for a, b in zip(parts, parts[1:], strict=False) if a["shard"] == b["shard"] and None not in (a["doc_id"], b["doc_id"]))


def test_quota_tree_is_exact_and_hypergeometric(spark):
    by = spark.createDataFrame([(0, 100), (1, 50), (2, 0)], "i int, blocks long")
    q = mixing.quotas(by, 8).groupBy("i").agg(F.sum("blocks").alias("n")).collect()
    assert {r["i"]: r["n"] for r in q} == {0: 100, 1: 50, 2: 0}
    per = [r["n"] for r in mixing.quotas(by, 8).groupBy("shard").agg(F.sum("blocks").alias("n")).collect()]
    assert sum(per) == 150 and max(per) - min(per) <= 1
    us = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    pop, good, draws = (F.lit(v).cast("long") for v in (30, 12, 10))
    got = collections.Counter(r[0] for r in us.select(mixing._hypergeometric(pop, good, draws, F.col("u"))).collect())
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got[k] / 2000 - p) <= 0.002


def small_model(rng, lengths):
    """A model counted from random texts of a few classes, as learn() does it, without Spark; and the texts."""
    classes = np.minimum(rng.geometric(0.05, lengths.sum()), lm.CLASSES - 1).astype(np.int64)
    m = lm.Model("", *lm.classes_of(np.bincount(classes, minlength=lm.CLASSES + 300).astype(float)))
    m.prior = np.full(lm.CLASSES, 1 / lm.CLASSES, np.float32)
    t = lm.Texts(m, classes, lengths)
    own = np.bincount(lm._own_cells(t, lm.PLACES, len(t.c))[0], minlength=(lm.CLASSES + 1) * lm.CLASSES).reshape(-1, lm.CLASSES)
    t = lm.Texts(lm.with_pairs(m, own), classes, lengths)
    rows = lm.PAIRS + 1 + (lm.PLACES - 1) * lm.COARSE
    other = np.bincount(np.concatenate(lm._other_cells(t, lm.PLACES, len(t.c))), minlength=rows * lm.CLASSES).reshape(-1, lm.CLASSES)
    lm.with_values(m, [own, other[: lm.PAIRS + 1], *np.split(other[lm.PAIRS + 1 :], lm.PLACES - 1)])
    return m, classes, t


def test_windows_hold_the_tokens_before_each_target():
    rng = np.random.default_rng(7)
    lengths = np.array([1, 8, 9, 40, 3])
    m, classes, t = small_model(rng, lengths)
    assert t.c[t.valid].tolist() == classes.tolist()
    targets = iter(np.flatnonzero(t.valid).tolist())
    for s, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True):
        for k in range(n):
            i = next(targets)
            before = [lm._PAD] * (lm.PLACES - 1) + [lm._BEGIN] + classes[s : s + k].tolist()
            assert t.c[i - lm.PLACES : i].tolist() == before[-lm.PLACES :]
            assert [int(r[0]) for r in t.rows(i, i + 1)][::2][:1] == [min(before[-1], lm._BEGIN)]


def test_attention_is_causal_normalized_and_its_gradient_right():
    rng = np.random.default_rng(8)
    lengths = np.array([60, 1, 9, 130])
    m, classes, t = small_model(rng, lengths)
    lo, hi = lm.PLACES, lm.PLACES + 80
    m.flat = (m.flat + rng.normal(0, 0.3, len(m.flat))).astype(np.float32)
    scores = lm.tables(lm.unpack(m.flat))
    every = np.zeros(hi - lo)
    for c in range(lm.CLASSES):
        t.y[:] = c
        s, v, *_ = lm.attend(m, scores, t, lo, hi)
        every += (s * v).sum(0)
    t.y[:] = np.minimum(t.c, lm.CLASSES - 1)
    assert np.allclose(every[t.valid[lo:hi]], 1, atol=1e-4)
    # What comes later changes nothing; what came before does; pads have no weight.
    other = classes.copy()
    other[20] = (other[20] + 1) % 50
    a, b = lm.log_probabilities(m, t), lm.log_probabilities(m, lm.Texts(m, other, lengths))
    assert np.array_equal(a[:20], b[:20]) and not np.allclose(a[21:26], b[21:26]) and np.array_equal(a[60:], b[60:])
    s, *_ = lm.attend(m, scores, t, lo, hi)
    assert (s[3:, 0] == 0).all() and s[3, 1] > 0 and (s[4:, 1] == 0).all()

    def loss(flat):
        s, v, *_ = lm.attend(m, lm.tables(lm.unpack(flat)), t, lo, hi, True)
        return -np.log((s.astype(float) * v).sum(0))[t.valid[lo:hi]].mean()

    g = lm.gradient(m, m.flat, t, lo, hi)
    for i in np.concatenate([rng.choice(np.flatnonzero(g), 30), np.arange(len(g) - lm.SLOTS, len(g))]):
        d = np.zeros_like(m.flat)
        d[i] = 0.02
        assert math.isclose((loss(m.flat + d) - loss(m.flat - d)) / 0.04, g[i], rel_tol=2e-2, abs_tol=3e-5)


def test_values_leave_the_target_out():
    m, classes, t = small_model(np.random.default_rng(9), np.array([300]))
    _, v, *_ = lm.attend(m, lm.tables(lm.unpack(m.flat)), t, lm.PLACES, len(t.c), True)
    for k in (5, 77, 299):
        same = [j for j in range(1, 300) if j != k and classes[j - 1] == classes[k - 1]]
        want = (sum(classes[j] == classes[k] for j in same) + lm.SMOOTH / lm.CLASSES) / (len(same) + lm.SMOOTH)
        assert math.isclose(v[1, k], want, rel_tol=1e-3)


def test_words_are_encoded_alike_alone_and_together():
    words = ["the", "Ünïcode", "a\u00a0b", "|", "x" * 300, "\u3000", "\x00", "\x1f", "<|endoftext|>", "日本語", "end"]
    ids, n = lm.subwords([w.encode() for w in words], lm.TOKENIZER)
    encode = lm.tokenizer(lm.TOKENIZER)[0].encode_ordinary
    want = [[i + 1 for i in encode(" " + w)] for w in words]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))
    assert [len(x) for x in lm.subwords([], lm.TOKENIZER)] == [0, 0]


def test_training_takes_every_token_of_whole_texts_once(spark):
    rng = random.Random(14)
    texts = {i: prose(rng, n) for i, n in enumerate((1, 12, 13, 700, 1100, 90_000))} | {10: "", 11: None}
    spark.sparkContext.addFile(lm.TOKENIZER)
    got = lm.gather(docs(spark, list(texts.items())).select("doc_id", "text"), lm.TOKENIZER)
    rows = got.collect()
    kind = lm._kind(lm.TOKENIZER)
    m = lm.Model(lm.TOKENIZER, *lm.classes_of(1.0 * np.arange(lm.tokenizer(lm.TOKENIZER)[1] + 2)))
    want = collections.Counter()
    for t in texts.values():
        want.update(m.of[[*lm.subwords((t or "").encode().lower().split(), lm.TOKENIZER)[0].tolist(), 0]].tolist())
    seen = collections.Counter()
    batches = got.where("run is not null").select("skip", "run").toArrow().to_batches()
    for t in lm.laid(iter(batches), m, kind):
        seen.update(t.c[t.valid].tolist())
    assert seen == want
    counts = collections.Counter()
    for r in rows:
        if r["word"] is not None:
            counts[bytes(r["word"])] += r["c"]
    assert counts == collections.Counter(w for t in texts.values() for w in (t or "").encode().lower().split() + [b""])
    # A later run's targets see the same windows as in one piece.
    seq = (np.arange(2 * lm.RUN + 100) % 900 + 1).astype(kind)
    runs = lm.runs_of(seq)
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in runs]), pa.array([r for _, r in runs], pa.binary())], ["skip", "run"])
    windows = lambda t: [t.c[i - lm.PLACES : i + 1].tolist() for i in np.flatnonzero(t.valid)]
    parts = [w for t in lm.laid(iter([batch]), m, kind) for w in windows(t)]
    assert parts == windows(lm.Texts(m, m.of[seq], np.array([len(seq)])))


def test_counts_and_training_are_those_of_all_runs(spark):
    rng = random.Random(15)
    texts = [(i, prose(rng, rng.randrange(1, 60))) for i in range(80)]
    spark.sparkContext.addFile(lm.TOKENIZER)
    runs = lm.gather(docs(spark, texts).select("doc_id", "text").repartition(5), lm.TOKENIZER).where("run is not null").select("skip", "run")
    counts = np.zeros(lm.tokenizer(lm.TOKENIZER)[1] + 2)
    seqs = [[*lm.subwords(t.encode().lower().split(), lm.TOKENIZER)[0].tolist(), 0] for _, t in texts]
    for s in seqs:
        np.add.at(counts, s, 1)
    m = lm.learn(runs, counts, lm.TOKENIZER)
    after = collections.Counter((a, b) for s in seqs for a, b in zip([lm._BEGIN, *m.of[s[:-1]].tolist()], m.of[s].tolist(), strict=True))
    n = collections.Counter(a for a, _ in after.elements())
    for (a, b), c in after.items():
        assert math.isclose(m.values[0][a, b], (c + lm.SMOOTH * m.prior[b]) / (n[a] + lm.SMOOTH), rel_tol=1e-4)
    assert not np.array_equal(m.flat, lm.initial())


def test_held_out_texts_score_better_than_by_words(spark):
    """Prose of words that share parts, as real ones do, seldom whole: subwords and their order tell more than words."""
    rng = random.Random(16)
    part = ["river", "stone", "bright", "walk", "field", "north", "under", "glass", "paper", "storm"]
    words = [a + b + c for a in part for b in part for c in part]
    text = lambda: " ".join(rng.choice(["the", "of", "and", "a"]) + " " + rng.choice(words) for _ in range(60))
    got = [r for r in lm.score(docs(spark, [(i, text()) for i in range(150)])).collect() if r["held_out"]]
    assert len(got) > 10 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_language_model_scores(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40) + f" Own{i} " * (i % 3)) for i in range(120)] + [(500, None), (501, ""), (None, "the stone"), (3, "the river"), (502, "Ünknown words"), (503, "x" * 50_000)]
    got = lm.score(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), held(i), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["held_out"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    per = [r["score"] / r["n_tokens"] for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["held_out"]]
    odd = next(r for r in got if r["doc_id"] == 502)
    assert np.mean(per) > odd["score"] / odd["n_tokens"]
    assert lm.score(docs(spark, [])).collect() == []


def test_tail_words_join_gives_the_same_base(spark, monkeypatch):
    rng = random.Random(10)
    d = docs(spark, [(i, prose(rng, 30) + f" rare{i % 7}") for i in range(60)])
    a = {r["doc_id"]: r["base_score"] for r in lm.score(d).collect()}
    monkeypatch.setattr(lm, "HEAVY", 8)
    b = {r["doc_id"]: r["base_score"] for r in lm.score(d).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, prose(rng, 80)) for i in range(60)]
    words = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    item = words(25)
    rows += [(100 + i, words(200) + "\nShared footer") for i in range(30)]
    rows += [(200 + i, rows[60 + i][1].replace("Shared", "shared ")) for i in range(5)]  # copies
    rows += [(300 + i, words(60) + " " + item + " " + words(60)) for i in range(3)]  # leaks
    rows += [(400 + i, junk(rng, 60)) for i in range(40)]
    at = tmp_path_factory.mktemp("sf")
    docs(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline(spark, corpus):
    d = spark.read.parquet(f"{corpus}/documents.parquet").withColumn(quality.SCORE, F.lit("a column of the caller's"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, corpus)
        if name != "mixing":
            assert out.columns == d.columns
        d = common.cut(out)
        seen[name] = {r["doc_id"]: r.asDict() for r in d.collect()}
    assert not any(i >= 400 for i in seen["quality"]) and len(seen["quality"]) >= 95
    assert "footer" not in seen["lines"][100]["text"] and seen["lines"][100]["n_chars"] == len(seen["lines"][100]["text"])
    gone = set(seen["lines"]) - set(seen["simhash"])
    assert set(range(200, 205)) <= gone and not gone & set(range(100, 130))
    assert set(seen["simhash"]) - set(seen["decontamination"]) == {300, 301, 302}
    assert set(seen["mixing"]) == set(seen["decontamination"])
    assert all(r[quality.SCORE].endswith("caller's") for r in seen["mixing"].values())
    taken = sum(r["taken"] for r in seen["mixing"].values())
    assert taken == sum(len(r["text"].split()) for r in mixing.shard_texts(d).collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_groups_complete_what_beams_miss(monkeypatch):
    rng = np.random.default_rng(6)
    parts = []
    for n in (300, 120, 40, 10, 3):
        centre = rng.normal(size=32)
        noise = rng.normal(size=(n, 32))
        parts.append(centre / np.linalg.norm(centre) + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sqrt(1 / 0.95 - 1) * rng.uniform(0.9, 1.1, (n, 1)))
    x = np.vstack([*parts, rng.normal(size=(300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = x @ x.T >= 0.95
    np.fill_diagonal(want, False)
    g = Graph(x)
    for group in (64, 4):  # with the second, most groups are products of blocks
        monkeypatch.setattr(hnsw, "SMALL_GROUP", group)
        a, b = g.completed(x, *g.found(x, 0.95, 24)[:2], 0.95, g.groups(0.95))
        pairs = list(zip(a.tolist(), b.tolist(), strict=True))
        assert len(pairs) == len(set(pairs)) and {(i, j) for i, j in pairs if i != j} == set(zip(*map(list, np.nonzero(want)), strict=True))
    # A graph whose walks find nothing: audits send all queries to the exact way.
    monkeypatch.setattr(hnsw, "WIDE", 24)
    monkeypatch.setattr(Graph, "found", lambda self, q, least, beam: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
    count, _, _, _ = g.search(x, np.arange(len(x)), np.ones(len(x), int), 0.95, 24, 0.995)
    assert (count == want.sum(1)).all()
