"""Portfolios, frontiers, seeds and segments against loops."""

import itertools
import random

import numpy as np
import pytest

from strandlake.operators import diversity, joins, search, skyline


def similar(a, b):
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return 1.0 if a == b else len(x & y) / len(x | y) if x and y else 0.0


def greedy(rows, budget, most, controls, others):
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    out = [(r, "required_control") for r in rows if r[3]][:controls] + [(r, "required_other") for r in rows if not r[3]][:others]
    for r in rows:
        if len(out) >= budget:
            break
        if r[0] not in {c[0][0] for c in out} and all(similar(r[1], c[0][1]) <= most for c in out):
            out.append((r, "rank_and_diversity"))
    return [(r[0], k + 1, why) for k, (r, why) in enumerate(out[:budget])]


@pytest.mark.parametrize("budget, most, controls, others", [(6, 0.3, 2, 1), (40, 0.5, 0, 0), (1, 0.0, 0, 1), (12, 1.0, 1, 0), (200, 0.1, 0, 3)])
def test_portfolio_equals_the_sequential_rule(spark, budget, most, controls, others):
    rng = random.Random(budget)
    stems = ["".join(rng.choice("ACDE") for _ in range(12)) for _ in range(6)]
    rows = []
    for g in range(3):
        for k in range(60):
            s = rng.choice(["AC", "", rng.choice(stems), rng.choice(stems) + rng.choice(stems)[: rng.randint(0, 12)], "".join(rng.choice("ACDEFGH") for _ in range(9))])
            rows.append((g * 100 + k, s, rng.randint(1, 40), rng.random() < 0.2, g))
    rows += [(900 + k, "ACDEFACDEF" + "GH"[k % 2], 50 + k, False, 9) for k in range(300)]  # one group of copies and near copies
    df = spark.createDataFrame(rows, "k long, s string, rank long, is_control boolean, g int")
    got = diversity.portfolio(df, "k", "s", "g", budget, most, controls, others).collect()
    for g in {r[4] for r in rows}:
        want = greedy([r for r in rows if r[4] == g], budget, most, controls, others)
        assert sorted(((r["k"], r["place"], r["reason"]) for r in got if r["g"] == g), key=lambda r: r[1]) == want


def test_portfolio_bounds(spark):
    df = spark.createDataFrame([], "k long, s string, rank long, is_control boolean, g int")
    assert diversity.portfolio(df, "k", "s", "g", 3, 0.5, 1, 1).count() == 0
    for bad in ((0, 0.5, 0, 0), (3, 1.5, 0, 0), (3, 0.5, 2, 2), (3, 0.5, -1, 0)):
        with pytest.raises(ValueError):
            diversity.portfolio(df, "k", "s", "g", *bad)


@pytest.mark.parametrize("kind", ["random", "against", "steps"])
def test_frontier_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(skyline, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b"):
        v = rng.integers(0, 60, (400, 3))
        if kind == "against":
            v[:, 2] = 120 - v[:, 0] - v[:, 1]
        if kind == "steps":
            v = np.repeat(v[:40] // 6, 10, 0)
        rows += [(g, int(x), float(y), int(z)) for x, y, z in v]
    rows += [("c", 1, 2.0, 3), ("c", None, 0.0, 0), ("c", 0, float("nan"), 0)]
    df = spark.createDataFrame(rows, "g string, x int, y double, z int").repartition(7)
    got = {tuple(r) for r in skyline.frontier(df, ["g"], ["x", "y", "z"]).collect()}
    clean = {r for r in rows if r[1] is not None and r[2] == r[2]}
    want = {r for r in clean if not any(o[0] == r[0] and o != r and all(p <= q for p, q in zip(o[1:], r[1:], strict=True)) for o in clean)}
    assert got == want
    assert skyline.frontier(df.drop("g"), [], ["x", "y"]).count() > 0 and skyline.frontier(df.limit(0), ["g"], ["x"]).count() == 0


def longest(q, library, least):
    best = None
    for (name, s), k in itertools.chain.from_iterable((((n, s), k) for k in range(len(s))) for n, s in library):
        n = 0
        while n < len(q) and k + n < len(s) and q[n] == s[k + n]:
            n += 1
        if n >= least and (best is None or (n, name, k) > best):
            best = (n, name, k)
    return best


def test_seeds_and_segments_equal_loops(spark):
    rng = random.Random(6)
    text = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    library = [(f"s{k}", text(60)) for k in range(6)]
    library += [("copy", library[2][1]), ("runs", "A" * 30 + text(10) + "A" * 25), ("tiny", "ACG"), ("none", "")]
    queries = [(k, text(5) + library[k % 6][1][k : k + 25] + text(k % 4) + library[(k * 5) % 6][1][3 : 14 + k] + text(3)) for k in range(20)]
    queries += [(50, "A" * 40), (51, ""), (52, "ACG"), (53, queries[0][1]), (54, library[2][1]), (55, text(40, "XYZ"))]
    q, l = spark.createDataFrame(queries, "id int, t string"), spark.createDataFrame(library, "name string, s string")
    got = {(r["q_id"], r["q_at"]): (r["length"], r["l_id"], r["l_at"]) for r in joins.seed_and_extend(q, l, ("id", "t"), ("name", "s"), 8).collect()}
    want = {(i, a): b for i, t in queries for a in range(len(t)) if (b := longest(t[a:], library, 8))}
    assert got == want
    parts = {}
    for i, t in queries:
        at = begin = 0
        out = parts[i] = []
        while at < len(t):
            b = want.get((i, at))
            if b is None:
                at += 1
                continue
            out += [(None, begin, at - begin, None)] * (at > begin) + [(b[1], at, b[0], b[2])]
            at = begin = at + b[0]
        out += [(None, begin, at - begin, None)] * (at > begin)
    rows = search.segments(q, "id", "t", l, "name", "s", 8).collect()
    for i, _ in queries:
        assert [tuple(r)[2:] for r in sorted(rows, key=lambda r: r["place"]) if r["id"] == i] == parts[i]
