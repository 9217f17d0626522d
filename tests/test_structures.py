"""Geometry, boundaries, covers, lineages and stored runs against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph, lineage, search, space, verify


@pytest.mark.parametrize("kind", ["ball", "sphere", "line", "few"])
def test_extremes_equal_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "line":
        x[:, 1:] = 0
    if kind == "few":
        x = np.repeat(rng.normal(size=(3, 3)), 40, 0)
    pos = rng.permutation(120) // (1 if kind != "few" else 2)
    rows = [("a", int(p), *map(float, v)) for p, v in zip(pos, x, strict=True)] + [("one", 1, 0.0, 0.0, 0.0), ("two", 1, 0.0, 0.0, 0.0), ("two", 1, 9.0, 0.0, 0.0), ("two", 2, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, pos int, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    differ = pos[:, None] != pos[None]
    near = (d < 0.7) & (np.abs(pos[:, None] - pos[None]) > 2)
    got = {r["g"]: (r["farthest"], r["clashes"]) for r in space.pair_extremes(df, "g", near=0.7).collect()}
    assert got["a"][0] == pytest.approx((d * differ).max(), abs=1e-12) and got["a"][1] == np.triu(near, 1).sum()
    assert got["two"][0] == pytest.approx(np.sqrt(90)) and "one" not in got
    assert {r["g"]: r["farthest"] for r in space.farthest(df, "g").collect()}["two"] == pytest.approx(np.sqrt(90))


def test_principal_axes_are_eigenvectors(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g in range(12):
        x = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3)) + 5
        if g == 10:
            x = np.zeros((4, 3))
        if g == 11:
            x = np.outer(np.arange(5.0), [0, 1, 1])
        want[g] = x
        rows += [(g, *map(float, v)) for v in x]
    got = {r["g"]: r for r in space.principal_axes(spark.createDataFrame(rows, "g int, x double, y double, z double"), ["g"]).collect()}
    for g, x in want.items():
        cov = np.cov(x.T, bias=True)
        values, axes = np.array(got[g]["values"]), np.array(got[g]["axes"])
        assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1], atol=1e-9) and np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)
        assert np.allclose(cov @ axes.T, axes.T * values, atol=1e-8) and all(v[np.abs(v).argmax()] > 0 for v in axes)
        p = (x - x.mean(0)) @ axes.T
        assert np.allclose(got[g]["extents"], p.max(0) - p.min(0))
    assert got[10]["anisotropy"] == 0 and got[11]["anisotropy"] == pytest.approx(1)


def test_best_boundaries_equal_the_grid(spark):
    rng = random.Random(5)
    rows = lambda n, k: [(k, rng.randint(-3, 60), rng.randint(0, 9)) for _ in range(n)]
    s, e = (spark.createDataFrame(rows(40, "a") + rows(5, "b") + rows(1, c), "key string, pos int, score int") for c in ("c", "d"))
    offsets, least = [-2, 0, 3], 12
    got = {r["key"]: (r["s"], r["e"], r["score"], r["n"]) for r in search.best_boundaries(s, e, offsets, least).collect()}
    grid = search.boundary_grid(s, e, offsets, least).collect()
    want = {}
    for r in grid:
        best = want.setdefault(r["key"], [r, 0])
        best[1] += 1
        if (-r["score"], r["s"], r["e"]) < (-best[0]["score"], best[0]["s"], best[0]["e"]):
            best[0] = r
    assert got == {k: (r["s"], r["e"], r["score"], n) for k, (r, n) in want.items()}


@pytest.mark.parametrize("heap", [3, 1024])
def test_lazy_cover_equals_the_greedy_rule(spark, monkeypatch, heap):
    monkeypatch.setattr(graph, "HEAP", heap)
    rng = random.Random(heap)
    rows = [(k, rng.sample("abcdefghijklmnop", rng.randint(0, 4)), rng.randint(0, 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, f array<string>, o int").select("k", "f", F.struct("o", "k").alias("o"))
    got = [(r["k"], r["gain"]) for r in graph.greedy_cover(df, "k", "f", "o", 9, ["a"]).orderBy("place").collect()]
    done, want = {"a"}, []
    for _ in range(9):
        gain, o, k, f = min((-len(set(f) - done), (o, k), k, f) for k, f, o in rows if k not in {w[0] for w in want})
        if not gain:
            break
        want.append((k, -gain))
        done |= set(f)
    assert got == want
    assert graph.greedy_cover(df, "k", "f", "o", 5, list("abcdefghijklmnop")).count() == 0


@pytest.mark.parametrize("n, m", [(20, 16), (24, 40)])
def test_cycles_and_what_leads_to_them(spark, n, m):
    rng = random.Random(n)
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    reach = {i: set() for i in range(n)}
    for i in range(n):
        todo = [b for a, b in edges if a == i]
        while todo:
            x = todo.pop()
            if x not in reach[i]:
                reach[i].add(x)
                todo += [b for a, b in edges if a == x]
    rings = {i for i in range(n) if i in reach[i]}
    df = spark.createDataFrame(sorted(edges), "child long, parent long")
    nodes = spark.createDataFrame([(i, False) for i in range(n)], "key long, source boolean")
    got = {(r["key"], r["fault"]) for r in lineage.lineage_faults(df, nodes).collect()}
    assert got == {(i, "cycle") for i in rings} | {(i, "built_on_cycle") for i in range(n) if i not in rings and reach[i] & rings}


def test_a_lineage_of_ten_thousand(spark):
    n = 10_000
    edges = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    nodes = spark.range(n).select(F.col("id").alias("key"), (F.col("id") == 0).alias("source"))
    assert lineage.lineage_faults(edges, nodes).count() == 0
    ring = lineage.endless(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(spark.createDataFrame([(0, 4096)], "src long, dst long")))
    assert ring.count() == n


def test_stored_runs_name_the_rows_that_differ(spark, tmp_path, monkeypatch):
    base = spark.range(500).select((F.col("id") % 250).alias("a"), F.floor(F.col("id") / 250).alias("b"), F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("w"))
    at = str(tmp_path / "run")
    verify.store_run(base, at, ["a", "b"])
    assert verify.against_stored(base.repartition(7).orderBy(F.desc("v")), at, ["a", "b"]).count() == 0
    odd = base.where("v <> 7").withColumn("w", F.when(F.col("v") == 9, "x").when(F.col("v") == 10, None).otherwise(F.col("w"))).withColumn("v", F.when(F.col("v") == 10, -1).otherwise(F.col("v")))
    odd = odd.unionByName(spark.createDataFrame([(900, 0, 1, None)], base.schema)).unionByName(base.where("v = 20"))
    want = [(7, 0, "missing", None), (9, 0, "changed", ["w"]), (10, 0, "changed", ["v", "w"]), (20, 0, "count", None), (900, 0, "added", None)]
    for named in (2000, 1):
        monkeypatch.setattr(verify, "NAMED", named)
        assert sorted(tuple(r) for r in verify.against_stored(odd, at, ["a", "b"]).collect()) == want
    # Of an equal run only digests are read.
    read = verify.differing_buckets(spark.read.parquet(f"{at}/digests"), verify._leaves(verify._hashed(base, ["a", "b"])))
    assert read.count() == 0


def test_runs_verify_themselves(spark, tmp_path):
    from strandlake.operators import runs
    from strandlake.sources import sinks

    parts = spark.range(60).select("id", (F.col("id") % 5).alias("g"))
    keys = {"parts": ["id"], "sizes": ["g"], "kept": ["id"]}

    def rebuild(tables, policy):
        return {"sizes": tables["parts"].groupBy("g").agg(F.count("*").alias("n")), "kept": tables["parts"].where(F.col("id") < policy["below"])}

    root = str(tmp_path)
    run = runs.publish_run(spark, root, {"parts": parts}, {"below": 9}, rebuild, keys)
    assert runs.publish_run(spark, root, {"parts": parts.repartition(3)}, {"below": 9}, rebuild, keys) == run
    assert runs.publish_run(spark, root, {"parts": parts}, {"below": 8}, rebuild, keys) != run
    failed = lambda: {r["check_id"]: r["detail"] for r in runs.verify_run(spark, root, run, rebuild, keys).where("status = 'fail'").collect()}
    assert failed() == {}
    # Rows that change behind their digests, an input that is another, a table too many.
    at = f"{root}/{run}/results/kept/rows"
    odd = spark.read.parquet(at).withColumn("g", F.when(F.col("id") == 3, -1).otherwise(F.col("g"))).collect()
    schema = spark.read.parquet(at).schema
    sinks.delete(spark, at)
    spark.createDataFrame(odd, schema).write.parquet(at)
    assert failed() == {"result-kept": "1"}
    sinks.delete(spark, f"{root}/{run}/inputs/parts")
    verify.store_run(parts.where("id > 0"), f"{root}/{run}/inputs/parts", ["id"])
    (tmp_path / run / "results" / "more").mkdir()
    assert {"results-set", "input-parts", "result-sizes", "result-kept"} == set(failed())


def test_spearman_with_ties_equals_ranks(spark):
    from strandlake.operators.aggregates import regression_metrics

    rng = np.random.default_rng(8)
    rows = [(g, float(rng.integers(0, 9)), float(rng.integers(0, 6)) if g else 1.0) for g in (0, 1, 2) for _ in range(80)]
    got = {r["g"]: r for r in regression_metrics(spark.createDataFrame(rows, "g int, y double, p double"), "y", "p", ["g"]).collect()}
    assert got[0]["spearman"] is None
    for g in (1, 2):
        y, p = np.array([r[1:] for r in rows if r[0] == g]).T
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert got[g]["spearman"] == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1]) and got[g]["pearson"] == pytest.approx(np.corrcoef(y, p)[0, 1])
