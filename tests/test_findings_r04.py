"""What the findings of round 4 found, small."""

import random

from strandlake.operators import topk
from strandlake.plans import registry


def test_more_mandatory_rows_than_the_budget_are_all_there_is(spark, tmp_path):
    rows = [(k, f"Brand#{k % 7}", 50 if k < 1600 else 1 + k % 49, float(k)) for k in range(1700)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["tk05_tiered"](spark, str(tmp_path)).collect()
    assert sorted((r["p_partkey"], r["tier"]) for r in got) == [(r[0], "mandatory") for r in rows if r[2] == 50]
    few = spark.createDataFrame([r for r in rows if r[0] % 300 == 0], "k long, g string, p_size int, s double").withColumn("must", topk.F.col("p_size") == 50)
    assert {r["k"]: r["tier"] for r in topk.tiered(few, "must", "g", "s", "k", 6, strict=False).collect()} == {k: "mandatory" for k in range(0, 1600, 300)}


def test_bands_on_a_limit_go_by_the_sum_in_the_table_s_order(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for _ in range(60):  # of each part 60 lines whose discounts add up to 3.5: 12 times their mean is 0.7
        for part in range(200):
            rows.append([part, 40.0, None])
    for part in range(200):
        v = [rng.randint(0, 10) for _ in range(60)]
        while sum(v) != 350:
            k = rng.randrange(60)
            v[k] = min(10, max(0, v[k] + (1 if sum(v) < 350 else -1)))
        for i, x in enumerate(v):
            rows[i * 200 + part][2] = x / 100
    for k in range(6):
        at = spark.createDataFrame(rows[k * 2000 : (k + 1) * 2000], "l_partkey long, l_quantity double, l_discount double").coalesce(1)
        at.write.mode("append" if k else "overwrite").parquet(f"{tmp_path}/{k}")
    # One file after the other, in the order of their names.
    import pathlib
    import shutil

    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(6):
        shutil.copy(next(pathlib.Path(f"{tmp_path}/{k}").glob("*.parquet")), f"{tmp_path}/lineitem.parquet/part-{k}.parquet")
    want = {}
    for part in range(200):
        total = 0.0
        for r in rows[part::200]:
            total += r[2]
        want[part] = "higher" if total / 60 * 12 >= 0.7 else "mixed"
    assert len(set(want.values())) == 2
    got = {r["part"]: r["band"] for r in registry.QUERIES["ma06_confidence_bands"](spark, str(tmp_path)).collect()}
    assert got == want


def test_estimates_do_not_grow_with_rounds(spark):
    from strandlake.operators.graph import checkpointed

    now = spark.range(8).selectExpr("id AS src", "(id + 1) % 8 AS dst")
    for _ in range(9):  # digits would double in each
        now = checkpointed(now.join(now.selectExpr("src AS dst", "dst AS next"), "dst").selectExpr("src", "next AS dst"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert {(r["src"], r["dst"]) for r in now.collect()} == {(k, k) for k in range(8)}


def test_a_portfolio_of_many_rounds_ends(spark):
    from strandlake.operators import diversity

    from .test_selection import greedy

    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ACGT") for _ in range(64)), k, False, 0) for k in range(150)]  # nearly all share k-mers: a round takes few
    df = spark.createDataFrame(rows, "k long, s string, rank long, is_control boolean, g int")
    got = diversity.portfolio(df, "k", "s", "g", 40, 0.47, 0, 3).collect()
    assert sorted(((r["k"], r["place"], r["reason"]) for r in got), key=lambda r: r[1]) == greedy(rows, 40, 0.47, 0, 3)


def test_liabilities_are_found_within_rows(spark):
    from math import log2

    from strandlake.functions.constants import HYDROPATHY
    from strandlake.operators import products

    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(rng.choice(["AC", "ACDEFGHIKLMNPQRSTVWY", "IVLA", "DDX"])) for _ in range(rng.choice([0, 2, 3, 12, 18, 19, 40, 90]))), "low", True) for k in range(120)] + [(999, None, "low", False)]
    df = spark.createDataFrame(rows, "k long, seq string, band string, low_boundary boolean")
    found = products.liabilities(df, "k")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

    def merged(starts, n, gap):
        out = []
        for i in starts:
            if out and i - out[-1][2] <= gap:
                out[-1][1:] = [i + n - 1, i]
            else:
                out.append([i, i + n - 1, i])
        return [(a, b) for a, b, _ in out]

    low = lambda x: sum(-x.count(c) / 12 * log2(x.count(c) / 12) for c in set(x) & set(HYDROPATHY)) < 2.2
    want = []
    for k, s, _, _ in rows[:-1]:
        want += [(k, "hydrophobic_window", *p) for p in merged([i + 1 for i in range(len(s) - 18) if sum(round(10 * HYDROPATHY.get(c, 0)) for c in s[i : i + 19]) >= 304], 19, 19)]
        want += [(k, "low_complexity", *p) for p in merged([i + 1 for i in range(len(s) - 11) if low(s[i : i + 12])], 12, 12)]
        want += [(k, "homopolymer", *p) for p in merged([i + 1 for i in range(len(s) - 2) if len(set(s[i : i + 3])) == 1], 3, 1)]
    got = [(r["k"], r["code"], r["start1"], r["end1"]) for r in found.where("code in ('hydrophobic_window', 'low_complexity', 'homopolymer')").collect()]
    assert sorted(got) == sorted(want) and {x[1] for x in want} == {"hydrophobic_window", "low_complexity", "homopolymer"}
    assert [r["code"] for r in found.where("k = 999").collect()] == ["low_structure_confidence"]


def test_seeds_are_not_broadcast(spark):
    from strandlake.operators import joins

    rows = [(k, "".join(rng.choice("ACDE") for _ in range(40))) for rng in [random.Random(1)] for k in range(20)]
    df = spark.createDataFrame(rows, "k long, t string")
    best = joins.seed_and_extend(df, df, ("k", "t"), ("k", "t"))
    assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.where("q_at = 0 and l_id = q_id and length = 40").count() == 20


def test_small_groups_meet_in_one_join_and_large_ones_among_them_are_whole(spark, monkeypatch):
    from math import dist

    from strandlake.operators import space

    rng = random.Random(2)
    rows = [(g, i, rng.random(), rng.random(), rng.random()) for g in range(30) for i in range(1 + g % 12)] + [(99, 1, 0.0, 0.0, 0.0), (99, 1, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, pos int, x double, y double, z double")
    plan = space.pair_extremes(df, "g", near=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
    for few in (64, 6):
        monkeypatch.setattr(space, "FEW", few)
        got = {r["g"]: (round(r["farthest"], 9), r["clashes"]) for r in space.pair_extremes(df, "g", near=0.5).collect()}
        want = {}
        for g in range(30):
            d = [(b[1] - a[1], dist(a[2:], b[2:])) for a in rows for b in rows if a[0] == b[0] == g and a[1] < b[1]]
            if d:
                want[g] = round(max(x for _, x in d), 9), sum(k > 2 and x < 0.5 for k, x in d)
        assert got == want


def test_a_key_with_many_rows_on_both_sides_is_dealt(spark):
    from strandlake.operators import products

    df = spark.createDataFrame([(k, "one" if k else "two", k % 5, k / 2) for k in range(200)], "k long, s string, n int, v double")
    j = products.against_controls(df, "s", "k", products.F.col("n") == 0, ["v"])
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(s" in plan and "Broadcast" not in plan and all("_deal" in x for x in plan.splitlines() if "hashpartitioning(s" in x)
    got = {(r["candidate"], r["control"], r["v_delta"]) for r in j.collect()}
    assert got == {(a, b, a / 2 - b / 2) for a in range(1, 200) for b in range(5, 200, 5) if a % 5}


def test_a_cell_of_many_points_is_dealt(spark, monkeypatch):
    from math import dist

    from strandlake.operators import joins

    monkeypatch.setattr(joins, "CELL", 16)
    rng = random.Random(4)
    rows = [(k, g, *(rng.choice([rng.random(), rng.random() / 9]) for _ in range(3))) for k in range(300) for g in ("a", "b")] + [(900, "a", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double, z double").withColumn("i", joins.F.col("k"))
    found = joins.close_points(df, "k", 0.25, ["g"], "i", 2)
    assert "_part" in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["g"], r["a"], r["b"]) for r in found.collect()]
    p = [r for r in rows if r[2] is not None]
    assert sorted(got) == sorted((u[1], u[0], v[0]) for u in p for v in p if u[1] == v[1] and u[0] + 2 < v[0] and dist(u[2:], v[2:]) <= 0.25)
