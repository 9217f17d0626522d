"""Queries of the design flow: evidence, boundaries, products, routing, trials, lineage, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AA, INTERVALS_SQL, SEQUENCES_SQL, derived, derived_sql, intervals, sequences
from ..functions import hashing as hs
from ..functions import sequence as fn
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import search as se
from ..operators import topk as tk
from ..operators import verify as vf
from ..operators import windows as wi
from ..session import table
from .sequences import _CHOICES, FREQUENCY

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


S = f"s AS (SELECT * FROM {SEQUENCES_SQL})"
I = f"t AS (SELECT * FROM {INTERVALS_SQL})"


@query("fi01_blank_lines", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')")
def fi01(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("x"))
    return lines.where(F.col("x").rlike(r"[^\x20\x09-\x0D]")).agg(F.count("*").alias("n"))


_GCN = "(length(cds) - length(translate(cds, 'GC', '')))"


@query("tk02_trials_and_constraints", f"WITH {S}, x AS (SELECT doc_id, t, i, {_CHOICES} AS cs, ('0x' || substr(sha256(concat('7:', t, ':c', doc_id, ':', i - 1)), 1, 8))::BIGINT AS draw FROM (SELECT doc_id, t, i, substr(aa, i, 1) AS a FROM s, range(1, 257) q(i), range(6) w(t))), c AS (SELECT doc_id, t, concat(string_agg(CASE WHEN t = 0 OR len(cs) = 1 OR draw % 100 < 65 THEN cs[1] ELSE cs[2 + (draw % (len(cs) - 1))::INT] END, '' ORDER BY i), 'TAA') AS cds FROM x GROUP BY doc_id, t), u AS (SELECT doc_id, cds, min(t) AS t FROM c GROUP BY 1, 2) SELECT doc_id, t::INT AS trial, {_GCN} BETWEEN 330 AND 400 AND NOT contains(cds, 'GGTACC') AND NOT contains(cds, 'AAAAA') AS passes FROM u")
def tk02(spark, d):
    s = sequences(spark, d).select("doc_id", "aa", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("trial"))
    c = s.select("doc_id", "trial", fn.synonymous_cds(F.col("aa"), FREQUENCY, 7, F.col("trial"), F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("cds"))
    u = c.groupBy("doc_id", "cds").agg(F.min("trial").alias("trial"))
    return u.select("doc_id", "trial", (fn.count_of(F.col("cds"), "GC").between(330, 400) & ~F.contains("cds", F.lit("GGTACC")) & ~F.contains("cds", F.lit("AAAAA"))).alias("passes"))


@query("fn21_translation_matches", "SELECT doc_id, doc_id % 7 <> 0 AS matches FROM documents")
def fn21(spark, d):
    cds = fn.backtranslate(F.col("aa"), FREQUENCY)
    cds = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("TGG"), F.substr(cds, F.lit(4)))).otherwise(cds)  # a residue that the sequences don't hold
    return sequences(spark, d).select("doc_id", (fn.translate_cds(cds)["protein"] == F.col("aa")).alias("matches"))


@query("fn29_component_features", "WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS rs FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(rs, '>') AS in_order, array_to_string(list_sort(rs), '+') AS composition, len(rs)::INT AS n FROM c")
def fn29(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("rs"))
    return c.select("conv_id", F.array_join("rs", ">").alias("in_order"), F.array_join(F.sort_array("rs"), "+").alias("composition"), F.size("rs").alias("n"))


@query("ma07_binding_level", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value / 50 <= 0.5 THEN 'strong' WHEN value / 50 <= 2 THEN 'weak' ELSE 'none' END ELSE CASE WHEN value / 50 <= 1 THEN 'strong' WHEN value / 50 <= 5 THEN 'weak' ELSE 'none' END END AS level FROM events")
def ma07(spark, d):
    from ..sources.tables import binding_level

    e = table(spark, d, "events")
    return e.select("event_id", binding_level(F.when(F.col("event_id") % 2 == 0, "I").otherwise("II"), F.col("value") / 50).alias("level"))


@query("ma06_confidence_bands", "SELECT part, CASE WHEN a >= 80 AND m >= 0.7 THEN 'higher' WHEN a < 70 OR m < 0.5 THEN 'low' ELSE 'mixed' END AS band FROM (SELECT l_partkey AS part, avg(l_quantity) * 3 AS a, avg(l_discount) * 12 AS m FROM lineitem GROUP BY 1)")
def ma06(spark, d):
    g = wi.ordered_means(table(spark, d, "lineitem"), "l_partkey", ["l_quantity", "l_discount"])
    g = g.select(F.col("l_partkey").alias("part"), (F.col("l_quantity") * 3).alias("a"), (F.col("l_discount") * 12).alias("m"))
    return g.select("part", F.when((F.col("a") >= 80) & (F.col("m") >= 0.7), "higher").when((F.col("a") < 70) | (F.col("m") < 0.5), "low").otherwise("mixed").alias("band"))


@query("ma09_interval_features", f"WITH {I}, f AS (SELECT event_id, end1 - start1 + 1 AS n, event_id % 4 AS held, (event_id % 4) + (event_id % 3) AS al, least(end1 - start1 + 1, event_id % 11) AS low, least(end1 - start1 + 1, event_id % 5) AS dis, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 40 END AS dist FROM t), v AS (SELECT event_id, coalesce(held::DOUBLE / nullif(al, 0), 0.5::DOUBLE) AS r, 1.0::DOUBLE - low::DOUBLE / n AS c, 1.0::DOUBLE - dis::DOUBLE / n AS o, coalesce(1.0::DOUBLE / (1.0::DOUBLE + dist / 12.0::DOUBLE), 0.5::DOUBLE) AS b, 1.0::DOUBLE - n::DOUBLE / 600 AS k FROM f) SELECT event_id, round(r, 6) AS retention, round(b, 6) AS boundary, round((0.3::DOUBLE * r + 0.25::DOUBLE * c + 0.2::DOUBLE * o + 0.15::DOUBLE * b + 0.1::DOUBLE * k) / 1.0::DOUBLE, 6) AS priority FROM v")
def ma09(spark, d):
    e = F.col("event_id")
    n = F.col("end1") - F.col("start1") + 1
    t = intervals(spark, d).withColumns({"held_epitopes": e % 4, "all_epitopes": e % 4 + e % 3, "low_residues": F.least(n, e % 11), "disordered_residues": F.least(n, e % 5), "boundary_distance": F.when(e % 6 != 0, e % 40), "source_length": F.lit(600)})
    return se.interval_features(t, dict(zip(se.INTERVAL_FEATURES, (0.3, 0.25, 0.2, 0.15, 0.1), strict=True))).select("event_id", "retention", "boundary", "priority")


@query("ma10_fusion_features", "SELECT l_orderkey AS fusion, round(sum(l_discount * l_quantity) / sum(l_quantity), 10) AS l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 10) AS l_tax, round(1.0::DOUBLE - sum(l_quantity) / 500, 10) AS compactness FROM lineitem GROUP BY 1")
def ma10(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fusion"), F.col("l_quantity").alias("length"), "l_discount", "l_tax")
    got = se.fusion_features(p, "fusion", ["l_discount", "l_tax"], 500)
    return got.select("fusion", *[F.round(c, 10).alias(c) for c in ("l_discount", "l_tax", "compactness")])


@query("ma11_perplexity", "SELECT l_orderkey, round(avg(ln(1 + l_discount) - 2), 8) AS mean, round(exp(-avg(ln(1 + l_discount) - 2)), 6) AS perplexity FROM lineitem GROUP BY 1")
def ma11(spark, d):
    p = F.ln(1 + F.col("l_discount")) - 2
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(p), 8).alias("mean"), F.round(F.exp(-F.avg(p)), 6).alias("perplexity"))


@query("ma14_evidence_ratio", "SELECT c_custkey, coalesce(o.f::DOUBLE / nullif(o.n, 0), 0.0) AS ratio FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def ma14(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.try_divide("f", "n"), F.lit(0.0)).alias("ratio"))


@query("jn04_evidence_checks", f"WITH {I} SELECT CASE WHEN c.c_custkey IS NULL THEN 'unknown_candidate' WHEN NOT (start1 >= 1 AND start1 <= end1 AND end1 <= 450) THEN 'outside' ELSE 'ok' END AS status, count(*) AS n FROM t LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) c ON user_id = c_custkey GROUP BY 1")
def jn04(spark, d):
    c = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("known"))
    j = intervals(spark, d).join(c, "user_id", "left")
    inside = (F.col("start1") >= 1) & (F.col("start1") <= F.col("end1")) & (F.col("end1") <= 450)
    return j.groupBy(F.when(F.col("known").isNull(), "unknown_candidate").when(~inside, "outside").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query("jn07_positional_join", f"WITH {S}, p AS (SELECT doc_id, i AS pos, substr(aa, i, 1) AS r FROM s, range(1, 257) q(i)), f AS (SELECT i AS pos, i * 3 % 10 AS cons FROM range(6, 200) q(i)) SELECT doc_id, count(*) AS residues, count(cons)::BIGINT AS covered, sum(coalesce(cons, 0))::BIGINT AS total FROM p LEFT JOIN f ON f.pos = p.pos + (doc_id % 5) GROUP BY doc_id")
def jn07(spark, d):
    res = wi.residues(sequences(spark, d).select("doc_id", F.col("aa").alias("seq")), ["doc_id"])
    profile = spark.range(6, 200).select(F.col("id").alias("at"), (F.col("id") * 3 % 10).alias("cons"))
    j = res.withColumn("at", F.col("pos") + F.col("doc_id") % 5).join(profile, "at", "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("residues"), F.count("cons").alias("covered"), F.sum(F.coalesce("cons", F.lit(0))).alias("total"))


@query("jn10_peptide_lookup", f"WITH {S}, p AS (SELECT doc_id, 1 + (doc_id * 7 % 200)::INT AS p0, CASE WHEN doc_id % 5 = 0 THEN 'WWWWWWWWW' ELSE substr(aa, 1 + (doc_id * 7 % 200)::INT, 9) END AS pep FROM s) SELECT p.doc_id, substr(aa, p0, 9) = pep AS valid FROM p JOIN s ON s.doc_id = p.doc_id")
def jn10(spark, d):
    s = sequences(spark, d).select("doc_id", "aa")
    at = (1 + F.col("doc_id") * 7 % 200).cast("int")
    p = s.select("doc_id", at.alias("at"), F.when(F.col("doc_id") % 5 == 0, "W" * 9).otherwise(F.substr("aa", at, F.lit(9))).alias("pep"))
    return p.join(s, "doc_id").select("doc_id", (F.substr("aa", F.col("at"), F.lit(9)) == F.col("pep")).alias("valid"))


@query("jn12_source_controls", "SELECT a.p_partkey AS candidate, b.p_partkey AS control, b.p_size - a.p_size AS delta FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = 1 AND a.p_partkey <> b.p_partkey")
def jn12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    c = p.where("p_size = 1").select("p_brand", F.col("p_partkey").alias("control"), F.col("p_size").alias("s"))
    return jn.many_to_many(p, c, "p_brand", "p_partkey").where("p_partkey <> control").select(F.col("p_partkey").alias("candidate"), "control", (F.col("s") - F.col("p_size")).alias("delta"))


_GRAMS = "SELECT DISTINCT {k}, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM (SELECT {k}, regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+') AS ws FROM {t})"


@query("jn14_benchmark_semi_join", f"WITH d AS ({_GRAMS.format(k='doc_id', t='documents')}), b AS ({_GRAMS.format(k='item_id', t='benchmark')}) SELECT doc_id, count(*) AS shared FROM d WHERE g IN (SELECT g FROM b) GROUP BY 1")
def jn14(spark, d):
    grams = lambda df, k, t: df.select(k, F.explode(F.array_distinct(fn.let(F.split(F.lower(t), r"\s+"), lambda w: F.transform(fn.indexes(F.size(w) - 7), lambda i: F.array_join(F.slice(w, i + 1, 8), " "))))).alias("g"))
    b = grams(table(spark, d, "benchmark"), "item_id", "text").select("g").distinct()
    return grams(table(spark, d, "documents"), "doc_id", "text").join(b, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query("jn16_zip_equality", "SELECT count(*) AS n, count(*) FILTER (a.pos IS NULL OR b.pos IS NULL)::BIGINT AS missing, count(*) FILTER (abs(a.v - b.v) > 1e-7)::BIGINT AS differing FROM (SELECT event_id AS pos, value AS v FROM events WHERE event_type <> 'error') a FULL OUTER JOIN (SELECT event_id AS pos, value + (event_type = 'click')::INT AS v FROM events WHERE event_type <> 'signup') b ON a.pos = b.pos")
def jn16(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type <> 'error'").select(F.col("event_id").alias("pos"), F.col("value").alias("v"))
    b = e.where("event_type <> 'signup'").select(F.col("event_id").alias("pos"), (F.col("value") + F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("w"))
    j = jn.paired(a, b, "pos")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "both").alias("missing"), F.count_if(F.abs(F.col("v") - F.col("w")) > 1e-7).alias("differing"))


@query("jn20_linker_patterns", "SELECT a.r_name AS l1, b.r_name AS l2, concat(a.r_name, b.r_name) AS text FROM region a, region b")
def jn20(spark, d):
    return se.linker_patterns(table(spark, d, "region").select(F.col("r_name").alias("linker")), 2)


@query("jn21_boundary_grid", f"WITH {I}, a AS (SELECT user_id, start1 + o AS s, max(event_id) AS ss FROM t, (VALUES (-2), (0), (2)) v(o) GROUP BY 1, 2), b AS (SELECT user_id, end1 + o AS e, max(event_id) AS es FROM t, (VALUES (-2), (0), (2)) v(o) GROUP BY 1, 2) SELECT a.user_id AS key, count(*) AS n, max(ss + es) AS best FROM a JOIN b ON a.user_id = b.user_id WHERE s >= 1 AND e - s + 1 >= 30 GROUP BY 1")
def jn21(spark, d):
    t = intervals(spark, d)
    ends = lambda c: t.select(F.col("user_id").alias("key"), F.col(c).alias("pos"), F.col("event_id").alias("score"))
    return se.best_boundaries(ends("start1"), ends("end1"), [-2, 0, 2], 30).select("key", "n", F.col("score").alias("best"))


@query("jn21_best_boundaries", f"WITH {I}, a AS (SELECT event_type, start1 + o AS s, max(event_id % 97) AS ss FROM t, (VALUES (-4), (0), (4)) v(o) GROUP BY 1, 2), b AS (SELECT event_type, end1 + o AS e, max(event_id % 89) AS es FROM t, (VALUES (-4), (0), (4)) v(o) GROUP BY 1, 2) SELECT a.event_type AS key, s, e, ss + es AS score FROM a JOIN b ON a.event_type = b.event_type WHERE s >= 1 AND e - s + 1 >= 60 QUALIFY row_number() OVER (PARTITION BY a.event_type ORDER BY ss + es DESC, s, e) = 1")
def jn21_best(spark, d):
    """A few keys, with all events' starts and ends: their product is never made."""
    t = intervals(spark, d)
    ends = lambda c, m: t.select(F.col("event_type").alias("key"), F.col(c).alias("pos"), (F.col("event_id") % m).alias("score"))
    return se.best_boundaries(ends("start1", 97), ends("end1", 89), [-4, 0, 4], 60).select("key", "s", "e", "score")


@query("fi13_reconstruction", "WITH c AS (SELECT conv_id, turn, text AS x FROM conversations) SELECT conv_id, string_agg(x, '' ORDER BY turn) AS sequence, sum(length(x))::BIGINT AS last_end FROM c GROUP BY 1")
def fi13(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("x"))
    return se.reconstructed(c, "conv_id", "turn", "x").select("conv_id", "sequence", F.element_at("places", -1)["end1"].alias("last_end"))


@query("fi08_mutation_faults", f"WITH {S}, p AS (SELECT doc_id, aa AS a, concat(substr(aa, 1, 4), 'W', substr(aa, 6, 5), CASE WHEN doc_id % 2 = 0 THEN 'W' ELSE substr(aa, 11, 1) END, substr(aa, 12), CASE WHEN doc_id % 7 = 0 THEN 'W' ELSE '' END) AS b FROM s) SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'length' END, CASE WHEN doc_id % 2 = 0 THEN 'not_mutable' END, CASE WHEN doc_id % 2 = 0 THEN 'protected' END, CASE WHEN doc_id % 2 = 0 THEN 'too_many' END) AS faults FROM p")
def fi08(spark, d):
    m = F.col("doc_id")
    cut = lambda a, n: F.substr("aa", F.lit(a), F.lit(n))
    variant = F.concat(cut(1, 4), F.lit("W"), cut(6, 5), F.when(m % 2 == 0, "W").otherwise(cut(11, 1)), cut(12, 300), F.when(m % 7 == 0, "W").otherwise(""))
    faults = se.mutation_faults(F.col("aa"), variant, F.array(*map(F.lit, (5, 6, 7))), F.array(F.lit(11)), 1)
    return sequences(spark, d).select("doc_id", F.array_join(faults, ",").alias("faults"))


@query("wi04_low_complexity", f"WITH {S}, w AS (SELECT doc_id, i, substr(translate(aa, 'DEFGHIKL', 'AAAACCCC'), i, 12) AS x FROM s, range(1, 246) q(i)), c AS (SELECT doc_id, i, sum(-(n / 12.0) * log2(n / 12.0)) AS h FROM (SELECT doc_id, i, substr(x, k, 1) AS r, count(*) AS n FROM w, range(1, 13) z(k) GROUP BY 1, 2, 3) GROUP BY 1, 2), l AS (SELECT doc_id, i AS s, i + 11 AS e FROM c WHERE h < 1.6), b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM l), f AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT doc_id, min(s)::INT AS start1, max(e)::INT AS end1 FROM f GROUP BY doc_id, g")
def wi04(spark, d):
    s = sequences(spark, d).select("doc_id", F.translate("aa", "DEFGHIKL", "AAAACCCC").alias("seq"))
    w = s.select("doc_id", F.explode(F.transform(fn.indexes(F.length("seq") - 11), lambda i: F.struct((i + 1).alias("i"), F.substr("seq", i + 1, F.lit(12)).alias("x")))).alias("w"))
    hits = w.where(fn.entropy(F.col("w.x"), "ACMNPQRS") < 1.6).select("doc_id", F.col("w.i").alias("start1"), (F.col("w.i") + 11).alias("end1"))
    return wi.merge_intervals(hits, ["doc_id"])


@query("wi14_short_ids", "SELECT p_partkey, concat('c', lpad((row_number() OVER (ORDER BY p_partkey) - 1)::VARCHAR, 6, '0')) AS short_id FROM part")
def wi14(spark, d):
    return wi.short_ids(table(spark, d, "part").select("p_partkey"), ["p_partkey"], digits=6)


@query("ag08_liability_counts", "WITH l AS (SELECT l_orderkey, 'high' AS severity FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_orderkey, 'medium' FROM lineitem WHERE l_tax > 0.07 UNION ALL SELECT l_orderkey, 'low' FROM lineitem WHERE l_quantity < 3) SELECT l_orderkey, count(*) FILTER (severity = 'high')::BIGINT AS high, count(*) FILTER (severity = 'medium')::BIGINT AS medium, count(*) FILTER (severity = 'low')::BIGINT AS low FROM l GROUP BY 1")
def ag08(spark, d):
    l = table(spark, d, "lineitem")
    parts = [l.where(c).select("l_orderkey", F.lit(s).alias("severity")) for c, s in (("l_discount > 0.08", "high"), ("l_tax > 0.07", "medium"), ("l_quantity < 3", "low"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("l_orderkey").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


@query("ag09_lane_counts", "WITH p AS (SELECT CASE WHEN p_size > 40 THEN 'priority' WHEN p_brand LIKE '%3' THEN 'diversity_rescue' ELSE 'archive' END AS lane FROM part) SELECT l.lane, count(p.lane)::BIGINT AS n FROM (VALUES ('priority'), ('diversity_rescue'), ('archive'), ('review')) l(lane) LEFT JOIN p ON p.lane = l.lane GROUP BY 1")
def ag09(spark, d):
    lane = F.when(F.col("p_size") > 40, "priority").when(F.col("p_brand").endswith("3"), "diversity_rescue").otherwise("archive")
    counts = table(spark, d, "part").groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))
    lanes = spark.createDataFrame([(x,) for x in ("priority", "diversity_rescue", "archive", "review")], "lane string")
    return lanes.join(counts, "lane", "left").fillna(0, ["n"])


@query("ag10_design_rollup", "SELECT c_custkey, max(o_totalprice) AS top, round(avg(o_totalprice), 4) AS mean, bool_or(o_orderstatus = 'F') AS any_f, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / nullif(count(o_orderkey), 0), 8) AS share_f FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def ag10(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")), 8).alias("share_f"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("ag19_search_statistics", "SELECT p_brand, status, count(*) AS n FROM (SELECT p_brand, CASE WHEN p_size < 5 THEN 'filtered' WHEN p_size < 40 THEN 'eligible' ELSE 'over_budget' END AS status FROM part) GROUP BY GROUPING SETS ((p_brand, status), (p_brand), ())")
def ag19(spark, d):
    status = F.when(F.col("p_size") < 5, "filtered").when(F.col("p_size") < 40, "eligible").otherwise("over_budget")
    return table(spark, d, "part").select("p_brand", status.alias("status")).rollup("p_brand", "status").agg(F.count("*").alias("n"))


@query("ag22_component_confidence", f"WITH {S}, r AS (SELECT doc_id, i AS pos, (doc_id * 31 + i * 17) % 100 AS plddt FROM s, range(1, 121) q(i)), c AS (SELECT doc_id, k, k * 40 + 1 AS a, k * 40 + 40 AS b FROM s, range(3) q(k)) SELECT c.doc_id, k::INT AS component, round(avg(plddt), 6) AS mean, min(plddt)::INT AS low, round(count(*) FILTER (plddt >= 90)::DOUBLE / count(*), 6) AS share90, round(count(*) FILTER (plddt < 50)::DOUBLE / count(*), 6) AS share50 FROM c JOIN r ON r.doc_id = c.doc_id AND pos BETWEEN a AND b GROUP BY 1, 2")
def ag22(spark, d):
    s = table(spark, d, "documents").select("doc_id")
    r = s.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(120))).alias("pos")).withColumn("plddt", (F.col("doc_id") * 31 + F.col("pos") * 17) % 100)
    # Components tile the chain, so the range join is an equi-join on the tile.
    g = r.withColumn("component", F.floor((F.col("pos") - 1) / 40).cast("int")).groupBy("doc_id", "component")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return g.agg(F.round(F.avg("plddt"), 6).alias("mean"), F.min("plddt").cast("int").alias("low"), share(F.col("plddt") >= 90).alias("share90"), share(F.col("plddt") < 50).alias("share50"))


@query("ag24_blocking_actions", "WITH st AS (SELECT * FROM (VALUES ('intake', 1), ('search', 2), ('structure', 3), ('ranking', 4)) v(stage, pos)), a AS (SELECT o_orderkey AS action, (o_orderkey % 4 + 1) AS due FROM orders) SELECT stage, count(*) AS n, min(action) AS first FROM st JOIN a ON due <= pos GROUP BY 1")
def ag24(spark, d):
    stages = spark.createDataFrame([("intake", 1), ("search", 2), ("structure", 3), ("ranking", 4)], "stage string, pos int")
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("action"), (F.col("o_orderkey") % 4 + 1).alias("due"))
    return a.join(F.broadcast(stages), F.col("due") <= F.col("pos")).groupBy("stage").agg(F.count("*").alias("n"), F.min("action").alias("first"))  # four stages


@query("se05_feature_coverage", "WITH a AS (SELECT DISTINCT p_type AS f FROM part), c AS (SELECT DISTINCT p_type AS f FROM part WHERE p_size >= 49) SELECT f, f IN (SELECT f FROM c) AS covered FROM a")
def se05(spark, d):
    p = table(spark, d, "part")
    c = p.where("p_size >= 49").select("p_type").distinct().withColumn("c", F.lit(True))
    return p.select("p_type").distinct().join(c, "p_type", "left").select(F.col("p_type").alias("f"), F.coalesce("c", F.lit(False)).alias("covered"))


@query("se04_inventory_conflicts", "SELECT n_chars AS key, count(DISTINCT lang) AS variants FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def se04(spark, d):
    return table(spark, d, "documents").groupBy(F.col("n_chars").alias("key")).agg(F.count_distinct("lang").alias("variants")).where("variants > 1")


@query("se06_anchor_union", f"WITH {I}, u AS (SELECT user_id AS key, start1 AS pos, 'start' AS source FROM t UNION SELECT user_id, end1, 'end' FROM t UNION SELECT user_id, 1, 'terminal' FROM t) SELECT key, pos, string_agg(source, '+' ORDER BY source) AS sources FROM u GROUP BY 1, 2")
def se06(spark, d):
    t = intervals(spark, d)
    one = lambda c: t.select(F.col("user_id").alias("key"), c.cast("long").alias("pos"))
    return se.anchors({"start": one(F.col("start1")), "end": one(F.col("end1")), "terminal": one(F.lit(1))}).select("key", "pos", F.array_join("sources", "+").alias("sources"))


@query("it02_lane_rules", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'priority' WHEN p_brand LIKE '%3' THEN 'diversity_rescue' ELSE 'archive' END AS lane FROM part")
def it02(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "priority").when(F.col("p_brand").endswith("3"), "diversity_rescue").otherwise("archive").alias("lane"))


_PIECES = "concat(substr(a.aa, d.doc_id % 40 + 1, 30 + d.doc_id % 50), 'WYWY', substr(b.aa, d.doc_id % 90 + 1, 20 + d.doc_id % 70), repeat('V', (d.doc_id % 4)::INT))"
_SUPPLIERS = f"(SELECT s_suppkey, {derived_sql('CAST(s_suppkey AS VARCHAR)', AA)} AS aa FROM supplier)"
_CUT = (
    f"WITH RECURSIVE l AS MATERIALIZED (SELECT 'source' || s_suppkey AS name, aa FROM {_SUPPLIERS}), n AS (SELECT max(s_suppkey) AS n FROM supplier), "
    f"q AS MATERIALIZED (SELECT d.doc_id, {_PIECES} AS t FROM documents d, n JOIN {_SUPPLIERS} a ON a.s_suppkey = d.doc_id % n.n + 1 JOIN {_SUPPLIERS} b ON b.s_suppkey = (d.doc_id * 7) % n.n + 1), "
    "h AS (SELECT q.doc_id, x.a AS pos, y.name, y.b, substr(q.t, x.a + 1) AS u, substr(y.aa, y.b + 1) AS v FROM q, LATERAL (SELECT unnest(range(length(q.t) - 7)) AS a) x JOIN (SELECT name, aa, unnest(range(249)) AS b FROM l) y ON substr(q.t, x.a + 1, 8) = substr(y.aa, y.b + 1, 8)), "
    "m AS MATERIALIZED (SELECT doc_id, pos, name, b, coalesce(list_filter(range(1, least(length(u), length(v)) + 1), lambda i: substr(u, i, 1) <> substr(v, i, 1))[1] - 1, least(length(u), length(v))) AS n FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, name DESC, b DESC) = 1), "
    "w AS (SELECT doc_id, -1::BIGINT AS pos, 0::BIGINT AS n, NULL::VARCHAR AS name, NULL::BIGINT AS b FROM q UNION ALL SELECT m.doc_id, m.pos, m.n, m.name, m.b FROM w JOIN m ON m.doc_id = w.doc_id AND m.pos = (SELECT min(o.pos) FROM m o WHERE o.doc_id = w.doc_id AND o.pos >= greatest(w.pos, 0) + w.n)), "
    "g AS (SELECT w.doc_id, greatest(w.pos, 0) + w.n AS s, coalesce(lead(w.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos), length(q.t)) AS e FROM w JOIN q ON q.doc_id = w.doc_id), "
    "p AS (SELECT doc_id, name AS source, pos AS start0, n AS length, b AS offset0 FROM w WHERE pos >= 0 UNION ALL SELECT doc_id, NULL, s, e - s, NULL FROM g WHERE e > s) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start0) - 1)::INT AS place, source, start0::INT AS start0, length::INT AS length, offset0::INT AS offset0 FROM p"
)


@query("it04_segments", _CUT)
def it04(spark, d):
    """Sequences joined from parts of two suppliers' sequences, cut again, against the sequences of all suppliers."""
    keys, residues = table(spark, d, "supplier").select("s_suppkey"), lambda k: derived(F.col(k).cast("string"), AA)
    n = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("n"))
    docs = table(spark, d, "documents").select("doc_id").join(F.broadcast(n))  # one row
    i = F.col("doc_id")
    docs = docs.select("doc_id", (i % F.col("n") + 1).alias("s_suppkey"), (i * 7 % F.col("n") + 1).alias("k2"))
    # Sequences are made where keys have met: the planner takes them for as short as the table.
    docs = docs.join(keys.hint("shuffle_merge"), "s_suppkey").join(keys.select(F.col("s_suppkey").alias("k2")).hint("shuffle_merge"), "k2")
    docs = docs.select("doc_id", residues("s_suppkey").alias("aa"), residues("k2").alias("bb"))
    part = lambda c, m, k, j: F.substr(c, (i % m + 1).cast("int"), (k + i % j).cast("int"))
    text = F.concat(part("aa", 40, 30, 50), F.lit("WYWY"), part("bb", 90, 20, 70), F.repeat(F.lit("V"), (i % 4).cast("int")))
    library = keys.select(F.concat(F.lit("source"), F.col("s_suppkey").cast("string")).alias("name"), residues("s_suppkey").alias("aa"))
    return se.segments(docs.select("doc_id", text.alias("t")), "doc_id", "t", library, "name", "aa")


@query("jn23_tiling", "WITH p AS (SELECT p_partkey, replace(p_brand, '#', '') AS t FROM part), x AS (SELECT p_partkey, t, regexp_extract_all(t, 'Brand|22|[0-9]') AS ps FROM p) SELECT p_partkey, CASE WHEN array_to_string(ps, '') = t THEN list_transform(ps, lambda e: CASE e WHEN 'Brand' THEN 'brand' WHEN '22' THEN 'two' ELSE e END) END AS names FROM x")
def jn23(spark, d):
    q = table(spark, d, "part").select("p_partkey", F.translate(F.col("p_brand"), "#", "").alias("t"))
    return se.tile(q, "p_partkey", "t", [("brand", "Brand"), *((str(k), str(k)) for k in range(10)), ("two", "22")])


@query("it05_lineage", "WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 3 AS parent FROM part WHERE p_partkey > 1), w AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT e.k, depth + 1 FROM e JOIN w ON e.parent = w.k) SELECT k, depth FROM w")
def it05(spark, d):
    from ..operators.graph import depths

    e = table(spark, d, "part").where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 3).cast("long").alias("src"), F.col("p_partkey").alias("dst"))
    return depths(e, 1).select(F.col("node").alias("k"), "depth")


@query("tk08_best_alpha", "SELECT g, a AS alpha FROM (SELECT l_returnflag AS g, l_linenumber AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(avg(l_discount), 6) DESC, round(avg(l_tax), 6), l_linenumber) AS rn FROM lineitem GROUP BY l_returnflag, l_linenumber) WHERE rn = 1")
def tk08(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("alpha")).agg(F.round(F.avg("l_discount"), 6).alias("rho"), F.round(F.avg("l_tax"), 6).alias("mse"))
    return m.where(ag.finite(F.col("rho"))).groupBy("g").agg(F.max_by("alpha", F.struct("rho", -F.col("mse"), -F.col("alpha"))).alias("alpha"))


def _draw(*parts: str) -> str:
    return "('0x' || substr(sha256(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def shuffle_sql(rows: str, keys: str, buffer: int, seed: str, name: str) -> str:
    """The sliding buffer as CTEs: rows has i (from 0) and n; the result, `name`, has p, the place after the shuffle."""
    return (
        f"a AS (SELECT *, CASE WHEN i < {buffer} THEN i ELSE {_draw(seed, 'i')} % {buffer} END AS slot FROM {rows}), b AS (SELECT *, lead(i) OVER (PARTITION BY {keys}, slot ORDER BY i) AS o FROM a), "
        f"{name} AS (SELECT *, CASE WHEN o IS NOT NULL THEN o - {buffer} ELSE n - least(n, {buffer}) - 1 + row_number() OVER (PARTITION BY {keys}, o IS NULL ORDER BY {_draw(seed, chr(39) + 'end' + chr(39), 'i')}, i) END AS p FROM b)"
    )


@query("tk11_buffered_shuffle", "WITH r AS (SELECT event_type AS t, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), " + shuffle_sql("r", "t", 64, "'7'", "s") + " SELECT t AS event_type, event_id, p AS place FROM s")
def tk11(spark, d):
    from ..streaming.shuffle import shuffled

    return shuffled(table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", 64, 7)


@query("st03_file_shard", "SELECT ((user_id % 3) * 2 + event_id % 2)::INT AS part, count(*) AS lines FROM events GROUP BY 1")
def st03(spark, d):
    from ..streaming.readers import file_shard

    return file_shard(table(spark, d, "events"), "user_id", "event_id", 3, 2).groupBy("part").agg(F.count("*").alias("lines"))


@query("st04_byte_range", "WITH l AS (SELECT user_id AS f, event_id AS i, octet_length(encode(props)) + 1 AS n FROM events), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0, sum(n) OVER (PARTITION BY f) AS total FROM l) SELECT (((off0 + 1) * 4 - 1) // total)::INT AS part, count(*) AS lines FROM p GROUP BY 1")
def st04(spark, d):
    from ..streaming.readers import byte_range

    return byte_range(table(spark, d, "events"), "user_id", "event_id", "props", 2, 2).groupBy("part").agg(F.count("*").alias("lines"))


@query("dq01_checks", "SELECT 'orders-have-customers' AS check_id, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n::VARCHAR AS detail FROM (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'lines-have-orders', CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END, n::VARCHAR FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'prices-positive', CASE WHEN n = 0 THEN 'pass' ELSE 'warn' END, n::VARCHAR FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 1000)")
def dq01(spark, d):
    o, c, l = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem")
    return vf.all_checks(
        vf.references("orders-have-customers", o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k")), "k"),
        vf.references("lines-have-orders", l.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), "k"),
        vf.check(o, "prices-positive", F.col("o_totalprice") < 1000, warn=True),
    )


@query("dq03_recompute", "SELECT 'ranking-reproducibility' AS check_id, 'pass' AS status, '0' AS detail")
def dq03(spark, d):
    from .tables import wi01

    return vf.reproduced("ranking-reproducibility", wi01(spark, d), wi01(spark, d).repartition(3))


@query("dq08_product_assembly", f"WITH {S} SELECT doc_id, concat('M', CASE WHEN doc_id % 2 = 0 THEN 'GS' ELSE '' END, substr(aa, 1, 10), CASE WHEN doc_id % 3 = 0 THEN 'HHHHHH' ELSE '' END) AS product, sha256(concat('M', CASE WHEN doc_id % 2 = 0 THEN 'GS' ELSE '' END, substr(aa, 1, 10), CASE WHEN doc_id % 3 = 0 THEN 'HHHHHH' ELSE '' END)) AS digest FROM s")
def dq08(spark, d):
    m = F.col("doc_id")
    elements = F.array(F.lit("M"), F.when(m % 2 == 0, "GS"), F.substr("aa", F.lit(1), F.lit(10)), F.when(m % 3 == 0, "HHHHHH"))
    return sequences(spark, d).select("doc_id", F.array_join(F.filter(elements, lambda x: x.isNotNull()), "").alias("product")).withColumn("digest", hs.sha256(F.col("product")))


@query("dq12_paired_arms", "WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r1, row_number() OVER (ORDER BY p_size + 0.25 * (p_partkey % 7) DESC, p_partkey) AS r2 FROM part) SELECT round(avg(abs(r1 - r2)), 6) AS mean_change, max(abs(r1 - r2))::BIGINT AS top_change, count(*) FILTER (r1 <= 10 AND r2 <= 10)::BIGINT AS top10 FROM a")
def dq12(spark, d):
    p = table(spark, d, "part").withColumn("w", F.col("p_size") + 0.25 * (F.col("p_partkey") % 7))
    a = wi.numbered(wi.numbered(p, [F.desc("p_size"), "p_partkey"], "r1"), [F.desc("w"), "p_partkey"], "r2")
    delta = F.abs(F.col("r1") - F.col("r2"))
    return a.agg(F.round(F.avg(delta), 6).alias("mean_change"), F.max(delta).cast("long").alias("top_change"), F.count_if((F.col("r1") <= 10) & (F.col("r2") <= 10)).alias("top10"))
