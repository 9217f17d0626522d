"""Queries over the star tables, events and embeddings: joins, windows, ranking, selection, metrics, streams of lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import INTERVALS_SQL, SEQUENCES_SQL, TEXT_NT_SQL, intervals, sequences, text_sequences
from ..functions import hashing as hs
from ..functions.constants import HYDROPATHY
from ..operators import aggregates as ag
from ..operators import diversity as dv
from ..operators import joins as jn
from ..operators import scoring as sc
from ..operators import skyline as sk
from ..operators import space as sp
from ..operators import topk as tk
from ..operators import windows as wi
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- Hashes, splits, shards ------------------------------------------------------------------------------------

S = f"s AS (SELECT * FROM {SEQUENCES_SQL})"
_B = "(('0x' || substr(sha256(concat('7', chr(0), nt)), 1, 15))::BIGINT % 10000)::INT"


@query("hs01_canonical_ids", f"WITH {S} SELECT doc_id, sha256(concat('{{\"doc\":\"', doc_id, '\",\"seq\":\"', nt, '\"}}')) AS digest, concat('ev-', substr(sha256(concat(doc_id, '|', lang)), 1, 24)) AS evidence_id, sha256(nt) AS seq_sha256 FROM s")
def hs01(spark, d):
    i = F.col("doc_id").cast("string")
    return sequences(spark, d).select("doc_id", hs.canonical_sha256(seq=F.col("nt"), doc=i).alias("digest"), hs.short_id("ev-", 24, i, F.col("lang")).alias("evidence_id"), hs.sha256(F.col("nt")).alias("seq_sha256"))


@query("hs04_split_bucket", f"WITH {S} SELECT doc_id, {_B} AS bucket, {_B} < 500 AS validation FROM s")
def hs04(spark, d):
    k = hs.validation_buckets(0.05)
    return sequences(spark, d).withColumn("bucket", hs.bucket(F.col("nt"), 7)).select("doc_id", "bucket", (F.col("bucket") < k).alias("validation"))


@query("hs04_blake_bucket")
def hs04b(spark, d):
    return sequences(spark, d).select("doc_id", hs.blake_bucket(7)(F.col("nt")).alias("bucket"))


@query("ag15_split_counts", f"WITH {S} SELECT count(*) AS n, sum(({_B} < 500)::INT)::BIGINT AS validation, sum(({_B} >= 500)::INT)::BIGINT AS training FROM s")
def ag15(spark, d):
    b = hs.bucket(F.col("nt"), 7)
    return sequences(spark, d).agg(F.count("*").alias("n"), F.count_if(b < 500).alias("validation"), F.count_if(b >= 500).alias("training"))


@query("ag16_shard_counts", f"WITH {S} SELECT ({_B} % 8)::INT AS shard, count(*) AS lines, sum(octet_length(encode(nt)) + 1)::BIGINT AS bytes FROM s GROUP BY 1")
def ag16(spark, d):
    return sequences(spark, d).withColumn("shard", hs.bucket(F.col("nt"), 7) % 8).groupBy("shard").agg(F.count("*").alias("lines"), F.sum(F.octet_length("nt") + 1).cast("long").alias("bytes"))


_SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"
_PRIO = "CASE doc_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END"


def _split(df):
    m = F.col("doc_id") % 10
    return df.withColumn("split", F.when(m == 0, "test").when(m == 1, "dev").otherwise("train")).withColumn("prio", F.when(m == 0, 0).when(m == 1, 1).otherwise(2))


@query("jn15_split_leakage", f"WITH t AS (SELECT doc_id, nt, {_SPLIT} AS split, {_PRIO} AS prio FROM {TEXT_NT_SQL}), w AS (SELECT *, row_number() OVER (PARTITION BY nt ORDER BY prio, doc_id) AS rn, first_value(split) OVER (PARTITION BY nt ORDER BY prio, doc_id) AS first FROM t) SELECT split, CASE WHEN rn = 1 THEN 'kept' WHEN first = split THEN 'within_split' ELSE 'cross_split' END AS status, count(*) AS n FROM w GROUP BY 1, 2")
def jn15(spark, d):
    w = Window.partitionBy("nt").orderBy("prio", "doc_id")
    rows = _split(text_sequences(spark, d)).withColumn("rn", F.row_number().over(w)).withColumn("first", F.first("split").over(w))
    status = F.when(F.col("rn") == 1, "kept").when(F.col("first") == F.col("split"), "within_split").otherwise("cross_split")
    return rows.groupBy("split", status.alias("status")).agg(F.count("*").alias("n"))


@query("wi10_first_occurrence", f"SELECT doc_id, nullif(first_value(doc_id) OVER (PARTITION BY nt ORDER BY doc_id), doc_id) AS duplicate_of FROM {TEXT_NT_SQL}")
def wi10(spark, d):
    return wi.first_occurrence(text_sequences(spark, d), ["nt"], ["doc_id"], "doc_id").select("doc_id", "duplicate_of")


@query("ag02_codon_usage", f"WITH {S}, c AS (SELECT substr(nt, 3 * i + 1, 3) AS codon, count(*) AS n FROM s, range(85) r(i) GROUP BY 1), f AS (SELECT codon, n FROM c WHERE codon NOT IN ('TAA', 'TAG', 'TGA')) SELECT codon, n, round(n::DOUBLE / sum(n) OVER (), 10) AS frequency FROM f")
def ag02(spark, d):
    return ag.codon_usage(sequences(spark, d), "nt").select("codon", "n", F.round("frequency", 10).alias("frequency"))


@query("ag03_longest_of_group", "WITH t AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) SELECT source, doc_id FROM t WHERE rn = 1")
def ag03(spark, d):
    return ag.best_of(table(spark, d, "documents"), ["source"], "doc_id", [-F.col("n_chars"), F.col("doc_id")])


@query("fi03_reason_histogram", f"WITH {S} SELECT CASE WHEN doc_id % 11 = 0 THEN 'pseudo' WHEN doc_id % 7 = 0 THEN 'partial' WHEN contains(nt, 'AAAAA') THEN 'ambiguous' WHEN starts_with(nt, 'C') THEN 'frame' END AS reason, count(*) AS n FROM s GROUP BY 1")
def fi03(spark, d):
    i = F.col("doc_id")
    flags = {"pseudo": i % 11 == 0, "partial": i % 7 == 0, "ambiguous": F.contains("nt", F.lit("AAAAA")), "frame": F.startswith("nt", F.lit("C"))}
    return sequences(spark, d).groupBy(ag.cds_reason(flags).alias("reason")).agg(F.count("*").alias("n"))


@query("ag06_alignment_profile", f"WITH {S}, c AS (SELECT i AS pos, CASE WHEN c IN ('A', 'C') THEN '-' ELSE c END AS r FROM (SELECT i, substr(aa, i, 1) AS c FROM s, range(1, 257) q(i))), n AS (SELECT pos, r, count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT pos, r, n, sum(CASE WHEN r <> '-' THEN n ELSE 0 END) OVER (PARTITION BY pos) AS t FROM n) SELECT pos::INT AS pos, round(sum(CASE WHEN r <> '-' THEN n ELSE 0 END)::DOUBLE / sum(n), 8) AS coverage, round(max(CASE WHEN r <> '-' THEN n::DOUBLE / t END), 8) AS conservation, round(-sum(CASE WHEN r <> '-' THEN n::DOUBLE / t * log2(n::DOUBLE / t) END), 6) AS entropy FROM w GROUP BY pos")
def ag06(spark, d):
    aligned = sequences(spark, d).select("doc_id", F.translate("aa", "AC", "--").alias("x"))
    return ag.alignment_profile(aligned, "x", "doc_id").select("pos", F.round("coverage", 8).alias("coverage"), F.round("conservation", 8).alias("conservation"), F.round("entropy", 6).alias("entropy"))


# --- Events: intervals, runs, statuses --------------------------------------------------------------------------

I = f"t AS (SELECT * FROM {INTERVALS_SQL})"
_MERGED = ", o AS (SELECT DISTINCT user_id, start1, end1 FROM t), b AS (SELECT *, max(end1) OVER (PARTITION BY user_id ORDER BY start1, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o), f AS (SELECT *, sum(CASE WHEN pe IS NULL OR start1 > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start1, end1 ROWS UNBOUNDED PRECEDING) AS g FROM b), m AS (SELECT user_id, min(start1) AS start1, max(end1) AS end1 FROM f GROUP BY user_id, g)"


@query("wi06_merge_intervals", f"WITH {I}{_MERGED} SELECT user_id, start1, end1 FROM m")
def wi06(spark, d):
    return wi.merge_intervals(intervals(spark, d).select("user_id", "start1", "end1").distinct(), ["user_id"])


@query("wi05_merge_windows", f"WITH {I}, b AS (SELECT *, max(end1) OVER (PARTITION BY user_id ORDER BY start1, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM t), f AS (SELECT *, sum(CASE WHEN pe IS NULL OR start1 > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start1, end1 ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(start1) AS start1, max(end1) AS end1, max(event_id) AS top, count(*) AS n FROM f GROUP BY user_id, g")
def wi05(spark, d):
    return wi.merge_intervals(intervals(spark, d), ["user_id"], "start1", "end1", F.max("event_id").alias("top"), F.count("*").alias("n"))


@query("jn05_containment", f"WITH {I}{_MERGED}, i AS (SELECT user_id, event_id, start1 AS s, end1 AS e FROM t WHERE event_type = 'view') SELECT i.user_id, event_id, s - m.start1 AS offset0 FROM i JOIN m ON m.user_id = i.user_id AND s >= m.start1 AND e <= m.end1")
def jn05(spark, d):
    t = intervals(spark, d)
    outer = wi.merge_intervals(t.select("user_id", "start1", "end1").distinct(), ["user_id"])
    inner = t.where("event_type = 'view'").select("user_id", "event_id", F.col("start1").alias("s"), F.col("end1").alias("e"))
    return jn.contained(outer, inner, "user_id", ("start1", "end1"), ("s", "e"), "event_id").select("user_id", "event_id", "offset0")


@query("jn06_overlap_length", f"WITH {I}, q AS (SELECT user_id, event_id, start1 AS s, end1 AS e FROM t WHERE event_type = 'click'){_MERGED} SELECT q.user_id, event_id, coalesce(sum(CASE WHEN start1 IS NULL THEN 0 ELSE greatest(0, least(e, end1) - greatest(s, start1) + 1) END), 0)::BIGINT AS covered FROM q LEFT JOIN m ON m.user_id = q.user_id AND start1 <= e AND end1 >= s GROUP BY 1, 2".replace("o AS (SELECT DISTINCT user_id, start1, end1 FROM t)", "o AS (SELECT DISTINCT user_id, start1, end1 FROM t WHERE event_type <> 'click')"))
def jn06(spark, d):
    t = intervals(spark, d)
    spans = t.where("event_type = 'click'").select("user_id", "event_id", F.col("start1").alias("s"), F.col("end1").alias("e"))
    merged = wi.merge_intervals(t.where("event_type <> 'click'").select("user_id", "start1", "end1").distinct(), ["user_id"])
    return jn.overlap_lengths(spans, merged, "user_id", "event_id", ("s", "e"), ("start1", "end1")).select("user_id", "event_id", F.col("covered").cast("long").alias("covered"))


@query("wi08_label_runs", "WITH t AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) SELECT conv_id, role, min(turn)::INT AS start1, max(turn)::INT AS end1 FROM t GROUP BY conv_id, role, g")
def wi08(spark, d):
    return wi.label_runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("wi09_neighbours", "WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) SELECT * FROM t WHERE next_turn IS NOT NULL")
def wi09(spark, d):
    return wi.neighbours(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role", "turn"])


_TENTHS = "CASE substr(translate(aa, 'DEHKNPQR', 'LLAVIFAM'), i, 1) " + " ".join(f"WHEN '{a}' THEN {round(v * 10)}" for a, v in HYDROPATHY.items()) + " END"


@query("wi03_hydrophobic_regions", f"WITH s AS (SELECT * FROM {SEQUENCES_SQL}), r AS (SELECT doc_id, i AS pos, {_TENTHS} AS v FROM s, range(1, 257) q(i)), w AS (SELECT doc_id, pos, sum(v) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS t FROM r), h AS (SELECT doc_id, pos - 18 AS a, pos AS b, t FROM w WHERE pos >= 19 AND t >= 304), g AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM h), k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS grp FROM g) SELECT doc_id, min(a)::INT AS start1, max(b)::INT AS end1, max(t)::BIGINT AS top FROM k GROUP BY doc_id, grp")
def wi03(spark, d):
    s = sequences(spark, d).select("doc_id", F.translate("aa", "DEHKNPQR", "LLAVIFAM").alias("seq"))
    return wi.hydrophobic_regions(s, ["doc_id"])


@query("wi03_sliding_mean", "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), w AS (SELECT user_id, pos, avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS score FROM e) SELECT user_id, (pos - 4)::INT AS start1, pos::INT AS end1, round(score, 6) AS score FROM w WHERE pos >= 5")
def wi03b(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return wi.sliding_mean(e, ["user_id"], "pos", "value", 5).withColumn("score", F.round("score", 6))


@query("wi07_low_runs", "WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), f AS (SELECT user_id, pos, value, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM e WHERE value < 50) SELECT user_id, min(pos)::INT AS start1, max(pos)::INT AS end1, round(avg(value), 6) AS mean FROM f GROUP BY user_id, g")
def wi07(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return wi.runs_where(e, ["user_id"], "pos", F.col("value") < 50, F.round(F.avg("value"), 6).alias("mean"))


@query("ag05_status_counts", "SELECT c.c_custkey AS user_id, count(e.event_id) FILTER (event_type = 'click')::BIGINT AS click, count(e.event_id) FILTER (event_type = 'view')::BIGINT AS view FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY 1")
def ag05(spark, d):
    spine = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return ag.status_counts(spine, table(spark, d, "events"), "user_id", "event_type", ["click", "view"])


@query("st02_line_stride", "SELECT (event_id % 6)::INT AS part, count(*) AS lines, sum(event_id)::BIGINT AS check FROM events GROUP BY 1")
def st02(spark, d):
    from ..streaming.readers import line_stride

    return line_stride(table(spark, d, "events"), "event_id", 3, 2).groupBy("part").agg(F.count("*").alias("lines"), F.sum("event_id").alias("check"))


@query("st08_cursor", "SELECT event_id, 1000 + event_id * 96 AS cursor, (1000 + event_id * 96) // 5000 AS pass, (1000 + event_id * 96) % 5000 AS at FROM events")
def st08(spark, d):
    from ..streaming.state import cursor

    return cursor(table(spark, d, "events"), "event_id", 1000, 0, 96, 5000).select("event_id", "cursor", "pass", "at")


@query("tk10_caps_and_skips", "WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT user_id, event_id FROM t WHERE rn > 2 AND rn <= 7")
def tk10(spark, d):
    return tk.capped(table(spark, d, "events"), "user_id", "event_id", 5, 2).select("user_id", "event_id")


# --- Star tables: ranking and selection ------------------------------------------------------------------------

FEATURES = [sc.Feature("qty", 0.3), sc.Feature("price", 0.2, False), sc.Feature("lines", 0.3, True, True), sc.Feature("late", 0.2, False)]
GATES = [sc.Gate("min_lines", "lines", ">=", 2), sc.Gate("max_late", "late", "<=", 1, True)]
_CAND = "c AS (SELECT p_partkey, p_brand, p_size, p_retailprice AS price, q.qty, q.lines, q.late FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty, nullif(count(*) FILTER (l_quantity >= 48), 0) AS lines, CASE WHEN count(*) FILTER (l_quantity >= 48) > 0 THEN count(*) FILTER (l_quantity >= 48 AND l_returnflag = 'R') END AS late FROM lineitem GROUP BY 1) q ON p_partkey = l_partkey)"
_NORM = ", n AS (SELECT *, (qty - min(qty) OVER ()) / (max(qty) OVER () - min(qty) OVER ()) AS n_qty, 1 - (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS n_price, (lines - min(lines) OVER ())::DOUBLE / (max(lines) OVER () - min(lines) OVER ()) AS n_lines, 1 - (late - min(late) OVER ())::DOUBLE / (max(late) OVER () - min(late) OVER ()) AS n_late FROM c)"
_SCORE = ", s AS (SELECT *, round((coalesce(n_qty * 0.3::DOUBLE, 0) + coalesce(n_price * 0.2::DOUBLE, 0) + coalesce(n_lines * 0.3::DOUBLE, 0) + coalesce(n_late * 0.2::DOUBLE, 0)) / 1.0::DOUBLE, 8) AS score, round(((n_qty IS NOT NULL)::INT * 0.3::DOUBLE + 0.2::DOUBLE + (n_lines IS NOT NULL)::INT * 0.3::DOUBLE + (n_late IS NOT NULL)::INT * 0.2::DOUBLE), 8) AS coverage, coalesce(lines >= 2, false) AND lines IS NOT NULL AND coalesce(late <= 1, false) AS eligible FROM n)"


def candidates(spark, d):
    """Parts with the quantity of all their lines, and how many lines are large and how many of these were returned; parts
    without large lines lack the latter two."""
    large = F.col("l_quantity") >= 48
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"), F.nullif(F.count_if(large), F.lit(0)).alias("lines"), F.when(F.count_if(large) > 0, F.count_if(large & (F.col("l_returnflag") == "R"))).alias("late"))
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("price"))
    return p.join(q, p["p_partkey"] == q["l_partkey"], "left").drop("l_partkey")


@query("jn03_feature_values", f"WITH {_CAND} SELECT p_partkey, price, qty, lines, late FROM c")
def jn03(spark, d):
    return candidates(spark, d).select("p_partkey", "price", "qty", "lines", "late")


@query("ma08_minmax", f"WITH {_CAND}{_NORM} SELECT p_partkey, round(n_qty, 8) AS n_qty, round(n_price, 8) AS n_price, round(n_lines, 8) AS n_lines, round(n_late, 8) AS n_late FROM n")
def ma08(spark, d):
    return sc.normalized(candidates(spark, d), FEATURES).select("p_partkey", *[F.round(f"n_{f.name}", 8).alias(f"n_{f.name}") for f in FEATURES])


@query("wi01_gated_rank", f"WITH {_CAND}{_NORM}{_SCORE} SELECT p_partkey, score, coverage, eligible, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY score DESC, p_partkey) END::INT AS rank FROM s")
def wi01(spark, d):
    return sc.scored(sc.normalized(candidates(spark, d), FEATURES), "p_partkey", FEATURES, GATES).select("p_partkey", "score", "coverage", "eligible", "rank")


@query("fi05_gate_reasons", f"WITH {_CAND}, r AS (SELECT unnest(list_filter([CASE WHEN lines IS NULL THEN 'required_feature_missing:lines' END, CASE WHEN lines < 2 THEN 'min_lines:failed' END, CASE WHEN late IS NULL THEN 'max_late:missing' WHEN late > 1 THEN 'max_late:failed' END], lambda x: x IS NOT NULL)) AS reason FROM c) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def fi05(spark, d):
    return candidates(spark, d).select(F.explode(sc.gate_reasons(FEATURES, GATES)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_ARMS = [("base", (0.3, 0.2, 0.3, 0.2))] + [(f"{i}{e}", tuple(round(w * (1 + s * 0.25), 12) if j == i else w for j, w in enumerate((0.3, 0.2, 0.3, 0.2)))) for i in range(4) for e, s in (("l", -1), ("h", 1))]


@query("ag18_sensitivity", f"WITH {_CAND}{_NORM}{_SCORE}, a AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', " + ", ".join(f"{x!r}::DOUBLE" for x in w) + ")" for n, w in _ARMS) + ") v(arm, w1, w2, w3, w4)), r AS (SELECT p_partkey, arm, eligible, round((coalesce(n_qty * w1, 0) + coalesce(n_price * w2, 0) + coalesce(n_lines * w3, 0) + coalesce(n_late * w4, 0)) / (w1 + w2 + w3 + w4), 8) AS score FROM s, a), k AS (SELECT p_partkey, CASE WHEN eligible THEN row_number() OVER (PARTITION BY arm, eligible ORDER BY score DESC, p_partkey) END AS rank FROM r) SELECT p_partkey, min(rank)::INT AS minimum_rank, max(rank)::INT AS maximum_rank, (max(rank) - min(rank))::INT AS rank_span, count(*) AS scenario_count FROM k GROUP BY 1")
def ag18(spark, d):
    return sc.sensitivity(sc.normalized(candidates(spark, d), FEATURES), "p_partkey", FEATURES, GATES, 0.25)


_KMERS = "list_distinct(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3)))"


def _portfolio_sql(rows: str, budget: int, most: float, controls: int, others: int) -> str:
    """The sequential rule, a row at a time: rows has grp, k, seq, rank, is_control."""
    similar = f"len(list_filter(pw.held, lambda h: len(list_intersect(h, pe.ks)) / len(list_distinct(list_concat(h, pe.ks))) > {most}::DOUBLE)) = 0 AND pc.k IS NULL"
    return (
        f"pe AS (SELECT *, {_KMERS} AS ks, row_number() OVER (PARTITION BY grp ORDER BY rank, k) AS i FROM {rows}), "
        f"pc AS (SELECT *, CASE WHEN is_control THEN 0 ELSE 1 END AS tier FROM pe QUALIFY row_number() OVER (PARTITION BY grp, is_control ORDER BY i) <= CASE WHEN is_control THEN {controls} ELSE {others} END), "
        "pw AS (SELECT x.grp, 0::BIGINT AS i, coalesce(h, []::VARCHAR[][]) AS held, []::BIGINT[] AS took, coalesce(n, 0) AS n FROM (SELECT DISTINCT grp FROM pe) x LEFT JOIN (SELECT grp, list(ks) AS h, count(*) AS n FROM pc GROUP BY grp) y ON y.grp = x.grp "
        f"UNION ALL SELECT pw.grp, pe.i, CASE WHEN {similar} THEN list_append(pw.held, pe.ks) ELSE pw.held END, CASE WHEN {similar} THEN list_append(pw.took, pe.k) ELSE pw.took END, pw.n + CASE WHEN {similar} THEN 1 ELSE 0 END "
        f"FROM pw JOIN pe ON pe.grp = pw.grp AND pe.i = pw.i + 1 LEFT JOIN pc ON pc.grp = pe.grp AND pc.k = pe.k WHERE pw.n < {budget}), "
        "pz AS (SELECT grp, unnest(took) AS k, 2 AS tier, unnest(range(len(took))) AS i FROM (SELECT grp, arg_max(took, i) AS took FROM pw GROUP BY grp)) "
        "SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY tier, i)::INT AS place, CASE tier WHEN 0 THEN 'required_control' WHEN 1 THEN 'required_other' ELSE 'rank_and_diversity' END AS reason "
        "FROM (SELECT grp, k, tier, i FROM pc UNION ALL SELECT grp, k, tier, i FROM pz)"
    )


@query("tk07_portfolio", f"WITH RECURSIVE {_CAND}{_NORM}{_SCORE}, r AS (SELECT p_size AS grp, p_partkey AS k, concat(md5(p_brand), substr(md5((p_partkey % 40)::VARCHAR), 1, 16)) AS seq, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank, p_partkey % 20 = 0 AS is_control FROM s WHERE eligible), " + _portfolio_sql("r", 8, 0.4, 1, 1).replace("SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY tier, i)::INT AS place", "SELECT grp, k AS p_partkey, row_number() OVER (PARTITION BY grp ORDER BY tier, i)::INT AS place"))
def tk07(spark, d):
    ranked = sc.scored(sc.normalized(candidates(spark, d), FEATURES), "p_partkey", FEATURES, GATES).where("eligible")
    seq = F.concat(F.md5(F.col("p_brand").cast("binary")), F.substr(F.md5((F.col("p_partkey") % 40).cast("string").cast("binary")), F.lit(1), F.lit(16)))
    ranked = ranked.select("p_partkey", seq.alias("seq"), F.col("p_size").alias("grp"), "rank", (F.col("p_partkey") % 20 == 0).alias("is_control"))
    return dv.portfolio(ranked, "p_partkey", "seq", "grp", 8, 0.4, 1, 1)


@query("tk07_diverse_documents", f"WITH RECURSIVE s AS (SELECT * FROM {TEXT_NT_SQL}), r AS (SELECT lang AS grp, doc_id AS k, substr(nt, 1, 64) || repeat('A', (n_chars % 30)::INT) AS seq, n_chars AS rank, false AS is_control FROM s JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)), " + _portfolio_sql("r", 40, 0.45, 0, 3))
def tk07_documents(spark, d):
    s = text_sequences(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    seq = F.concat(F.substr("nt", F.lit(1), F.lit(64)), F.repeat(F.lit("A"), (F.col("n_chars") % 30).cast("int")))
    return dv.portfolio(s.select(F.col("doc_id").alias("k"), seq.alias("seq"), F.col("lang").alias("grp"), F.col("n_chars").alias("rank"), F.lit(False).alias("is_control")), "k", "seq", "grp", 40, 0.45, 0, 3)


@query("wi02_round_robin", "WITH t AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT p_partkey, p_brand, rn::INT AS round FROM t ORDER BY rn, p_brand LIMIT 57")
def wi02(spark, d):
    return tk.round_robin(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 57).select("p_partkey", "p_brand", "round")


@query("tk04_hash_sample", "SELECT p_partkey, p_name FROM part ORDER BY sha256(p_partkey::VARCHAR) LIMIT 50")
def tk04(spark, d):
    return tk.hash_sample(table(spark, d, "part"), F.col("p_partkey").cast("string"), 50).select("p_partkey", "p_name")


@query("tk05_tiered", "WITH m AS (SELECT p_partkey, 'mandatory' AS tier FROM part WHERE p_size = 50), t AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size <> 50), r AS (SELECT p_partkey, row_number() OVER (ORDER BY rn, p_brand) AS place FROM t) SELECT p_partkey, tier FROM m UNION ALL SELECT p_partkey, 'round_robin' FROM r WHERE place <= 1500 - (SELECT count(*) FROM m)")
def tk05(spark, d):
    p = table(spark, d, "part").withColumn("must", F.col("p_size") == 50)
    return tk.tiered(p, "must", "p_brand", "p_retailprice", "p_partkey", 1500, strict=False).select("p_partkey", "tier")


@query("tk01_pareto", "WITH b AS (SELECT p_brand, p_partkey, p_size, p_retailprice, length(p_name) AS ln FROM part), f AS (SELECT *, NOT EXISTS (SELECT 1 FROM b o WHERE o.p_brand = b.p_brand AND o.p_size <= b.p_size AND o.p_retailprice <= b.p_retailprice AND o.ln <= b.ln AND (o.p_size < b.p_size OR o.p_retailprice < b.p_retailprice OR o.ln < b.ln)) AS on_frontier FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY on_frontier DESC, p_retailprice, p_size, ln, p_partkey) AS place FROM f) SELECT p_brand, p_partkey, on_frontier, place::INT AS place FROM r WHERE place <= 4")
def tk01(spark, d):
    p = table(spark, d, "part").withColumn("ln", F.length("p_name"))
    return sk.pareto(p, ["p_brand"], ["p_size", "p_retailprice", "ln"], [F.col("p_retailprice"), F.col("p_size"), F.col("ln"), F.col("p_partkey")], 4).select("p_brand", "p_partkey", "on_frontier", "place")


@query("tk01_frontier_of_orders", "WITH b AS (SELECT o_orderkey, o_orderstatus AS s, -round(o_totalprice / 1000) AS p, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS d, o_custkey % 211 AS c FROM orders) SELECT s, p, d, c, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.s = b.s AND o.p <= b.p AND o.d <= b.d AND o.c <= b.c AND (o.p < b.p OR o.d < b.d OR o.c < b.c)) GROUP BY ALL")
def tk01_orders(spark, d):
    """Three groups of all orders: the dearest, earliest, of the lowest customer class."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), (-F.round(F.col("o_totalprice") / 1000)).alias("p"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("d"), (F.col("o_custkey") % 211).alias("c"))
    best = sk.frontier(o, ["s"], ["p", "d", "c"])
    return o.join(best, ["s", "p", "d", "c"]).groupBy("s", "p", "d", "c").agg(F.count("*").alias("n"))


@query("jn01_full_outer", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS status FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 0) a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) b ON a.k = b.k")
def jn01(spark, d):
    a = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct()
    return jn.paired(a, b, "k")


@query("jn02_exact_cover", "WITH u AS (SELECT o_orderkey AS k, 'orders' AS t FROM orders UNION ALL SELECT l_orderkey, 'lines' FROM lineitem WHERE l_linenumber = 1) SELECT k, count(*) FILTER (t = 'orders')::BIGINT AS orders, count(*) FILTER (t = 'lines')::BIGINT AS lines, count(*) FILTER (t = 'orders') = 1 AND count(*) FILTER (t = 'lines') = 1 AS exact FROM u GROUP BY k")
def jn02(spark, d):
    return jn.exact_cover({"orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "lines": table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))}, "k")


@query("jn18_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.status, a.status) AS status FROM (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O') a FULL OUTER JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k")
def jn18(spark, d):
    base = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("status"))
    return jn.upsert(base, new, "k", ["status"])


@query("jn19_ordered_choices", "SELECT a.r_name AS k1, b.r_name AS k2, c.r_name AS k3 FROM region a, region b, region c WHERE a.r_name <> b.r_name AND a.r_name <> c.r_name AND b.r_name <> c.r_name")
def jn19(spark, d):
    return jn.ordered_choices(table(spark, d, "region"), "r_name", 3)


@query("jn08_close_points", "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND b.vec_id - a.vec_id > 2 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.3")
def jn08(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select("vec_id", *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return jn.close_points(p.withColumn("g", F.col("vec_id")), "vec_id", 0.3, None, "g", 2).select("a", "b")


@query("jn13_seed_and_extend", f"WITH {S}, k AS (SELECT doc_id, aa, a, substr(aa, a + 1, 8) AS seed FROM s, range(249) r(a)), h AS (SELECT q.doc_id AS q_id, q.a AS q_at, l.doc_id AS l_id, l.a AS l_at, substr(q.aa, q.a + 1) AS x, substr(l.aa, l.a + 1) AS y FROM k q JOIN k l ON q.seed = l.seed), e AS (SELECT q_id, q_at, l_id, l_at, coalesce(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))[1] - 1, least(length(x), length(y))) AS n FROM h), w AS (SELECT *, row_number() OVER (PARTITION BY q_id, q_at ORDER BY n DESC, l_id DESC, l_at DESC) AS rn FROM e) SELECT q_id, count(*) AS places, sum(n)::BIGINT AS letters, max(l_id) AS top FROM w WHERE rn = 1 GROUP BY q_id")
def jn13(spark, d):
    s = sequences(spark, d).select("doc_id", F.col("aa").alias("t"))
    best = jn.seed_and_extend(s, s, ("doc_id", "t"), ("doc_id", "t"))
    return best.groupBy("q_id").agg(F.count("*").alias("places"), F.sum("length").cast("long").alias("letters"), F.max("l_id").alias("top"))


# --- Metrics ----------------------------------------------------------------------------------------------------


@query("ag01_group_summary", "SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY 1")
def ag01(spark, d):
    return ag.mean_and_deviation(table(spark, d, "events"), ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("ag11_regression_metrics", "WITH t AS (SELECT l_returnflag AS g, l_quantity AS y, l_extendedprice / 2000 AS p FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rp FROM t) SELECT g, round(avg((y - p) * (y - p)), 6) AS mse, round(corr(ry, rp), 6) AS spearman, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS pearson FROM r GROUP BY g")
def ag11(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("p"))
    return ag.regression_metrics(t, "y", "p", ["g"]).select("g", *[F.round(c, 6).alias(c) for c in ("mse", "spearman", "r2", "pearson")])


@query("ag12_classification_metrics", "WITH t AS (SELECT quality AS l, (length(text) % 2)::INT AS p FROM labels JOIN documents USING (doc_id)), k AS (SELECT DISTINCT l AS k FROM t UNION SELECT DISTINCT p FROM t), m AS (SELECT k, (SELECT count(*) FROM t WHERE l = k AND p = k)::DOUBLE AS c, (SELECT count(*) FROM t WHERE l = k)::DOUBLE AS t, (SELECT count(*) FROM t WHERE p = k)::DOUBLE AS p FROM k), q AS (SELECT *, coalesce(c / nullif(p, 0), 0) AS pr, coalesce(c / nullif(t, 0), 0) AS re FROM m), z AS (SELECT sum(t) AS s, sum(c) AS c, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt, avg(pr) AS pr, avg(re) AS re, avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)) AS f1 FROM q) SELECT round(c / s, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round((c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) AS mcc FROM z")
def ag12(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.length("text") % 2).alias("p")), "doc_id")
    return ag.classification_metrics(t, "quality", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")])


@query("ag13_masked_accuracy", "SELECT round(avg(CASE WHEN doc_id % 4 <> 0 THEN (quality = toxic)::INT END), 8) AS accuracy FROM labels")
def ag13(spark, d):
    t = table(spark, d, "labels").withColumn("l", F.when(F.col("doc_id") % 4 == 0, -100).otherwise(F.col("quality")))
    return t.agg(F.round(ag.masked_accuracy("l", "toxic"), 8).alias("accuracy"))


@query("ag17_set_digest", "SELECT sha256(string_agg(j, ',' ORDER BY j)) AS digest, count(*) AS n FROM (SELECT DISTINCT concat('{\"n_name\":\"', n_name, '\",\"n_regionkey\":', n_regionkey, '}') AS j FROM nation)")
def ag17(spark, d):
    return ag.set_digest(table(spark, d, "nation"), ["n_name", "n_regionkey"])


@query("ag17_bucketed_digest", "WITH r AS (SELECT DISTINCT sha256(concat('{\"o_orderkey\":', o_orderkey, ',\"o_orderstatus\":\"', o_orderstatus, '\"}')) AS h FROM orders), b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1) SELECT sha256(string_agg(d, ',' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM b")
def ag17_bucketed(spark, d):
    return ag.bucketed_digest(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("ma03_geometry", "WITH p AS (SELECT label AS g, vec_id AS pos, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT g, avg(x) AS cx, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg, count(*) AS n, min(pos) AS p0, max(pos) AS p1 FROM p GROUP BY g) SELECT a.g, round(cx, 6) AS cx, round(rg, 6) AS radius_of_gyration, n, round(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2), 6) AS end_to_end FROM a JOIN p u ON u.pos = p0 JOIN p v ON v.pos = p1")
def ma03(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("pos"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return ag.geometry(p, ["g"]).select("g", F.round("cx", 6).alias("cx"), F.round("radius_of_gyration", 6).alias("radius_of_gyration"), "n", F.round("end_to_end", 6).alias("end_to_end"))


_XYZ = "p AS (SELECT label AS g, vec_id AS pos, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
#: Eigenvalues by the trigonometric formula, vectors by cross products of the rows of A - l I: no iteration.
_AXES = (
    "c AS (SELECT g, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p GROUP BY g), "
    "q AS (SELECT *, (xx + yy + zz) / 3 AS m, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS r FROM c), "
    "d AS (SELECT *, acos(greatest(-1, least(1, ((xx - m) * ((yy - m) * (zz - m) - yz * yz) - xy * (xy * (zz - m) - yz * xz) + xz * (xy * yz - (yy - m) * xz)) / (2 * r * r * r)))) / 3 AS phi FROM q), "
    "l AS (SELECT *, k, m + 2 * r * cos(phi + CASE k WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 2 END * pi() / 3) AS v FROM d, (VALUES (1), (2), (3)) t(k)), "
    "w AS (SELECT *, list_sort([[xy * yz - xz * (yy - v), xz * xy - (xx - v) * yz, (xx - v) * (yy - v) - xy * xy], [xy * (zz - v) - xz * yz, xz * xz - (xx - v) * (zz - v), (xx - v) * yz - xy * xz], [(yy - v) * (zz - v) - yz * yz, yz * xz - xy * (zz - v), xy * yz - (yy - v) * xz]]::DOUBLE[3][], 'ASC') AS a FROM l), "
    "b AS (SELECT g, k, v, cx, cy, cz, list_reduce(list_transform(a, lambda u: u::DOUBLE[]), lambda s, u: CASE WHEN s[1] * s[1] + s[2] * s[2] + s[3] * s[3] >= u[1] * u[1] + u[2] * u[2] + u[3] * u[3] THEN s ELSE u END) AS a FROM w), "
    "n AS (SELECT g, k, v, cx, cy, cz, list_transform(a, lambda t: t / sqrt(a[1] * a[1] + a[2] * a[2] + a[3] * a[3]) * CASE WHEN list_filter(a, lambda t: abs(t) = list_max(list_transform(a, lambda y: abs(y))))[1] < 0 THEN -1 ELSE 1 END) AS a FROM b), "
    "e AS (SELECT n.g, k, max(a[1] * (x - cx) + a[2] * (y - cy) + a[3] * (z - cz)) - min(a[1] * (x - cx) + a[2] * (y - cy) + a[3] * (z - cz)) AS extent FROM n JOIN p ON p.g = n.g GROUP BY 1, 2), "
    "s AS (SELECT g, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2, max(v) FILTER (k = 3) AS v3 FROM n GROUP BY g)"
)


@query("ma02_principal_axes", f"WITH {_XYZ}, {_AXES} SELECT n.g, n.k::INT AS k, round(v, 6) AS value, round(a[1], 4) AS ax, round(a[2], 4) AS ay, round(a[3], 4) AS az, round(extent, 4) AS extent FROM n JOIN e ON e.g = n.g AND e.k = n.k")
def ma02(spark, d):
    e = F.col("embedding")
    got = sp.principal_axes(table(spark, d, "embeddings").select(F.col("label").alias("g"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")]), ["g"])
    rows = got.select("g", F.posexplode(F.arrays_zip("values", "axes", "extents")).alias("k", "t"))
    return rows.select("g", (F.col("k") + 1).alias("k"), F.round("t.values", 6).alias("value"), *[F.round(F.col("t.axes")[i], 4).alias(f"a{c}") for i, c in enumerate("xyz")], F.round("t.extents", 4).alias("extent"))


@query("ma03_all_measures", f"WITH {_XYZ}, {_AXES}, j AS (SELECT a.g, b.pos - a.pos AS gap, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.g = b.g AND a.pos < b.pos), f AS (SELECT g, max(d) AS far, count(*) FILTER (gap > 2 AND d < 0.05) AS clashes FROM j GROUP BY g) SELECT s.g, round(coalesce(far, 0), 6) AS farthest, coalesce(clashes, 0)::BIGINT AS clashes, round(greatest(0, least(1, 1 - 3 * (v1 * v2 + v2 * v3 + v3 * v1) / (v1 + v2 + v3) ** 2)), 6) AS anisotropy, round(v1, 6) AS spread FROM s LEFT JOIN f ON f.g = s.g")
def ma03_all(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("pos"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return sp.geometry(p, "g", near=0.05).select("g", F.round("farthest", 6).alias("farthest"), "clashes", F.round("anisotropy", 6).alias("anisotropy"), F.round(F.col("values")[0], 6).alias("spread"))


@query("ma04_distance_rmsd", "WITH p AS (SELECT label AS g, vec_id AS pos, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS x2, embedding[5]::DOUBLE AS y2, embedding[6]::DOUBLE AS z2 FROM embeddings), d AS (SELECT a.g, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d1, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2 + (a.z2 - b.z2) ** 2) AS d2 FROM p a JOIN p b ON a.g = b.g AND a.pos < b.pos) SELECT g, round(sqrt(avg((d1 - d2) ** 2)), 6) AS rmsd FROM d GROUP BY g")
def ma04(spark, d):
    e = F.col("embedding")
    p = table(spark, d, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("pos"), *[e[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "z", "x2", "y2", "z2"))])
    return ag.distance_rmsd(p, ["g"]).select("g", F.round("rmsd", 6).alias("rmsd"))


@query("ma12_normalized_vectors", "SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE / sqrt(list_reduce(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE), lambda a, b: a + b)) * 100000)::BIGINT) AS unit FROM embeddings")
def ma12(spark, d):
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return table(spark, d, "embeddings").withColumn("norm", norm).select("vec_id", F.transform(e, lambda x: F.floor(x / F.col("norm") * 100000)).alias("unit"))


@query("se01_set_operations", "SELECT 'only_left' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def se01(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o).agg(F.lit("only_left").alias("side"), F.count("*").alias("n")).unionByName(c.intersect(o).agg(F.lit("both").alias("side"), F.count("*").alias("n")))


@query("it03_workflow_graph", "WITH RECURSIVE e AS (SELECT n_nationkey AS n, n_nationkey // 2 AS up FROM nation WHERE n_nationkey > 0), w AS (SELECT 0 AS n, 0 AS depth UNION ALL SELECT e.n, depth + 1 FROM e JOIN w ON e.up = w.n) SELECT n, depth FROM w")
def it03(spark, d):
    from ..operators.graph import depths

    edges = table(spark, d, "nation").where("n_nationkey > 0").select(F.floor(F.col("n_nationkey") / 2).cast("int").alias("src"), F.col("n_nationkey").alias("dst"))
    return depths(edges, 0).select(F.col("node").alias("n"), "depth")


_COVER = "f AS (SELECT p_partkey, p_retailprice, ['b' || p_brand, 't' || p_type, 's' || p_size] AS f FROM part)"


@query("it01_lane_rescue", f"WITH RECURSIVE {_COVER}, w AS (SELECT 0 AS place, NULL::BIGINT AS p_partkey, 0 AS gain, []::VARCHAR[] AS done UNION ALL SELECT w.place + 1, c.p_partkey, c.gain, list_concat(w.done, c.f) FROM w, LATERAL (SELECT p_partkey, f, len(list_filter(f, lambda x: NOT list_contains(w.done, x))) AS gain FROM f WHERE len(list_filter(f, lambda x: NOT list_contains(w.done, x))) > 0 ORDER BY gain DESC, p_retailprice, p_partkey LIMIT 1) c WHERE w.place < 30) SELECT p_partkey, place::INT AS place, gain::INT AS gain FROM w WHERE place > 0")
def it01(spark, d):
    from ..operators.graph import greedy_cover

    p = table(spark, d, "part").select("p_partkey", F.array(F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("t"), "p_type"), F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("features"), F.struct("p_retailprice", "p_partkey").alias("order"))
    return greedy_cover(p, "p_partkey", "features", "order", 30)

