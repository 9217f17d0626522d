"""Queries of design rounds: coding sequences, filters, deadlines, requirements, feedback, jobs, lineage, adapters, readers, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import INTERVALS_SQL, NT, SEQUENCES_SQL, derived, derived_sql, intervals, sequences
from ..functions import hashing as hs
from ..functions import sequence as fn
from ..functions.constants import RESIDUE_MASS, RESIDUES, WATER_MASS
from ..operators import adapters as ad
from ..operators import lineage as li
from ..operators import rules as ru
from ..operators import space as sp
from ..operators import topk as tk
from ..session import table
from ..streaming import readers as rd
from .evidence import shuffle_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


I = f"t AS (SELECT * FROM {INTERVALS_SQL})"
S = f"s AS (SELECT * FROM {SEQUENCES_SQL})"
STAGES = ["intake", "search", "structure", "assessment", "product", "routing", "ranking"]


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Coding sequences of 33 to 240 bases with annotated headers; a few records for each fault."""
    i = F.col("doc_id")
    part = lambda every, text: F.when(i % every == 0, text).otherwise("")
    header = F.concat(
        F.lit("x"), i.cast("string"), F.when(i % 13 == 0, " [gbkey=mRNA]").otherwise(" [gbkey=CDS]"), part(17, " [pseudo=true]"), part(19, " [partial=5']"), part(23, " [exception=ribosomal slippage]"), part(5, " [exception=annotated by transcript or proteomic data]"),
        part(29, " [transl_table=2]"), F.when(i % 31 == 0, "").otherwise(F.concat(F.lit(" [db_xref=GeneID:"), (i % 97).cast("string"), F.lit("]"))),
    )
    body = F.substr(F.translate(derived(i.cast("string"), NT), "T", "G"), F.lit(1), (3 * (10 + i % 70)).cast("int"))
    seq = F.when(i % 41 == 0, "").when(i % 43 == 0, "TAA").when(i % 7 == 0, F.concat(body, F.lit("N"))).when(i % 11 == 0, F.concat(body, F.lit("A"))).when(i % 37 == 0, F.concat(F.lit("ATGTGA"), body)).otherwise(F.concat(F.lit("ATG"), body, F.lit("TAA")))
    return table(spark, d, "documents").select("doc_id", header.alias("header"), seq.alias("sequence"))


_ANNOTATED = f"""b AS (SELECT doc_id AS i, substr(translate({derived_sql('CAST(doc_id AS VARCHAR)', NT)}, 'T', 'G'), 1, (3 * (10 + doc_id % 70))::INT) AS body FROM documents),
a AS (SELECT i, CASE WHEN i % 31 <> 0 THEN (i % 97)::VARCHAR END AS gene, CASE WHEN i % 41 = 0 THEN '' WHEN i % 43 = 0 THEN 'TAA' WHEN i % 7 = 0 THEN body || 'N' WHEN i % 11 = 0 THEN body || 'A' WHEN i % 37 = 0 THEN 'ATGTGA' || body ELSE 'ATG' || body || 'TAA' END AS q FROM b),
f AS (SELECT i, gene, q, CASE WHEN i % 13 = 0 THEN 'not_cds' WHEN i % 17 = 0 THEN 'pseudo' WHEN i % 19 = 0 THEN 'partial' WHEN i % 23 = 0 THEN 'translation_exception' WHEN i % 29 = 0 THEN 'nonstandard_translation_table' WHEN i % 31 = 0 THEN 'missing_gene_id'
  WHEN q = '' THEN 'empty_sequence' WHEN contains(q, 'N') THEN 'ambiguous_or_invalid_base' WHEN length(q) % 3 <> 0 THEN 'length_not_multiple_of_three' WHEN q = 'TAA' THEN 'no_sense_codons' WHEN starts_with(q, 'ATGTGA') THEN 'internal_stop' END AS reason FROM a)"""


@query("fi03_cds_faults", f"WITH {_ANNOTATED} SELECT i AS doc_id, reason FROM f")
def fi03(spark, d):
    return annotated(spark, d).select("doc_id", ru.cds_fault(F.col("header"), F.col("sequence")).alias("reason"))


@query("ag03_longest_valid_cds", f"WITH {_ANNOTATED}, r AS (SELECT gene, q, row_number() OVER (PARTITION BY gene ORDER BY length(q) DESC, q) AS n FROM f WHERE reason IS NULL) SELECT gene, q AS sequence FROM r WHERE n = 1")
def ag03(spark, d):
    return ru.longest_valid(annotated(spark, d))


@query("ag04_cds_selection", f"WITH {_ANNOTATED}, r AS (SELECT gene, q, row_number() OVER (PARTITION BY gene ORDER BY length(q) DESC, q) AS n FROM f WHERE reason IS NULL), c AS (SELECT reason, count(*) AS n FROM f GROUP BY 1) SELECT (SELECT sum(n) FROM c)::BIGINT AS records, (SELECT sum(n) FROM c WHERE reason IS NULL)::BIGINT AS accepted, (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM c WHERE reason IS NOT NULL) AS reasons, count(*) AS genes, count(DISTINCT q) AS distinct_sequences FROM r WHERE n = 1")
def ag04(spark, d):
    got = ru.cds_selection(annotated(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select("records", "accepted", text.alias("reasons"), "genes", "distinct_sequences")


@query("fi04_coding_constraints", f"WITH {_ANNOTATED}, g AS (SELECT i, q, (length(q) - length(translate(q, 'GC', '')))::DOUBLE / nullif(length(q), 0) AS gc FROM f WHERE q <> '') SELECT i AS doc_id, gc BETWEEN 0.55 AND 0.75 AND NOT contains(q, 'GGCC') AND NOT regexp_matches(q, 'A{{6}}|C{{6}}|G{{6}}|T{{6}}|N{{6}}') AS passes FROM g")
def fi04(spark, d):
    return annotated(spark, d).where("sequence <> ''").select("doc_id", ru.coding_constraints(F.col("sequence"), 0.55, 0.75, 5, ("GGCC",)).alias("passes"))


@query("fi06_allowed_intervals", f"WITH {I}, x AS (SELECT user_id, start1, end1 FROM t WHERE event_type = 'click'), k AS (SELECT * FROM t WHERE end1 <= 450 AND end1 - start1 + 1 >= 12) SELECT event_id FROM k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = k.user_id AND x.start1 <= k.end1 AND k.start1 <= x.end1)")
def fi06(spark, d):
    t = intervals(spark, d)
    return ru.allowed_intervals(t, "user_id", "event_id", F.lit(450), 12, t.where("event_type = 'click'").select("user_id", "start1", "end1")).select("event_id")


@query("fi07_length_and_duplicates", "WITH f AS (SELECT l_orderkey AS k, l_linenumber, l_shipdate::DATE::VARCHAR || repeat('x', l_linenumber) AS q FROM lineitem), g AS (SELECT k * 10 + l_linenumber AS id, q FROM f), h AS (SELECT id, q, length(q) <= 14 AS fits FROM g), w AS (SELECT fits, id > min(CASE WHEN fits THEN id END) OVER (PARTITION BY q) AS later FROM h) SELECT CASE WHEN NOT fits THEN 'length_filtered' WHEN later THEN 'duplicate_filtered' ELSE 'kept' END AS status, count(*) AS n FROM w GROUP BY 1")
def fi07(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.to_date("l_shipdate").cast("string"), F.repeat(F.lit("x"), F.col("l_linenumber"))).alias("q"))
    return ru.length_and_duplicates(rows, "id", "q", 14).groupBy("status").agg(F.count("*").alias("n"))


_RES = "r AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 10 END AS conservation, l_tax * 12 AS coverage, l_quantity > 25 AS exposed FROM lineitem)"


def _residues(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 10).alias("conservation"), (F.col("l_tax") * 12).alias("coverage"), (F.col("l_quantity") > 25).alias("exposed"))


@query("fi09_covered_conservation", f"WITH {_RES}, u AS (SELECT k, CASE WHEN conservation IS NOT NULL AND coverage >= 0.5 THEN conservation END AS v FROM r) SELECT k, round(count(v)::DOUBLE / count(*), 6) AS evaluated_fraction, round(avg(v), 6) AS mean_conservation, round(min(v), 6) AS least_conservation, CASE WHEN count(v) = 0 THEN 'not_evaluated' ELSE 'evaluated' END AS status FROM u GROUP BY k")
def fi09(spark, d):
    got = ru.covered_conservation(_residues(spark, d), "k", 0.5)
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("evaluated_fraction", "mean_conservation", "least_conservation")], "status")


@query("ag07_residue_rollup", f"WITH {_RES}, u AS (SELECT k, exposed, CASE WHEN conservation IS NOT NULL AND coverage >= 0.8 THEN conservation END AS v FROM r) SELECT k, round(avg(exposed::INT), 6) AS exposed_fraction, round(count(v)::DOUBLE / count(*), 6) AS evaluated_fraction, round(avg(v), 6) AS mean_conservation, round(min(v), 6) AS least_conservation, CASE WHEN count(v) = 0 THEN 'partial' ELSE 'evaluated' END AS status FROM u GROUP BY k")
def ag07(spark, d):
    got = ru.residue_rollup(_residues(spark, d), "k", 0.8)
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("exposed_fraction", "evaluated_fraction", "mean_conservation", "least_conservation")], "status")


_PLACES = "(VALUES ('intake', 1), ('search', 2), ('structure', 3), ('assessment', 4), ('product', 5), ('routing', 6), ('ranking', 7))"
_ACTIONS = "a AS (SELECT o_orderkey AS action, CASE o_orderkey % 8 WHEN 0 THEN 'intake' WHEN 1 THEN 'search' WHEN 2 THEN 'structure' WHEN 3 THEN 'assessment' WHEN 4 THEN 'product' WHEN 5 THEN 'routing' WHEN 6 THEN 'ranking' ELSE 'nowhere' END AS required, o_orderstatus = 'F' AS executes FROM orders)"


def _actions(spark, d):
    names = F.array(*map(F.lit, [*STAGES, "nowhere"]))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("action"), names[(F.col("o_orderkey") % 8).cast("int")].alias("required_stage"), (F.col("o_orderstatus") == "F").alias("executes"))


@query("fi10_due_actions", f"WITH {_ACTIONS}, p AS (SELECT * FROM {_PLACES} v(stage, pos)) SELECT action, coalesce(p.pos <= 3 OR required IN ('product', 'routing'), true) AS due FROM a LEFT JOIN p ON p.stage = a.required")
def fi10(spark, d):
    return _actions(spark, d).select("action", ru.due(F.col("required_stage"), F.lit("structure"), F.array(F.lit("product"), F.lit("routing")), STAGES).alias("due"))


@query("ag24_due_and_blocking", f"WITH {_ACTIONS}, p AS (SELECT * FROM {_PLACES} v(stage, pos)), j AS (SELECT t.stage, action, executes FROM a LEFT JOIN p ON p.stage = a.required JOIN p t ON coalesce(p.pos <= 2, true) OR a.required = t.stage) SELECT stage, count(*) AS n_due, count(*) FILTER (executes) AS n_blocking, min(action) AS first_due, min(action) FILTER (executes) AS first_blocking FROM j GROUP BY stage")
def ag24(spark, d):
    return ru.blocking_actions(_actions(spark, d), "search", STAGES)


@query("dq06_requirements", "SELECT o_orderkey AS requirement_id, 'missing' AS status, CASE o_orderkey % 4 WHEN 0 THEN 'blocking_now' WHEN 1 THEN 'design_variable' WHEN 2 THEN 'required_before_ranking' ELSE 'required_before_release' END AS requirement_class, CASE WHEN o_orderkey % 2 = 0 THEN 'search' ELSE 'ranking' END AS required_before_stage, o_orderkey % 4 <> 0 AS exploratory_progress_allowed FROM orders")
def dq06(spark, d):
    return ru.requirements(_requirements(spark, d), STAGES)


def _requirements(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("requirement_id"), F.array(*map(F.lit, ru.REQUIREMENT_CLASSES))[(k % 4).cast("int")].alias("requirement_class"), F.when(k % 2 == 0, "search").otherwise("ranking").alias("required_before_stage"))


@query("ag14_requirement_counts", "SELECT c AS requirement_class, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = k AND o_orderkey % 4 <> 2) AS n FROM (VALUES ('blocking_now', 0), ('design_variable', 1), ('required_before_ranking', 2), ('required_before_release', 3)) v(c, k)")
def ag14(spark, d):
    return ru.counted(_requirements(spark, d).where("requirement_id % 4 <> 2"), "requirement_class", ru.REQUIREMENT_CLASSES)


@query("ag20_ratios", "SELECT l_shipmode, count(*) FILTER (l_returnflag = 'R') AS numerator, count(*) AS denominator, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS ratio FROM (SELECT l_linestatus || l_linenumber AS l_shipmode, l_returnflag FROM lineitem) GROUP BY 1")
def ag20(spark, d):
    return ru.ratios(table(spark, d, "lineitem").select(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("l_shipmode"), "l_returnflag"), ["l_shipmode"], F.col("l_returnflag") == "R")


@query("ag21_feedback", "SELECT 'customers' AS origin_stage, 'c' || c_custkey AS request, c_acctbal AS weight, NULL::VARCHAR AS note FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'suppliers', 's' || s_suppkey, NULL, s_name FROM supplier")
def ag21(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("request"), F.col("c_acctbal").alias("weight"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("request"), F.col("s_name").alias("note"))
    return ru.feedback({"customers": c, "suppliers": s}, "request")


@query("ag23_composition", f"WITH {S} SELECT doc_id, {', '.join(f'(length(aa) - length(replace(aa, {chr(39)}{c}{chr(39)}, {chr(39) * 2})))::INT AS n_{c.lower()}' for c in RESIDUES)} FROM s")
def ag23(spark, d):
    counts = F.map_from_arrays(F.array(*map(F.lit, RESIDUES)), F.array(*[fn.count_of(F.col("aa"), c) for c in RESIDUES]))
    return sequences(spark, d).select("doc_id", counts.alias("m")).select("doc_id", *[F.col("m")[c].cast("int").alias(f"n_{c.lower()}") for c in RESIDUES])


@query("tk03_parent_orders", "WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS w, p_partkey % 2 AS slot FROM part), o AS (SELECT a.k AS first, b.k AS second, (a.w + b.w) / 2 AS mean FROM p a JOIN p b ON a.slot <> b.slot WHERE a.w >= 45 AND b.w >= 45) SELECT first, second, mean, sha256(first || '|' || second) AS digest FROM o ORDER BY mean DESC, digest LIMIT 12")
def tk03(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 2).alias("slot"))
    return ru.parent_orders(p, "slot", "k", "w", 12)


@query("tk06_mutable_positions", f"WITH {S}, q AS (SELECT doc_id, substr(aa, 1, (doc_id % 60)::INT) AS a FROM s), p AS (SELECT doc_id, a, i FROM q, range(1, 61) r(i) WHERE i <= length(a)) SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS positions FROM p WHERE (i <= 10 OR i > length(a) - 10) AND i NOT IN (3, 4) AND substr(a, i, 1) <> 'C' GROUP BY doc_id")
def tk06(spark, d):
    q = sequences(spark, d).select("doc_id", F.substr("aa", F.lit(1), (F.col("doc_id") % 60).cast("int")).alias("a"))
    at = ru.mutable_positions(F.col("a"), 10, F.array(F.lit(3), F.lit(4)))
    return q.select("doc_id", F.array_join(at.cast("array<string>"), ",").alias("positions")).where("positions <> ''")


@query("tk12_first_rows", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def tk12(spark, d):
    return table(spark, d, "events").select("event_id").orderBy("event_id").limit(100)


@query("jn09_pair_extremes", "WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity / 10 AS x, l_discount * 50 AS y, l_tax * 50 AS z FROM lineitem), j AS (SELECT a.k, b.i - a.i AS gap, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.k = b.k AND a.i < b.i) SELECT k, round(max(d), 6) AS farthest, count(*) FILTER (gap > 2 AND d < 2.0) AS clashes FROM j GROUP BY k")
def jn09(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 50).alias("y"), (F.col("l_tax") * 50).alias("z"))
    return sp.pair_extremes(p, "k", near=2.0).withColumn("farthest", F.round("farthest", 6))


@query("jn11_exact_segments", "WITH p AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_returnflag AS label FROM lineitem), g AS (SELECT *, pos - row_number() OVER (PARTITION BY k, label ORDER BY pos) AS run FROM p) SELECT k, min(pos) AS start1, max(pos) AS end1, label FROM g GROUP BY k, label, run")
def jn11(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("label"))
    return ru.exact_segments(p, li.select(F.col("l_orderkey").alias("k")).distinct(), "k").select("k", "start1", "end1", "label")


@query("jn17_follow_up", "SELECT c_custkey AS design, md5(c_name) AS identity, c_acctbal * 2 AS score FROM customer")
def jn17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("design"), F.md5(F.col("c_name").cast("binary")).alias("identity"), (F.col("c_acctbal") * 2).alias("score"))
    return ru.followed_up(c.select("design", "identity"), c, "design", "identity")


@query("jn22_concatenations", "WITH t AS (SELECT conv_id, turn, role || length(coalesce(text, '')) AS q FROM conversations), l AS (SELECT * FROM (VALUES ('--'), ('+')) v(linker)), j AS (SELECT conv_id, linker, CASE linker WHEN '+' THEN string_agg(q, '+' ORDER BY turn, q) ELSE string_agg(q, '--' ORDER BY turn, q) END AS sequence FROM t, l GROUP BY 1, 2) SELECT conv_id, linker, sequence FROM j WHERE length(sequence) <= 60")
def jn22(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.length(F.coalesce("text", F.lit(""))).cast("string")).alias("q"))
    return ru.concatenations(t, "conv_id", "turn", "q", ["--", "+"], 60)


@query("se03_candidate_union", "SELECT 'c' || c_custkey AS candidate, 'seed' AS origin, c_acctbal AS score, NULL::VARCHAR AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'generated', s_acctbal, 'c' || s_suppkey FROM supplier UNION ALL SELECT 'p' || p_partkey, 'imported', NULL, NULL FROM part")
def se03(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    seed = table(spark, d, "customer").select(name("c", "c_custkey").alias("candidate"), F.lit("seed").alias("origin"), F.col("c_acctbal").alias("score"))
    made = table(spark, d, "supplier").select(name("s", "s_suppkey").alias("candidate"), F.lit("generated").alias("origin"), F.col("s_acctbal").alias("score"), name("c", "s_suppkey").alias("parent"))
    imported = table(spark, d, "part").select(name("p", "p_partkey").alias("candidate"), F.lit("imported").alias("origin"))
    return seed.unionByName(made, allowMissingColumns=True).unionByName(imported, allowMissingColumns=True)


@query("se07_seed_parts", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'source_control' ELSE 'manual' END AS part, count(*) AS n FROM part GROUP BY 1")
def se07(spark, d):
    k = F.col("p_partkey")
    batch = table(spark, d, "part").select(k, F.when(k % 5 == 0, "source_control").otherwise("candidate").alias("kind"), F.when(k % 5 == 0, F.array(F.lit("source_segment"))).otherwise(F.array(F.lit("source_segment"), F.lit("linker"))).alias("components"))
    return ru.seeds(batch, "kind", "components").groupBy("part").agg(F.count("*").alias("n"))


@query("st05_reader_dispatch", "SELECT 'line-stride' AS reader, (event_id % 6)::INT AS part, count(*) AS lines FROM events GROUP BY 1, 2 UNION ALL SELECT 'file-shard', ((user_id % 3) * 2 + event_id % 2)::INT, count(*) FROM events GROUP BY 1, 2 UNION ALL (WITH l AS (SELECT user_id AS f, event_id AS i, octet_length(encode(props)) + 1 AS n FROM events), p AS (SELECT coalesce(sum(n) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(n) OVER (PARTITION BY f) AS t FROM l) SELECT 'byte-range', (((o + 1) * 6 - 1) // t)::INT, count(*) FROM p GROUP BY 1, 2)")
def st05(spark, d):
    e = table(spark, d, "events")
    out = None
    for reader in rd.READERS:
        one = rd.dealt(e, reader, "user_id", "event_id", "props", 3, 2).groupBy("part").agg(F.count("*").alias("lines")).select(F.lit(reader).alias("reader"), "part", "lines")
        out = one if out is None else out.unionByName(one)
    return out


@query("st03_tail_of_files", "WITH l AS (SELECT user_id AS f, event_id AS i, octet_length(encode(props)) + 1 AS n FROM events), p AS (SELECT f, i, coalesce(sum(n) OVER (PARTITION BY f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, sum(n) OVER (PARTITION BY f) AS t FROM l), k AS (SELECT f, i, row_number() OVER (PARTITION BY f ORDER BY i) - 1 AS line FROM p WHERE o >= floor(t * 0.4)) SELECT f AS user_id, i AS event_id, ((f % 3) * 2 + line % 2)::INT AS part FROM k")
def st03_tail(spark, d):
    return rd.file_shard_from(table(spark, d, "events").select("user_id", "event_id", "props"), "user_id", "event_id", "props", 3, 2, 0.4).select("user_id", "event_id", "part")


@query("tk09_ceil_share", "WITH n AS (SELECT event_id % 6 AS part, row_number() OVER (PARTITION BY event_id % 6 ORDER BY event_id) AS n, event_id FROM events) SELECT part, event_id FROM n WHERE n <= ceil(1000 / 6.0)")
def tk09(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 6).alias("part"), "event_id")
    return tk.capped(e, "part", "event_id", tk.ceil_share(1000, 6))


@query("st07_epochs", "WITH r AS (SELECT event_id, event_id % 4 AS part, e.epoch, row_number() OVER (PARTITION BY event_id % 4, e.epoch ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_id % 4, e.epoch) AS n FROM events, range(3) e(epoch)), " + shuffle_sql("r", "part, epoch", 32, "7 + part + epoch * 4", "s") + ", q AS (SELECT part, epoch, event_id, epoch * n + p - (CASE WHEN part < 2 THEN 26 ELSE 25 END) AS place FROM s) SELECT part, epoch, event_id, place FROM q WHERE place >= 0 AND place < 250")
def st07(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("part"), "event_id")
    return rd.epochs(e, "part", "event_id", 4, seed=7, buffer=32, skip=102, cap=1000, passes=3).select("part", "epoch", "event_id", "place")


@query("it02_lane_assignment", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'priority' WHEN p_brand IN ('Brand#13', 'Brand#22') THEN 'diversity_rescue' END AS lane, CASE WHEN p_size % 5 = 0 THEN 'structure_confidence_priority' WHEN p_brand IN ('Brand#13', 'Brand#22') THEN 'forced_control_rescue' END AS reason FROM part")
def it02(spark, d):
    band = F.when(F.col("p_size") % 5 == 0, "higher").otherwise("low")
    return ru.lanes(table(spark, d, "part"), band, ["higher"], F.col("p_brand").isin("Brand#13", "Brand#22")).select("p_partkey", "lane", "reason")


@query("ag09_eligible_lanes", "WITH l AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'priority' ELSE 'archive' END AS lane FROM part) SELECT v.lane, count(l.lane) AS n, CASE WHEN v.lane <> 'archive' THEN count(l.lane) ELSE 0 END AS drafting, CASE WHEN v.lane = 'priority' THEN count(l.lane) ELSE 0 END AS expensive FROM (VALUES ('priority'), ('diversity_rescue'), ('archive')) v(lane) LEFT JOIN l ON l.lane = v.lane GROUP BY 1")
def ag09(spark, d):
    laned = ru.lanes(table(spark, d, "part"), F.when(F.col("p_size") % 5 == 0, "higher").otherwise("low"), ["higher"], F.lit(False)).fillna("archive", ["lane"])
    return ru.lane_counts(laned, ["priority", "diversity_rescue"], ["priority"])


@query("it05_lineage_faults", "SELECT p_partkey AS key, CASE WHEN p_partkey % 50 = 7 THEN 'own_parent' ELSE 'unknown_parent' END AS fault FROM part WHERE p_partkey % 50 IN (7, 8) UNION ALL SELECT p_partkey, 'cycle' FROM part WHERE p_partkey % 50 IN (20, 21, 22) AND (p_partkey // 50) * 50 + 22 <= (SELECT max(p_partkey) FROM part)")
def it05(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k)
    # Parts are made from the one before, but for sources, a few faults and cycles of three.
    parent = F.when(k % 50 == 7, k).when(k % 50 == 8, -k).when(k % 50 == 20, k + 2).otherwise(k - 1)
    edges = p.where((k % 50 != 0) & (k % 50 != 9) & (k % 50 != 23)).select(k.alias("child"), parent.alias("parent"))
    nodes = p.select(k.alias("key"), ((k % 50 == 0) | (k % 50 == 9) | (k % 50 == 23)).alias("source"))
    return li.lineage_faults(edges, nodes)


@query("it05_long_lineage", "WITH c AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT k AS key, CASE WHEN i < 3 THEN 'cycle' ELSE 'built_on_cycle' END AS fault FROM c WHERE i < n // 2")
def it05_long(spark, d):
    """All orders as two lineages, each as long as half of them: one ends at a source, the other at a cycle of three."""
    from ..operators.windows import numbered

    o = numbered(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"], "i").withColumn("i", F.col("i") - 1)
    n = table(spark, d, "orders").agg(F.floor(F.count("*") / 2).alias("half"))
    o = o.join(F.broadcast(n))  # one row
    before = F.when(F.col("i") == 0, 2).otherwise(F.col("i") - 1)
    edges = o.where(F.col("i") != F.col("half")).select(F.col("k").alias("child"), before.alias("i")).join(o.select("i", F.col("k").alias("parent")), "i").select("child", "parent")
    return li.lineage_faults(edges, o.select(F.col("k").alias("key"), (F.col("i") == F.col("half")).alias("source")))


@query("hs03_candidate_ids", "SELECT doc_id, substr(sha256(concat('{\"lang\":', to_json(lang), ',\"source\":', to_json(source), '}')), 1, 16) AS candidate_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def hs03(spark, d):
    digest = hs.canonical_sha256(lang=F.col("lang"), source=F.col("source"))
    return table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", F.substr(digest, F.lit(1), F.lit(16)).alias("candidate_id"))


@query("fn24_model_names", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN 'Legacy-' ELSE '' END || p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '^legacy-', '') AS model FROM part")
def fn24(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Legacy-").otherwise(""), "p_type", F.lit(" "), "p_brand")
    return table(spark, d, "part").select("p_partkey", fn.model_name(name).alias("model"))


@query("ma01_centroids", "WITH c AS (SELECT l_orderkey AS k, avg(l_quantity) AS cx, avg(l_discount) AS cy, avg(l_tax) AS cz FROM lineitem GROUP BY 1) SELECT k, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(max(sqrt((l_quantity - cx) ** 2 + (l_discount - cy) ** 2 + (l_tax - cz) ** 2)), 6) AS farthest FROM c JOIN lineitem ON k = l_orderkey GROUP BY ALL")
def ma01(spark, d):
    from ..operators.aggregates import distances_to_centroid

    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    got = distances_to_centroid(p, "k").groupBy("k", "cx", "cy", "cz").agg(F.max("distance").alias("farthest"))
    return got.select("k", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "farthest")])


_COUNT = lambda c, of="aa": f"(length({of}) - length(translate({of}, '{c}', '')))"
_METRICS = f"""v AS (SELECT doc_id, substr(aa, 1, (doc_id % 200)::INT) AS aa, substr(nt, 1, (doc_id % 250)::INT) AS nt FROM {SEQUENCES_SQL}),
c AS (SELECT v.doc_id, i, substr(aa, i, 1) AS c FROM v, range(1, 201) r(i) WHERE i <= length(aa)), h AS (SELECT doc_id, abs(round(sum(n * 1.0::DOUBLE / t * log2(n * 1.0::DOUBLE / t)), 6)) AS bits FROM (SELECT doc_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM c GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, c, k, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS k FROM c) GROUP BY 1, 2, 3) GROUP BY 1),
d AS (SELECT v.doc_id, i, substr(nt, i, 1) AS c FROM v, range(1, 251) r(i) WHERE i <= length(nt)), e AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, c, k, count(*) AS n FROM (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS k FROM d) GROUP BY 1, 2, 3) GROUP BY 1),
p AS (SELECT doc_id, {', '.join(f'coalesce(count(*) FILTER (c IN ({chr(39)}G{chr(39)}, {chr(39)}C{chr(39)}) AND i % 3 = {k % 3})::DOUBLE / nullif(count(*) FILTER (i % 3 = {k % 3}), 0), 0) AS gc{k}' for k in (1, 2, 3))} FROM d GROUP BY 1)"""


@query("fn13_all_metrics", f"WITH {_METRICS} SELECT v.doc_id, length(aa)::INT AS aa_length, length(nt)::INT AS cds_length, (length(nt) // 3)::INT AS codons, CASE WHEN length(nt) >= 3 THEN substr(nt, 1, 3) ELSE '' END AS start_codon, round(CASE WHEN aa = '' THEN 0 ELSE {' + '.join(f'{_COUNT(c)} * {RESIDUE_MASS[c]}::DOUBLE' for c in RESIDUES)} + {WATER_MASS} END, 4) AS mass, coalesce({_COUNT('AFILMVWY')}::DOUBLE / nullif(length(aa), 0), 0) AS hydrophobic, coalesce({_COUNT('DEHKR')}::DOUBLE / nullif(length(aa), 0), 0) AS charged, {_COUNT('C')}::INT AS cysteines, {_COUNT('P')}::INT AS prolines, coalesce(h.bits, 0) AS entropy, coalesce(g.run, 0)::INT AS aa_run, coalesce({_COUNT('GC', 'nt')}::DOUBLE / nullif(length(nt), 0), 0) AS gc, coalesce(gc1, 0) AS gc1, coalesce(gc2, 0) AS gc2, coalesce(gc3, 0) AS gc3, coalesce(e.run, 0)::INT AS nt_run FROM v LEFT JOIN h ON h.doc_id = v.doc_id LEFT JOIN g ON g.doc_id = v.doc_id LEFT JOIN e ON e.doc_id = v.doc_id LEFT JOIN p ON p.doc_id = v.doc_id")
def fn13(spark, d):
    aa, nt = F.col("aa"), F.col("nt")
    v = sequences(spark, d).select("doc_id", F.substr("aa", F.lit(1), (F.col("doc_id") % 200).cast("int")).alias("aa"), F.substr("nt", F.lit(1), (F.col("doc_id") % 250).cast("int")).alias("nt"))
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return v.select(
        "doc_id", F.length(aa).alias("aa_length"), F.length(nt).alias("cds_length"), F.floor(F.length(nt) / 3).cast("int").alias("codons"), F.when(F.length(nt) >= 3, F.substr(nt, F.lit(1), F.lit(3))).otherwise("").alias("start_codon"),
        F.round(F.when(aa == "", 0.0).otherwise(fn.mass(aa)), 4).alias("mass"), part(fn.fraction(aa, "AFILMVWY")).alias("hydrophobic"), part(fn.fraction(aa, "DEHKR")).alias("charged"), fn.count_of(aa, "C").cast("int").alias("cysteines"), fn.count_of(aa, "P").cast("int").alias("prolines"),
        F.round(part(fn.entropy(aa, RESIDUES)), 6).alias("entropy"), F.coalesce(fn.longest_homopolymer(aa), F.lit(0)).cast("int").alias("aa_run"), part(fn.fraction(nt, "GC")).alias("gc"), *[part(fn.gc_at(nt, k)).alias(f"gc{k}") for k in (1, 2, 3)], F.coalesce(fn.longest_homopolymer(nt), F.lit(0)).cast("int").alias("nt_run"),
    )


@query("dq05_input_audit", "WITH f AS (SELECT c_custkey, r FROM (SELECT c_custkey, unnest([CASE WHEN c_acctbal < 0 THEN 'positive_balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'known_segment' END]) AS r FROM customer) WHERE r IS NOT NULL) SELECT c_custkey, r AS requirement, 'action-' || substr(sha256(c_custkey || r), 1, 12) AS action FROM f")
def dq05(spark, d):
    got = ru.input_audit(table(spark, d, "customer"), "c_custkey", {"positive_balance": F.col("c_acctbal") >= 0, "known_segment": F.col("c_mktsegment") != "BUILDING"})
    return got.select("c_custkey", "requirement", F.concat(F.lit("action-"), F.substr(hs.sha256(F.concat(F.col("c_custkey").cast("string"), "requirement")), F.lit(1), F.lit(12))).alias("action"))


@query("dq10_job_records", f"WITH q AS (SELECT doc_id AS i, substr(CASE WHEN doc_id % 9 = 0 THEN '*' ELSE '' END || aa, 1, (doc_id % 240)::INT) AS a FROM {SEQUENCES_SQL}) SELECT i AS candidate_id, length(a)::INT AS length, CASE WHEN a = '' THEN 'empty' WHEN contains(a, '*') THEN 'not_canonical' WHEN length(a) > 200 THEN 'too_long' WHEN i % 11 = 0 THEN 'hash_differs' END AS reason FROM q")
def dq10(spark, d):
    i = F.col("doc_id")
    q = sequences(spark, d).select(i.alias("candidate_id"), F.substr(F.concat(F.when(i % 9 == 0, "*").otherwise(""), "aa"), F.lit(1), (i % 240).cast("int")).alias("sequence"))
    return ru.job_records(q.withColumn("sequence_sha256", F.when(F.col("candidate_id") % 11 == 0, "other").otherwise(hs.sha256(F.col("sequence")))), 200)


def _adapters(name: str, adapters: list[str]) -> None:
    """A query for a family of evidence adapters: events stand for evidence rows, their types for adapters."""
    values = ", ".join(f"('{a}')" for a in adapters)
    sql = f"""WITH {I}, e AS (SELECT user_id AS k, list_extract({adapters!r}, (event_id % {len(adapters) + 1})::INT + 1) AS adapter, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'risk' ELSE 'context' END AS status, start1, end1 FROM t),
m AS (SELECT k, adapter, status, start1, end1 FROM e WHERE adapter IS NOT NULL), p AS (SELECT DISTINCT k, adapter, unnest(range(start1, end1 + 1)) AS pos FROM m), z AS (SELECT k, adapter, count(*) AS residues FROM p GROUP BY 1, 2),
n AS (SELECT k, adapter, count(*) AS n, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'risk') AS risk FROM m GROUP BY 1, 2)
SELECT c_custkey AS k, a.adapter, coalesce(n.n, 0) AS n, coalesce(supported, 0) AS supported, coalesce(risk, 0) AS risk, coalesce(residues, 0) AS residues, CASE WHEN n.n > 0 THEN 'evaluated' ELSE 'not_evaluated' END AS state FROM customer CROSS JOIN (VALUES {values}) a(adapter) LEFT JOIN n ON n.k = c_custkey AND n.adapter = a.adapter LEFT JOIN z ON z.k = c_custkey AND z.adapter = a.adapter"""

    @query(name, sql)
    def run(spark, d):
        i = F.col("event_id")
        which = F.get(F.array(*map(F.lit, adapters)), (i % (len(adapters) + 1)).cast("int"))
        status = F.when(i % 3 == 0, "supported").when(i % 3 == 1, "risk").otherwise("context")
        e = intervals(spark, d).select(F.col("user_id").alias("k"), which.alias("adapter"), status.alias("status"), "start1", "end1")
        return ru.adapter_summary(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", e, adapters)


_adapters("ud02_residue_adapters", ["mhc_binding", "host_similarity", "epitope_support"])
_adapters("ud03_developability_adapters", ["signal_peptide", "transmembrane_topology", "disorder", "solubility", "aggregation"])
_adapters("ud04_product_adapters", ["structure_recheck", "expression_support", "rna_structure", "evo2_sequence_score"])


def _observations(spark, d):
    """Events as observations of three adapters about customers, some of them faulty; and customers as candidates."""
    i, k = F.col("event_id"), F.col("user_id")
    which = F.get(F.array(*map(F.lit, ("mhc_binding", "epitope_support", "disorder"))), (i % 3).cast("int"))
    status = F.when(i % 29 == 0, "maybe").otherwise(F.get(F.array(*map(F.lit, ad.STATUSES)), (i % 4).cast("int")))
    sha = hs.sha256(F.when(i % 31 == 0, F.lit("other")).otherwise(k.cast("string")))
    obs = intervals(spark, d).select(which.alias("adapter"), F.when(i % 37 != 0, F.concat(F.lit("e"), i.cast("string"))).alias("evidence_id"), F.when(i % 41 == 0, -k).otherwise(k).alias("candidate_id"), sha.alias("sequence_sha256"), F.col("start1"), F.col("end1"), status.alias("status"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), hs.sha256(F.col("c_custkey").cast("string")).alias("sequence_sha256"), F.lit(450).alias("length"))
    return obs, c


_OBS = f"WITH {I}, o AS (SELECT CASE event_id % 3 WHEN 0 THEN 'mhc_binding' WHEN 1 THEN 'epitope_support' ELSE 'disorder' END AS adapter, event_id, CASE WHEN event_id % 37 <> 0 THEN 'e' || event_id END AS evidence_id, CASE WHEN event_id % 41 = 0 THEN -user_id ELSE user_id END AS candidate_id, event_id % 31 = 0 AS other, start1, end1, CASE WHEN event_id % 29 = 0 THEN 'maybe' ELSE (['supported', 'risk', 'context', 'not_supported'])[event_id % 4 + 1] END AS status FROM t)"


@query("ud02_observation_faults", _OBS + " SELECT adapter, evidence_id, candidate_id, CASE WHEN candidate_id NOT IN (SELECT c_custkey FROM customer) THEN 'unknown_candidate' WHEN other THEN 'sequence_hash' WHEN end1 > 450 THEN 'residue_range' WHEN status = 'maybe' THEN 'status' ELSE 'evidence_id' END AS fault FROM o WHERE candidate_id NOT IN (SELECT c_custkey FROM customer) OR other OR end1 > 450 OR status = 'maybe' OR evidence_id IS NULL")
def ud02_faults(spark, d):
    return ad.observation_faults(*_observations(spark, d))


@query("ud02_candidate_states", _OBS + ", n AS (SELECT candidate_id, adapter, count(*) AS n, count(*) FILTER (status = 'risk') AS r FROM o WHERE adapter <> 'disorder' GROUP BY 1, 2) SELECT c_custkey AS candidate_id, coalesce(sum(n), 0)::BIGINT AS observations, coalesce(sum(r), 0)::BIGINT AS risks, 2::BIGINT AS evaluated, 3::BIGINT AS categories, 'partial' AS status FROM customer LEFT JOIN n ON candidate_id = c_custkey GROUP BY 1")
def ud02_states(spark, d):
    """The immune adapters of all customers: two provided, one not."""
    obs, c = _observations(spark, d)
    declared = spark.createDataFrame([("mhc_binding", "provided", True), ("epitope_support", "provided", True), ("host_similarity", "not_configured", False)], "adapter string, status string, has_result boolean")
    summary = ad.summaries(c, ad.states(declared, obs, "immune"), obs)
    counts = summary.groupBy("candidate_id").agg(F.sum("observation_count").alias("observations"), F.sum("risk_count").alias("risks"))
    return counts.join(ad.candidate_states(summary), "candidate_id")


@query("ud03_requirements", _OBS + ", p AS (SELECT DISTINCT adapter FROM o) SELECT requirement_id, requirement_class, required_before_stage FROM (VALUES ('signal_peptide', 'provide-signal-peptide-prediction', 'design_variable', 'experiment_release'), ('transmembrane_topology', 'provide-transmembrane-topology-prediction', 'design_variable', 'experiment_release'), ('disorder', 'provide-disorder-prediction', 'required_before_ranking', 'integrated_ranking'), ('solubility', 'provide-solubility-prediction', 'required_before_release', 'experiment_release'), ('aggregation', 'provide-aggregation-prediction', 'required_before_release', 'experiment_release')) v(a, requirement_id, requirement_class, required_before_stage) WHERE a NOT IN (SELECT adapter FROM p)")
def ud03_requirements(spark, d):
    """Which developability adapters the observations leave open."""
    obs, _ = _observations(spark, d)
    declared = obs.select("adapter").distinct().select("adapter", F.lit("provided").alias("status"), F.lit(True).alias("has_result"))
    return ad.requirements(ad.states(declared, obs, "developability"), "developability")
