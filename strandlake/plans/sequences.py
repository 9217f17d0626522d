"""Queries over derived sequences: normalization, reading frames, codon text, composition, codon choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SEQUENCES_SQL, sequences
from ..functions import sequence as fn
from ..functions.constants import CODONS, HYDROPATHY, RESIDUE_MASS, RESIDUES, SENSE, WATER_MASS

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
#: A reading frame row for each codon, islands of codons up to a stop, and the longest frame of each sequence.
ORF_SQL = S + """
, c AS (SELECT doc_id, nt, f, i, substr(nt, f + 1 + 3 * i, 3) AS cod FROM s, range(3) r(f), range(90) q(i) WHERE f + 3 * i + 3 <= length(nt))
, k AS (SELECT *, cod IN ('TAA', 'TAG', 'TGA') AS stop FROM c)
, w AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM k)
, g AS (SELECT doc_id, f, min(i) FILTER (cod = 'ATG') AS a, max(i) FILTER (stop) AS z FROM w GROUP BY doc_id, f, isl)
, o AS (SELECT doc_id, f + 3 * a AS start0, f + 3 * z + 3 AS end0x, row_number() OVER (PARTITION BY doc_id ORDER BY z - a DESC, f + 3 * a) AS rn FROM g WHERE a < z)
, orf AS (SELECT s.*, o.start0, o.end0x FROM s LEFT JOIN o ON s.doc_id = o.doc_id AND rn = 1)
"""
_CHUNKS = "list_transform(range(0, {n}, 3), lambda i: substr({s}, i + 1, 3))"
_CHARS = "list_transform(range(length({s})), lambda i: substr({s}, i + 1, 1))"
CODE_SQL = "code AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in CODONS.items()) + ") v(cod, aa))"
ENC_SQL = (
    "CASE WHEN start0 IS NULL THEN array_to_string(" + _CHARS.format(s="nt") + ", ' ') ELSE array_to_string(list_concat(list_concat("
    "list_transform(range(start0), lambda i: substr(nt, i + 1, 1)), list_transform(range(start0, end0x, 3), lambda i: substr(nt, i + 1, 3))), list_transform(range(end0x, length(nt)), lambda i: substr(nt, i + 1, 1))), ' ') END"
)


def _orf(spark, d):
    return sequences(spark, d).withColumn("orf", fn.longest_orf(F.col("nt")))


@query("fn01_normalize", "SELECT doc_id, translate(upper(trim(regexp_replace(concat(chr(10), ' ', lower(replace(nt, 'T', 'U')), chr(9)), '^\\s+|\\s+$', '', 'g'))), 'U', 'T') AS seq FROM " + SEQUENCES_SQL)
def fn01(spark, d):
    raw = F.concat(F.lit("\n "), F.lower(F.replace("nt", F.lit("T"), F.lit("U"))), F.lit("\t"))
    return sequences(spark, d).select("doc_id", fn.normalize(raw).alias("seq"))


@query("fn02_normalize_nucleotides", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE nt END AS seq FROM " + SEQUENCES_SQL)
def fn02(spark, d):
    raw = F.concat(F.lit(" ["), F.lower("nt"), F.lit("]\n"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))
    return sequences(spark, d).select("doc_id", fn.normalize_nucleotides(raw).alias("seq"))


@query("fn03_amino_acids", "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN concat(substr(aa, 1, 20), '*', substr(aa, 21)) ELSE aa END AS seq, (CASE WHEN doc_id % 3 = 0 THEN 'terminal_stop_removed' WHEN doc_id % 3 = 1 THEN 'internal_stop' ELSE '' END) AS codes FROM " + SEQUENCES_SQL)
def fn03(spark, d):
    m = F.col("doc_id") % 3
    head, tail = F.substr("aa", F.lit(1), F.lit(20)), F.substr("aa", F.lit(21))
    got = fn.amino_acids(F.concat(head, F.when(m == 1, "*").otherwise(" "), tail, F.when(m == 0, "*").otherwise("")))
    return sequences(spark, d).select("doc_id", got.alias("g")).select("doc_id", "g.sequence", F.array_join(F.col("g.issues.code"), ",").alias("codes")).withColumnRenamed("sequence", "seq")


@query("fn04_nucleotides", "SELECT doc_id, nt AS seq, CASE WHEN contains(nt, 'T') THEN 'rna_converted' ELSE '' END AS codes FROM " + SEQUENCES_SQL)
def fn04(spark, d):
    got = fn.nucleotides(F.replace("nt", F.lit("T"), F.lit("u")))
    return sequences(spark, d).select("doc_id", got.alias("g")).select("doc_id", F.col("g.sequence").alias("seq"), F.array_join(F.col("g.issues.code"), ",").alias("codes"))


@query("fn05_longest_orf", f"WITH {ORF_SQL} SELECT doc_id, start0::INT AS start0, end0x::INT AS end0x FROM orf")
def fn05(spark, d):
    return _orf(spark, d).select("doc_id", "orf.start0", "orf.end0x")


@query("fn06_encode", f"WITH {ORF_SQL} SELECT doc_id, {ENC_SQL} AS tokens FROM orf")
def fn06(spark, d):
    return _orf(spark, d).select("doc_id", fn.encode(F.col("nt"), F.col("orf")).alias("tokens"))


@query("corpus_summary", f"WITH {ORF_SQL} SELECT lang, count(*) AS n, count(start0) AS with_cds, sum(coalesce((end0x - start0) // 3, 0))::BIGINT AS codons, sum(len(string_split({ENC_SQL}, ' ')))::BIGINT AS tokens, sum(length(nt) - length(translate(nt, 'GC', '')))::BIGINT AS gc FROM orf GROUP BY lang")
def corpus_summary(spark, d):
    s = _orf(spark, d).withColumn("tokens", F.size(F.split(fn.encode(F.col("nt"), F.col("orf")), " ")))
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.count("orf").alias("with_cds"), F.sum(F.coalesce(((F.col("orf.end0x") - F.col("orf.start0")) / 3).cast("long"), F.lit(0).cast("long"))).alias("codons"), F.sum("tokens").cast("long").alias("tokens"), F.sum(fn.count_of(F.col("nt"), "GC")).cast("long").alias("gc"))


@query("fn07_split_codons", "SELECT doc_id, array_to_string(list_transform(range(0, length(x), 3), lambda i: substr(x, i + 1, 3)), ' ') AS tokens FROM (SELECT doc_id, concat(nt, repeat('A', (doc_id % 5)::INT)) AS x FROM " + SEQUENCES_SQL + ")")
def fn07(spark, d):
    return sequences(spark, d).select("doc_id", fn.split_codons(F.concat("nt", F.repeat(F.lit("A"), (F.col("doc_id") % 5).cast("int")))).alias("tokens"))


@query("fn07_split_marked", "SELECT doc_id, array_to_string(list_concat(list_concat(list_transform(range(5), lambda i: substr(nt, i + 1, 1)), list_transform(range(5, 245, 3), lambda i: substr(nt, i + 1, 3))), list_transform(range(245, 256), lambda i: substr(nt, i + 1, 1))), ' ') AS tokens FROM " + SEQUENCES_SQL)
def fn07b(spark, d):
    cut = lambda a, n: F.substr("nt", F.lit(a), F.lit(n))
    return sequences(spark, d).select("doc_id", fn.split_marked(F.concat(cut(1, 5), F.lit("["), cut(6, 240), F.lit("]"), cut(246, 11))).alias("tokens"))


@query("fn08_translate_cds", f"WITH {ORF_SQL}, {CODE_SQL}, t AS (SELECT doc_id, start0, substr(nt, start0 + 1, end0x - start0) AS cds FROM orf WHERE start0 IS NOT NULL), x AS (SELECT doc_id, i, substr(cds, 3 * i + 1, 3) AS cod FROM t, range(90) r(i) WHERE 3 * i + 3 <= length(cds)) SELECT doc_id, string_agg(aa, '' ORDER BY i) FILTER (aa <> '*') AS protein FROM x JOIN code USING (cod) GROUP BY doc_id")
def fn08(spark, d):
    s = _orf(spark, d).where("orf is not null")
    cds = F.substr("nt", F.col("orf.start0") + 1, F.col("orf.end0x") - F.col("orf.start0"))
    return s.select("doc_id", fn.translate_cds(cds)["protein"].alias("protein"))


@query("fn08_translation_issues", f"WITH {S}, x AS (SELECT doc_id, concat(nt, repeat('A', (doc_id % 3)::INT)) AS cds FROM s) SELECT (length(cds) % 3 <> 0) AS bad_frame, count(*) AS n, sum((NOT starts_with(cds, 'ATG') AND length(cds) % 3 = 0)::INT)::BIGINT AS non_atg FROM x GROUP BY 1")
def fn08b(spark, d):
    got = sequences(spark, d).select(fn.translate_cds(F.concat("nt", F.repeat(F.lit("A"), (F.col("doc_id") % 3).cast("int"))))["issues"]["code"].alias("c"))
    return got.groupBy(F.array_contains("c", "frame").alias("bad_frame")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("c", "non_atg_start")).alias("non_atg"))


@query("fn09_first_mismatch", f"WITH {S}, p AS (SELECT doc_id, nt AS a, concat(substr(nt, 1, 3 + (doc_id % 200)::INT), aa) AS b FROM s) SELECT doc_id, coalesce(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1], CASE WHEN length(a) <> length(b) THEN least(length(a), length(b)) + 1 END)::INT AS at1 FROM p")
def fn09(spark, d):
    b = F.concat(F.substr("nt", F.lit(1), (3 + F.col("doc_id") % 200).cast("int")), F.col("aa"))
    return sequences(spark, d).select("doc_id", fn.first_mismatch(F.col("nt"), b).cast("int").alias("at1"))


_GC = "(length({x}) - length(translate({x}, 'GC', '')))::DOUBLE / nullif(length({x}), 0)"


@query("fn10_gc", f"WITH {S}, p AS (SELECT doc_id, nt, " + ", ".join(f"array_to_string(list_transform(range({k}, 256, 3), lambda i: substr(nt, i + 1, 1)), '') AS b{k + 1}" for k in range(3)) + " FROM s) SELECT doc_id, " + _GC.format(x="nt") + " AS gc, " + ", ".join(_GC.format(x=f"b{k}") + f" AS gc{k}" for k in (1, 2, 3)) + " FROM p")
def fn10(spark, d):
    return sequences(spark, d).select("doc_id", fn.fraction(F.col("nt"), "GC").alias("gc"), *[fn.gc_at(F.col("nt"), k).alias(f"gc{k}") for k in (1, 2, 3)])


_RUNS = "r AS (SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM (SELECT doc_id, i, substr({col}, i, 1) AS c FROM s, range(1, 257) q(i)))"


@query("fn11_longest_homopolymer", f"WITH {S}, {_RUNS.format(col='nt')} SELECT doc_id, max(n)::INT AS longest FROM (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, c, g) GROUP BY doc_id")
def fn11(spark, d):
    return sequences(spark, d).select("doc_id", fn.longest_homopolymer(F.col("nt")).alias("longest"))


@query("fn12_entropy", f"WITH {S}, c AS (SELECT doc_id, substr(aa, i, 1) AS c, count(*) AS n FROM s, range(1, 257) q(i) GROUP BY 1, 2) SELECT doc_id, round(-sum(n / 256.0 * log2(n / 256.0)), 6) AS bits FROM c GROUP BY doc_id")
def fn12(spark, d):
    return sequences(spark, d).select("doc_id", F.round(fn.entropy(F.col("aa"), RESIDUES), 6).alias("bits"))


_SUM = lambda scale: "(" + " + ".join(f"(length(aa) - length(replace(aa, '{c}', ''))) * {scale[c]}::DOUBLE" for c in sorted(scale)) + ")"


@query("fn13_metrics", f"WITH {S} SELECT doc_id, length(aa)::INT AS n, round({_SUM(RESIDUE_MASS)} + {WATER_MASS}, 3) AS mass, round({_SUM(HYDROPATHY)} / length(aa), 9) AS gravy, round((length(aa) - length(translate(aa, 'KR', ''))) + 0.1::DOUBLE * (length(aa) - length(translate(aa, 'H', ''))) - (length(aa) - length(translate(aa, 'DE', ''))), 3) AS charge, ((length(aa) - length(replace(aa, 'C', ''))) % 2)::INT AS cys_parity FROM s")
def fn13(spark, d):
    aa = F.col("aa")
    return sequences(spark, d).select("doc_id", F.length(aa).alias("n"), F.round(fn.mass(aa), 3).alias("mass"), F.round(fn.gravy(aa), 9).alias("gravy"), F.round(fn.charge_proxy(aa), 3).alias("charge"), (fn.count_of(aa, "C") % 2).cast("int").alias("cys_parity"))


@query("fn14_homopolymer_regions", f"WITH {S}, {_RUNS.format(col='aa')} SELECT doc_id, min(i)::INT AS start1, max(i)::INT AS end1, c AS residue FROM r GROUP BY doc_id, c, g HAVING count(*) >= 3")
def fn14(spark, d):
    from ..operators.windows import label_runs

    rows = sequences(spark, d).select("doc_id", F.posexplode(fn.letters(F.col("aa"))).alias("i", "residue")).withColumn("pos", F.col("i") + 1)
    return label_runs(rows, ["doc_id"], "pos", "residue").where("end1 - start1 + 1 >= 3").select("doc_id", "start1", "end1", "residue")


@query("fn15_motifs", f"WITH {S} SELECT doc_id, i::INT AS start1 FROM s, range(1, 255) q(i) WHERE substr(aa, i, 1) = 'N' AND substr(aa, i + 1, 1) <> 'P' AND substr(aa, i + 2, 1) IN ('S', 'T')")
def fn15(spark, d):
    return sequences(spark, d).select("doc_id", F.explode(fn.motif_starts(F.col("aa"))).alias("start1"))


_KD = "CASE c " + " ".join(f"WHEN '{a}' THEN {round(v * 10)}" for a, v in HYDROPATHY.items()) + " END"
_TENTHS = {a: round(v * 10) for a, v in HYDROPATHY.items()}


@query("fn17_liability", f"WITH {S}, p AS (SELECT doc_id, i, substr(aa, i, 1) AS c FROM s, range(1, 257) q(i)), w AS (SELECT doc_id, i, sum({_KD}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS t FROM p), {_RUNS.format(col='aa')}, h AS (SELECT doc_id, max(n) AS h FROM (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, c, g) GROUP BY doc_id), n AS (SELECT doc_id, sum((i >= 19 AND t >= 1.6 * 190)::INT) AS n FROM w GROUP BY doc_id) SELECT doc_id, n::INT AS windows, h::INT AS longest, round(1 - least(1.0::DOUBLE, n / 10.0::DOUBLE + greatest(0, h - 3) / 6.0::DOUBLE), 6) AS liability FROM n JOIN h USING (doc_id)")
def fn17(spark, d):
    from ..operators.windows import liability

    return liability(sequences(spark, d).select("doc_id", F.col("aa").alias("seq")))


#: Codon frequencies of a made-up organism: by a rule, all different, so that no tie depends on an engine.
FREQUENCY = {c: (7 * k * k + 13 * k + 5) % 997 / 997 for k, c in enumerate(sorted(SENSE), 1)} | {"TAA": 0.5, "TAG": 0.2, "TGA": 0.3}
_BEST = {a: cs for a, cs in fn.best_codons(FREQUENCY).items()}
_BEST_SQL = "CASE a " + " ".join(f"WHEN '{a}' THEN '{cs[0]}'" for a, cs in _BEST.items() if a != "*") + " END"
_LOG = {c: max(FREQUENCY[c] / FREQUENCY[_BEST[CODONS[c]][0]], 1e-12) for c in SENSE}


@query("fn18_cai", f"WITH {S}, x AS (SELECT doc_id, substr(nt, 3 * i + 1, 3) AS cod FROM s, range(85) r(i)), v AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {_LOG[c]!r}::DOUBLE)" for c in SENSE) + ") v(cod, w)) SELECT doc_id, round(exp(avg(ln(w))), 6) AS cai FROM x JOIN v USING (cod) GROUP BY doc_id")
def fn18(spark, d):
    return sequences(spark, d).select("doc_id", F.round(fn.cai(F.col("nt"), FREQUENCY), 6).alias("cai"))


@query("fn19_backtranslate", f"WITH {S}, x AS (SELECT doc_id, i, substr(aa, i, 1) AS a FROM s, range(1, 257) q(i)) SELECT doc_id, concat(string_agg({_BEST_SQL}, '' ORDER BY i), 'TAA') AS cds FROM x GROUP BY doc_id")
def fn19(spark, d):
    return sequences(spark, d).select("doc_id", fn.backtranslate(F.col("aa"), FREQUENCY).alias("cds"))


_CHOICES = "CASE a " + " ".join(f"WHEN '{a}' THEN [" + ", ".join(f"'{c}'" for c in cs) + "]" for a, cs in _BEST.items() if a != "*") + " END"


@query("fn20_synonymous_cds", f"WITH {S}, x AS (SELECT doc_id, t, i, {_CHOICES} AS cs, ('0x' || substr(sha256(concat('7:', t, ':c', doc_id, ':', i - 1)), 1, 8))::BIGINT AS draw FROM (SELECT doc_id, t, i, substr(aa, i, 1) AS a FROM s, range(1, 257) q(i), range(3) w(t))) SELECT doc_id, t::INT AS trial, concat(string_agg(CASE WHEN t = 0 OR len(cs) = 1 OR draw % 100 < 65 THEN cs[1] ELSE cs[2 + (draw % (len(cs) - 1))::INT] END, '' ORDER BY i), 'TAA') AS cds FROM x GROUP BY doc_id, t")
def fn20(spark, d):
    s = sequences(spark, d).select("doc_id", "aa", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial"))
    return s.select("doc_id", "trial", fn.synonymous_cds(F.col("aa"), FREQUENCY, 7, F.col("trial"), F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("cds"))


@query("fn22_translation_relation", f"WITH {S} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'n_addition' WHEN 2 THEN 'c_addition' WHEN 3 THEN 'both_additions' ELSE 'mismatch' END AS relation FROM s")
def fn22(spark, d):
    m, a = F.col("doc_id") % 5, F.col("aa")
    t = F.when(m == 0, a).when(m == 1, F.concat(F.lit("WW"), a)).when(m == 2, F.concat(a, F.lit("WW"))).when(m == 3, F.concat(F.lit("W"), a, F.lit("W"))).otherwise(F.lit("WW"))
    return sequences(spark, d).select("doc_id", fn.translation_relation(a, t).alias("relation"))


@query("fn23_header_fields", "SELECT page_id, k AS key, v AS value FROM (SELECT page_id, unnest(regexp_extract_all(concat('[url=', replace(url, ']', ''), '] [id=', page_id, ']'), '\\[([^=\\]]+)=([^\\]]*)\\]', 1)) AS k, unnest(regexp_extract_all(concat('[url=', replace(url, ']', ''), '] [id=', page_id, ']'), '\\[([^=\\]]+)=([^\\]]*)\\]', 2)) AS v FROM pages)")
def fn23(spark, d):
    from ..session import table

    header = F.concat(F.lit("[url="), F.replace("url", F.lit("]"), F.lit("")), F.lit("] [id="), F.col("page_id").cast("string"), F.lit("]"))
    return table(spark, d, "pages").select("page_id", F.explode(fn.header_fields(header)).alias("x")).select("page_id", "x.key", "x.value")


_KM = "list_distinct(list_transform(range({n}), lambda i: substr({x}, i + 1, 3)))"


@query("fn25_kmer_similarity", f"WITH {S}, p AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.aa AS x, b.aa AS y FROM s a JOIN s b ON b.doc_id = a.doc_id + 1), k AS (SELECT a_id, b_id, x, y, {_KM.format(n=254, x='x')} AS kx, {_KM.format(n=254, x='y')} AS ky FROM p) SELECT a_id, b_id, CASE WHEN x = y THEN 1.0::DOUBLE ELSE round(len(list_intersect(kx, ky))::DOUBLE / len(list_distinct(list_concat(kx, ky))), 8) END AS similarity FROM k")
def fn25(spark, d):
    s = sequences(spark, d).select("doc_id", F.col("aa").alias("x"))
    pairs = s.select(F.col("doc_id").alias("a_id"), "x", (F.col("doc_id") + 1).alias("b_id")).join(s.select(F.col("doc_id").alias("b_id"), F.col("x").alias("y")), "b_id")
    return pairs.select("a_id", "b_id", F.round(fn.kmer_similarity(F.col("x"), F.col("y")), 8).alias("similarity"))


@query("fn26_formats", "SELECT event_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) ELSE printf('%.1f KB', b / 1024.0::DOUBLE) END AS size, printf('%02d:%02d:%02d', b // 3600, (b % 3600) // 60, b % 60) AS took FROM (SELECT event_id, event_id % 5000 AS b FROM events)")
def fn26(spark, d):
    from ..session import table

    b = F.col("event_id") % 5000
    return table(spark, d, "events").select("event_id", fn.format_bytes(b).alias("size"), fn.format_duration(b).alias("took"))


VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"ACGTN", *sorted(CODONS)]


@query("fn27_token_ids", f"WITH {ORF_SQL}, t AS (SELECT doc_id, string_split({ENC_SQL}, ' ') AS ts FROM orf), v AS (SELECT [" + ", ".join(f"'{t}'" for t in VOCABULARY) + "] AS v) SELECT doc_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN i < len(ts) THEN coalesce(list_position(v, ts[i + 1]) - 1, 1) ELSE 0 END), ',') AS ids FROM t, v")
def fn27(spark, d):
    return _orf(spark, d).select("doc_id", F.array_join(fn.token_ids(fn.encode(F.col("nt"), F.col("orf")), VOCABULARY, 64).cast("array<string>"), ",").alias("ids"))


@query("fn28_blocks", f"WITH {ORF_SQL}, t AS (SELECT doc_id, string_split({ENC_SQL}, ' ') AS ts FROM orf) SELECT doc_id, i::INT AS block, array_to_string(ts[i * 32 + 1 : i * 32 + 32], ' ') AS tokens FROM t, range(10) r(i) WHERE i < len(ts) // 32")
def fn28(spark, d):
    b = fn.blocks(F.split(fn.encode(F.col("nt"), F.col("orf")), " "), 32)
    return _orf(spark, d).select("doc_id", F.posexplode(b).alias("block", "x")).select("doc_id", "block", F.array_join("x", " ").alias("tokens"))
