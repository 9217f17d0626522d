"""Queries of sources and sinks: tables are written as files of each kind to the shared folder and read back by the sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import SEQUENCES_SQL, sequences
from ..functions.constants import SENSE
from ..operators.graph import shared_folder
from ..sources import fasta, readers, sinks, tables
from ..session import table
from . import rounds

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


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put_lines(df: DataFrame, path: str, extension: str, files: int, order: list[str], compression: str = "none") -> str:
    """The column line as text files with this extension, rows of a file in order."""
    rows = df.repartitionByRange(files, order[0]).sortWithinPartitions(*order).select("line")
    rows.write.option("extension", extension).option("quote", "\u0000").option("sep", "\u0001").option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("compression", compression).csv(path)
    return path


def put_fasta(df: DataFrame, path: str, files: int = 3, compression: str = "none") -> str:
    """id, header, sequence as FASTA files."""
    text = fasta.wrapped(F.col("header"), F.col("sequence"), 60)
    return put_lines(df.select("id", F.posexplode(F.split(text, "\n")).alias("n", "line")), path, "fna", files, ["id", "n"], compression)


def _marked(spark, d) -> DataFrame:
    """Sequences of 1 to 250 letters, some in lower case or as RNA, with headers that say more than the id."""
    i = F.col("doc_id")
    q = F.substr("nt", F.lit(1), (i % 250 + 1).cast("int"))
    q = F.when(i % 3 == 0, F.lower(q)).when(i % 3 == 1, F.translate(q, "T", "U")).otherwise(q)
    return sequences(spark, d).select(i.alias("id"), F.concat(F.lit("r"), i.cast("string"), F.lit(" of "), "lang").alias("header"), q.alias("sequence"))


_Q = "substr(nt, 1, (doc_id % 250 + 1)::INT)"


@query("src01_tolerant_fasta", f"WITH {S} SELECT 'r' || doc_id || ' of ' || lang AS header, {_Q} AS sequence FROM s")
def src01(spark, d):
    at = put_fasta(_marked(spark, d), place(spark, "fasta"))
    got = fasta.tolerant(spark, at).select("file", "record", "sequence")
    return got.join(fasta.raw(spark, at).select("file", "record", "header"), ["file", "record"]).select("header", "sequence")


@query("src02_files_and_records", "SELECT count(*) AS records, 3::BIGINT AS files, true AS dense FROM documents")
def src02(spark, d):
    got = fasta.tolerant(spark, put_fasta(_marked(spark, d), place(spark, "fasta")))
    by = got.groupBy("file_index").agg(F.count("*").alias("n"), F.min("record").alias("a"), F.max("record").alias("z"))
    return by.agg(F.sum("n").alias("records"), F.max("file_index").cast("long").alias("files"), F.bool_and((F.col("a") == 1) & (F.col("z") == F.col("n"))).alias("dense"))


@query("src03_discovered_files", "SELECT 4::BIGINT AS files")
def src03(spark, d):
    at = place(spark, "found")
    some = _marked(spark, d)
    put_fasta(some, f"{at}/a", 2)
    put_fasta(some, f"{at}/a/deeper", 2, "gzip")
    put_lines(some.select("id", F.col("header").alias("line")), f"{at}/notes", "txt", 1, ["id"])
    return fasta.discovered(spark, [at, f"{at}/a"]).agg(F.count("*").alias("files"))


@query("src04_plain_fasta", f"WITH {S} SELECT 'r' || doc_id || ' of ' || lang AS header, CASE doc_id % 3 WHEN 0 THEN lower({_Q}) WHEN 1 THEN translate({_Q}, 'T', 'U') ELSE {_Q} END AS sequence FROM s")
def src04(spark, d):
    return fasta.raw(spark, put_fasta(_marked(spark, d), place(spark, "fasta"))).select("header", "sequence")


@query("src05_strict_fasta", f"WITH {S} SELECT 'r' || doc_id AS record_id, 'of ' || lang AS description, length({_Q})::INT AS n FROM s")
def src05(spark, d):
    return fasta.strict(spark, put_fasta(_marked(spark, d), place(spark, "fasta"))).select("record_id", "description", F.length("sequence").alias("n"))


@query("src06_annotated_cds", f"WITH {rounds._ANNOTATED} SELECT reason, count(*) AS n, sum(length(q))::BIGINT AS letters FROM f WHERE q <> '' GROUP BY 1")
def src06(spark, d):
    from ..operators.rules import cds_fault

    cds = rounds.annotated(spark, d).where("sequence <> ''").select(F.col("doc_id").alias("id"), "header", "sequence")
    got = fasta.raw(spark, put_fasta(cds, place(spark, "cds"), 2, "gzip"))
    return got.groupBy(cds_fault(F.col("header"), F.col("sequence")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("letters"))


@query("src07_aligned_fasta", f"WITH {S} SELECT 'r' || doc_id AS record_id, substr(nt, 1, 30) || '--' AS aligned, true AS equal_length, true AS unique_ids FROM s")
def src07(spark, d):
    rows = sequences(spark, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("header"), F.concat(F.lower(F.substr("nt", F.lit(1), F.lit(30))), F.lit(".-")).alias("sequence"))
    return fasta.aligned(fasta.raw(spark, put_fasta(rows, place(spark, "aligned"))))


@query("src08_single_record", f"WITH {S} SELECT length(nt)::INT AS n, nt AS sequence FROM s WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def src08(spark, d):
    one = sequences(spark, d).orderBy("doc_id").limit(1).select(F.col("doc_id").alias("id"), F.lit("only").alias("header"), F.col("nt").alias("sequence"))
    text = fasta.single(spark, put_fasta(one, place(spark, "single"), 1))
    return spark.range(1).select(F.lit(len(text)).alias("n"), F.lit(text).alias("sequence"))


@query("src09_parsed_text", f"WITH {S} SELECT doc_id, 'a' || doc_id AS record_id, nt AS sequence FROM s UNION ALL SELECT doc_id, 'b', aa FROM s")
def src09(spark, d):
    s = sequences(spark, d)
    text = F.concat(fasta.wrapped(F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(" x")), F.col("nt"), 70), F.lit("\n"), fasta.wrapped(F.lit("b"), F.col("aa"), 10), F.lit("\n"))
    return s.select("doc_id", F.explode(fasta.parse(text)).alias("r")).select("doc_id", "r.record_id", "r.sequence")


_ATOMS = "WITH a AS (SELECT (o.k % 9000 + 1)::INT AS pos, k, round((k % 997) / 7.0, 3) AS x FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) o WHERE k < 9000)"


@query("src10_ca_atoms", _ATOMS + " SELECT pos, CASE pos % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'G' ELSE 'W' END AS residue, x::DOUBLE AS x, 85.0::DOUBLE AS plddt FROM a")
def src10(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("o")).orderBy("o").limit(9000)
    # Places from one, as many as there are rows.
    from pyspark.sql import Window

    k = k.withColumn("k", F.row_number().over(Window.orderBy("o")) - 1)
    pos, name = F.col("k") % 9000 + 1, F.element_at(F.array(F.lit("ALA"), F.lit("GLY"), F.lit("TRP")), (F.col("k") + 1).cast("int") % 3 + 1)
    atom = F.format_string("ATOM  %5d  CA  %s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", pos.cast("int"), name, pos.cast("int"), F.round((F.col("k") % 997) / 7.0, 3), F.lit(1.0), F.lit(2.0), F.lit(0.85))
    other = F.format_string("ATOM  %5d  CB  %s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", pos.cast("int"), name, pos.cast("int"), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(0.85))
    at = put_lines(k.select("k", F.posexplode(F.array(atom, other)).alias("n", "line")), place(spark, "atoms"), "pdb", 1, ["k", "n"])
    return tables.ca_atoms(spark, at).select("pos", "residue", "x", F.round("plddt", 6).alias("plddt"))


def _predictor(spark, d, header: list[str], cells: list) -> str:
    """A predictor's table of events, with a preamble."""
    e = table(spark, d, "events").select("event_id", F.concat_ws("\t", *cells).alias("line"))
    top = spark.createDataFrame([(-2, "\tHLA-A02:01"), (-1, "\t".join(header))], "event_id long, line string")
    return put_lines(top.unionByName(e), place(spark, "predicted"), "xls", 1, ["event_id"])


_RANK = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 50) / 10.0 END"


@query("src11_predictor_cells", "SELECT event_id AS position, 'M' || event_id AS peptide FROM events")
def src11(spark, d):
    at = _predictor(spark, d, ["Pos", "Peptide"], [F.col("event_id").cast("string"), F.concat(F.lit("M"), F.col("event_id").cast("string"))])
    return tables.predictor_rows(spark, at).select(F.col("cells")["Pos"].cast("long").alias("position"), F.col("cells")["Peptide"].alias("peptide"))


@query("src12_mhc_class1", f"SELECT (event_id % 90)::INT AS position, 'c' || user_id AS record_id, ({_RANK})::DOUBLE AS el_rank, CASE WHEN {_RANK} <= 0.5 THEN 'strong' WHEN {_RANK} <= 2 THEN 'weak' ELSE 'none' END AS level FROM events")
def src12(spark, d):
    return _binding(tables.mhc_class1(tables.predictor_rows(spark, _predictor(spark, d, ["Pos", "Peptide", "ID", "core", "EL-score", "EL_Rank"], _cells()))))


@query("src13_mhc_class2", f"SELECT (event_id % 90)::INT AS position, 'c' || user_id AS record_id, ({_RANK})::DOUBLE AS el_rank, CASE WHEN {_RANK} <= 1 THEN 'strong' WHEN {_RANK} <= 5 THEN 'weak' ELSE 'none' END AS level FROM events")
def src13(spark, d):
    return _binding(tables.mhc_class2(tables.predictor_rows(spark, _predictor(spark, d, ["Pos", "Peptide", "ID", "Core", "Score_EL", "%Rank_EL"], _cells()))))


def _cells() -> list:
    i = F.col("event_id")
    rank = F.when(i % 7 == 0, "NA").otherwise(((i % 50) / 10.0).cast("string"))
    return [(i % 90).cast("string"), F.lit("MKL"), F.concat(F.lit("c"), F.col("user_id").cast("string")), F.lit("MKL"), F.lit("0.5"), rank]


def _binding(rows: DataFrame) -> DataFrame:
    return rows.select("position", "record_id", "el_rank", tables.binding_level(F.col("mhc_class"), F.col("el_rank")).alias("level"))


@query("src14_three_line", f"WITH {S} SELECT 'p' || doc_id AS record_id, substr(aa, 1, (doc_id % 200 + 20)::INT) AS sequence, rpad(repeat('H', (doc_id % 15)::INT), (doc_id % 200 + 20)::INT, '.') AS labels FROM s")
def src14(spark, d):
    """Files of all documents' sequences, read in ranges of some KB, so that records lie across ranges."""
    n, i = (F.col("doc_id") % 200 + 20).cast("int"), F.col("doc_id")
    three = F.array(F.concat(F.lit(">p"), i.cast("string"), F.lit(" of "), "lang"), F.substr("aa", F.lit(1), n), F.rpad(F.repeat(F.lit("H"), (i % 15).cast("int")), n, F.lit(".")))
    at = put_lines(sequences(spark, d).select("doc_id", F.posexplode(three).alias("n", "line")), place(spark, "three"), "txt", 3, ["doc_id", "n"])
    return readers.three_line(spark, at, 16 << 10).select("record_id", "sequence", "labels")


@query("src22_archive_members", "SELECT doc_id, lang, n_chars FROM documents")
def src22(spark, d):
    """Archives of a hundred documents each, with exactly two members: ids with languages, and sizes."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / 100).alias("block"))
    as_json = lambda *c: F.to_json(F.sort_array(F.collect_list(F.struct("doc_id", *c))))
    packed = docs.groupBy("block").agg(as_json("lang").alias("a"), as_json("n_chars").alias("b"))
    member = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("content"))
    at = place(spark, "archives")
    sinks.write_archives(packed.select(F.concat(F.lit("block-"), F.col("block").cast("string")).alias("archive"), F.array(member("ids/langs.json", "a"), member("sizes.json", "b")).alias("members")), at).agg(F.sum("bytes")).collect()  # one number
    rows = readers.archive_members(spark, at, ["ids/langs.json", "sizes.json"])
    text = F.col("content").cast("string")
    part = lambda n, c: rows.where(F.col("member") == n).select(F.explode(F.from_json(text, f"array<struct<doc_id: long, {c}>>")).alias("x")).select("x.*")
    return part("ids/langs.json", "lang: string").join(part("sizes.json", "n_chars: long"), "doc_id")


def _labelled(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return sequences(spark, d).select(F.lower(F.substr("nt", F.lit(1), (i % 99 + 1).cast("int"))).alias("sequence"), F.when(i % 5 == 0, "").otherwise(((i % 40) / 4.0).cast("string")).alias("label"))


@query("src15_regression_csv", f"WITH {S} SELECT substr(nt, 1, (doc_id % 99 + 1)::INT) AS normalized, ((doc_id % 40) / 4.0)::DOUBLE AS label FROM s WHERE doc_id % 5 <> 0")
def src15(spark, d):
    at = place(spark, "regression")
    _labelled(spark, d).write.option("header", True).csv(at)
    return tables.regression_records(spark, at).select("normalized", "label")


@query("src16_classification_csv", f"WITH {S} SELECT substr(nt, 1, 9) AS first, substr(aa, 1, 9) AS second, (doc_id % 3)::INT AS label FROM s")
def src16(spark, d):
    at = place(spark, "pairs")
    sequences(spark, d).select(F.substr("nt", F.lit(1), F.lit(9)).alias("sequence1"), F.substr("aa", F.lit(1), F.lit(9)).alias("sequence2"), (F.col("doc_id") % 3).alias("label")).write.option("header", True).csv(at)
    return tables.classification_records(spark, at)


@query("src17_run_metrics", "SELECT 'm' || (s_suppkey % 5) AS model, s_suppkey::INT AS seed, s_acctbal AS eval_mse_loss FROM supplier")
def src17(spark, d):
    at = place(spark, "runs")
    s = table(spark, d, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 5).cast("string"), F.lit("-seed"), F.col("s_suppkey").cast("string")).alias("run"), *[F.col("s_acctbal").alias(f"eval_{n}") for n in ("spearman_corr", "pearson_corr", "r2_score", "mse_loss")])
    sinks.write_documents(s, "run", at, lambda run: f"{run}/results/r/eval_results.json")
    return tables.run_metrics(spark, at).select("model", "seed", "eval_mse_loss")


@query("src18_best_metric", "SELECT run, arg_max(m, (step, path)) AS best_metric FROM (SELECT o_custkey AS run, o_orderkey AS step, 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS m FROM orders) WHERE m IS NOT NULL GROUP BY run")
def src18(spark, d):
    o = table(spark, d, "orders")
    states = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("global_step"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("best_metric"))
    at = place(spark, "states")
    states.write.json(at)
    return tables.best_metric(spark.read.schema("run long, path string, global_step long, best_metric double").json(at))


@query("src19_embedding_folder", "SELECT vec_id, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def src19(spark, d):
    at = place(spark, "vectors")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    sinks.write_vectors(e, at, "vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return tables.read_vectors(spark, at).select("vec_id", F.size("embedding").alias("width"), F.round(total, 4).alias("total"))


@query("src20_evidence_documents", "SELECT CASE WHEN c.c_custkey IS NULL THEN 'unknown_candidate' WHEN event_id % 6 = 0 THEN 'sequence_differs' WHEN event_id % 30 + 1 > length(c_name) THEN 'outside' WHEN event_id % 5 = 0 THEN 'unknown_status' END AS fault, count(*) AS n FROM events LEFT JOIN customer c ON user_id = c_custkey GROUP BY 1")
def src20(spark, d):
    i = F.col("event_id")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("candidate_id"), F.col("c_name").alias("sequence"))
    j = table(spark, d, "events").select(i, F.col("user_id").cast("string").alias("candidate_id")).join(c, "candidate_id", "left")
    o = F.struct(i.cast("string").alias("evidence_id"), "candidate_id", F.when(i % 6 == 0, "other").otherwise(F.sha2(F.col("sequence").cast("binary"), 256)).alias("sequence_sha256"), F.lit(1).alias("residue_start"), (i % 30 + 1).alias("residue_end"), F.when(i % 5 == 0, "odd").otherwise("risk").alias("status"))
    at = place(spark, "evidence")
    j.select((i % 50).alias("b"), o.alias("o")).groupBy("b").agg(F.collect_list("o").alias("observations")).select("observations").write.option("maxRecordsPerFile", 1).json(at)
    return tables.evidence(spark, at, c).groupBy("fault").agg(F.count("*").alias("n"))


@query("src21_usage_faults", "SELECT * FROM (VALUES ('ATG', 'missing_codon'), ('M', 'residue_without_codon'), ('TAA', 'unknown_codon'), ('GCC', 'bad_value')) v(codon, fault)")
def src21(spark, d):
    at = place(spark, "usage")
    rows = [(c, -1.0 if c == "GCC" else 0.5) for c in SENSE if c != "ATG"] + [("TAA", 0.1)]
    spark.createDataFrame(rows, "codon string, frequency double").write.json(at)
    return tables.usage_faults(spark.read.schema("codon string, frequency double").json(at))


@query("src24_dataset_slices", "SELECT CASE WHEN n <= floor(total * 0.1) THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS total FROM events) GROUP BY 1")
def src24(spark, d):
    at = place(spark, "dataset")
    table(spark, d, "events").select("event_id", "event_type").write.json(at)
    return tables.dataset(spark, "json", at, "event_id", 10).groupBy("split").agg(F.count("*").alias("n"))


@query("src25_resolved_files", "SELECT 3::BIGINT AS files, true AS in_order")
def src25(spark, d):
    at = place(spark, "text")
    put_lines(table(spark, d, "events").select("event_id", F.col("event_type").alias("line")), at, "txt", 3, ["event_id"])
    found = tables.resolved(spark, f"{at}/*.txt")
    return spark.range(1).select(F.lit(len(found)).cast("long").alias("files"), F.lit(found == sorted(found)).alias("in_order"))


@query("src26_latest_run", "SELECT p_partkey, 'second' AS run FROM part")
def src26(spark, d):
    at = place(spark, "stage")
    p = table(spark, d, "part").select("p_partkey")
    for run in ("first", "second"):
        sinks.publish(p.withColumn("run", F.lit(run)), at, run)
    return sinks.latest(spark, at)


@query("src27_throughput", "SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE round(s_acctbal, 2) END AS samples_per_second FROM supplier")
def src27(spark, d):
    at = place(spark, "throughput")
    table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 0, "n/a").otherwise(F.round("s_acctbal", 2).cast("string")).alias("samples_per_second")).write.option("sep", "\t").option("header", True).csv(at)
    return tables.throughput(spark, at)


@query("snk01_encoded_text", f"WITH {S}, q AS (SELECT doc_id, substr(nt, 1, (doc_id % 9 + 1)::INT) AS t FROM s) SELECT array_to_string(string_split(t, ''), ' ') AS value FROM q WHERE NOT contains(t, 'ATG')")
def snk01(spark, d):
    at = place(spark, "encoded")
    q = sequences(spark, d).select("doc_id", F.substr("nt", F.lit(1), (F.col("doc_id") % 9 + 1).cast("int")).alias("sequence"))
    sinks.encoded(q.where(~F.contains("sequence", F.lit("ATG"))), ["doc_id"]).write.text(at)
    return spark.read.text(at)


@query("snk03_shards", "SELECT sum(n)::BIGINT AS lines, sum(b)::BIGINT AS bytes, true AS all_shards FROM (SELECT count(*) AS n, sum(octet_length(encode(event_type || event_id)) + 1) AS b FROM events)")
def snk03(spark, d):
    v = table(spark, d, "events").select(F.concat("event_type", F.col("event_id").cast("string")).alias("value"))
    got = sinks.write_shards(v, place(spark, "shards"), 8, 7)
    return got.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), (F.count("*") == 8).alias("all_shards"))


@query("snk03_shards_by_line", "WITH e AS (SELECT event_id, event_type AS v, (('0x' || substr(sha256(concat('7', chr(0), event_id)), 1, 15))::BIGINT % 8)::INT AS shard FROM events) SELECT shard, count(*) AS lines, sum(octet_length(encode(v)) + 1)::BIGINT AS bytes FROM e GROUP BY 1")
def snk03_by_line(spark, d):
    """Lines of few texts, each dealt for itself; the second call finds the shards in place."""
    v = table(spark, d, "events").select("event_id", F.col("event_type").alias("value"))
    at = place(spark, "shards")
    sinks.write_shards(v, at, 8, 7, ["event_id"])
    return sinks.write_shards(v, at, 8, 7, ["event_id"])


@query("snk04_train_and_valid", "SELECT count(DISTINCT event_type || event_id % 500) AS lines, 0::BIGINT AS in_both FROM events")
def snk04(spark, d):
    v = table(spark, d, "events").select(F.concat("event_type", (F.col("event_id") % 500).cast("string")).alias("value"))
    train, valid = place(spark, "train"), place(spark, "valid")
    sinks.write_split(v, train, valid, 0.1, 3)
    a, b = (spark.read.text(x).distinct() for x in (train, valid))
    return a.unionByName(b).agg(F.countDistinct("value").alias("lines"), (F.count("*") - F.countDistinct("value")).alias("in_both"))


@query("snk05_split_csv", f"WITH {S} SELECT array_to_string(string_split(substr(nt, 1, 6), ''), ' ') AS sequence, lang AS label FROM s")
def snk05(spark, d):
    at = place(spark, "split")
    sinks.split_csv(sequences(spark, d).select(F.lower(F.substr("nt", F.lit(1), F.lit(6))).alias("a"), "lang"), "utr").write.option("header", True).csv(at)
    return spark.read.csv(at, header=True)


@query("snk06_clean_splits", "WITH t AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, md5(text) AS sequence, doc_id AS pos FROM documents), w AS (SELECT *, row_number() OVER p AS n, first_value(split) OVER p AS f FROM t WINDOW p AS (PARTITION BY sequence ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END, pos)) SELECT split, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1 AND f = split) AS within_split, count(*) FILTER (n > 1 AND f <> split) AS cross_split FROM w GROUP BY 1")
def snk06(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(i % 3 == 0, "train").when(i % 3 == 1, "dev").otherwise("test").alias("split"), F.md5(F.col("text").cast("binary")).alias("sequence"), i.alias("pos"))
    return sinks.write_clean_splits(rows, ["test", "dev", "train"], place(spark, "clean"))


@query("snk07_flattened_csv", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role FROM conversations")
def snk07(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("xs"))
    at = place(spark, "flat")
    sinks.flattened(c, ["conv_id"], "xs", ["role"]).write.option("header", True).csv(at)
    return spark.read.schema("conv_id long, place long, role string").csv(at, header=True)


@query("snk09_wrapped_fasta", f"WITH {S} SELECT doc_id, 5::INT AS lines, 60::INT AS widest FROM s")
def snk09(spark, d):
    text = F.split(fasta.wrapped(F.col("doc_id").cast("string"), F.col("nt"), 60), "\n")
    return sequences(spark, d).select("doc_id", (F.size(text) - 1).alias("lines"), F.array_max(F.transform(F.slice(text, 2, F.size(text)), F.length)).alias("widest"))


@query("snk10_atomic_document", "SELECT count(*) AS n FROM part")
def snk10(spark, d):
    at = f"{place(spark, 'document')}/summary.json"
    for n in (1, table(spark, d, "part").count()):
        sinks.write_document(spark, at, {"n": n})
    return spark.createDataFrame([(json.loads(sinks.read_document(spark, at))["n"],)], "n long")


@query("snk11_superseded_archive", "SELECT 2::BIGINT AS versions, true AS named_by_content")
def snk11(spark, d):
    at = f"{place(spark, 'policy')}/policy.json"
    for k in range(3):
        sinks.supersede(spark, at, {"k": k})
    old = tables.digests(spark, f"{at}.versions")
    return old.agg(F.count("*").alias("versions"), F.bool_and(F.contains("path", F.col("sha256"))).alias("named_by_content"))


@query("snk13_published_run", "SELECT p_partkey, p_size FROM part")
def snk13(spark, d):
    from ..operators.verify import check

    at = place(spark, "run")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    sinks.write_published(p, at, check(p, "sizes", F.col("p_size") < 0))
    sinks.write_published(p, at, check(p, "sizes", F.col("p_size") < 0))
    return spark.read.parquet(at)


@query("dq03_stored_results", "SELECT 'line-counts' AS check_id, 'fail' AS status, (2 * count(DISTINCT l_orderkey))::VARCHAR AS detail FROM lineitem WHERE l_orderkey % 64 = 5 UNION ALL SELECT 'part-sizes', 'pass', '0'")
def dq03_stored(spark, d):
    """Results stored before, some of them altered since, against what the tables give now."""
    from ..operators.verify import all_checks, reproduced

    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    parts = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    at = place(spark, "stored")
    lines.withColumn("n", F.when(F.col("l_orderkey") % 64 == 5, F.col("n") + 1).otherwise(F.col("n"))).write.parquet(f"{at}/lines")
    parts.write.parquet(f"{at}/parts")
    return all_checks(reproduced("line-counts", spark.read.parquet(f"{at}/lines"), lines), reproduced("part-sizes", spark.read.parquet(f"{at}/parts"), parts))


@query("dq02_stored_run", "SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 3 THEN 'missing' WHEN o_orderkey % 97 = 4 THEN 'changed' END AS fault, CASE WHEN o_orderkey % 97 = 4 THEN 'o_totalprice' END AS columns FROM orders WHERE o_orderkey % 97 IN (3, 4) UNION ALL SELECT -c_custkey, 'added', NULL FROM customer WHERE c_custkey % 97 = 5")
def dq02(spark, d):
    """A stored run of all orders against one that lost some, changed some and has some more."""
    from ..operators.verify import against_stored, store_run

    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    at, k = place(spark, "run"), F.col("o_orderkey") % 97
    store_run(rows, at, ["o_orderkey"])
    more = table(spark, d, "customer").where("c_custkey % 97 = 5").select((-F.col("c_custkey")).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    again = rows.where(k != 3).withColumn("o_totalprice", F.when(k == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).unionByName(more)
    return against_stored(again, at, ["o_orderkey"]).select("o_orderkey", "fault", F.when(F.size("columns") > 0, F.array_join("columns", ",")).alias("columns"))


@query("dq03_equal_run", "SELECT 'orders-by-day' AS check_id, 'pass' AS status, count(DISTINCT o_orderdate::DATE)::BIGINT AS rows, 0::BIGINT AS faults FROM orders")
def dq03_equal(spark, d):
    """What the tables give, stored and computed again: the stored run's digests say that nothing differs."""
    from ..operators.verify import against_stored, store_run

    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    at = place(spark, "run")
    store_run(days, at, ["day"])
    faults = against_stored(days.repartition(5), at, ["day"]).agg(F.count("*").alias("faults"))
    return days.agg(F.count("*").alias("rows")).join(F.broadcast(faults)).select(F.lit("orders-by-day").alias("check_id"), F.when(F.col("faults") == 0, "pass").otherwise("fail").alias("status"), "rows", "faults")  # one row


@query("dq04_verified_runs", "SELECT 'intact' AS run, c AS check_id, 'pass' AS status, '' AS detail FROM (VALUES ('inputs-set'), ('results-set'), ('identity'), ('input-parts'), ('result-chosen'), ('result-sizes')) v(c) UNION ALL SELECT 'altered', c, CASE WHEN c = 'result-sizes' THEN 'fail' ELSE 'pass' END, CASE WHEN c = 'result-sizes' THEN (SELECT count(DISTINCT p_size)::VARCHAR FROM part WHERE p_size % 2 = 1) ELSE '' END FROM (VALUES ('inputs-set'), ('results-set'), ('identity'), ('input-parts'), ('result-chosen'), ('result-sizes')) v(c)")
def dq04(spark, d):
    """A search over all parts, published twice: as it is, and with a result that was written anew since."""
    from ..operators.runs import publish_run, verify_run
    from ..operators.verify import store_run

    def search(tables, policy):
        p = tables["parts"]
        return {"chosen": p.where(F.col("p_size") <= policy["most"]), "sizes": p.groupBy("p_size").agg(F.count("*").alias("n"))}

    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    keys = {"parts": ["p_partkey"], "chosen": ["p_partkey"], "sizes": ["p_size"]}
    out = None
    for name in ("intact", "altered"):
        at = place(spark, "search")
        run = publish_run(spark, at, {"parts": parts}, {"most": 20}, search, keys)
        if name == "altered":
            sinks.delete(spark, f"{at}/{run}/results/sizes")
            n = F.when(F.col("p_size") % 2 == 1, F.col("n") + 1).otherwise(F.col("n"))
            store_run(search({"parts": parts}, {"most": 20})["sizes"].withColumn("n", n), f"{at}/{run}/results/sizes", ["p_size"])
        one = verify_run(spark, at, run, search, keys).select(F.lit(name).alias("run"), "check_id", "status", "detail")
        out = one if out is None else out.unionByName(one)
    return out


@query("jn14_identity_semi_join", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 10 = 0")
def jn14(spark, d):
    """A selection's bindings (key and content hash) that the batch holds unchanged."""
    p = table(spark, d, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("h"))
    chosen = p.where("p_partkey % 10 = 0").withColumn("h", F.when(F.col("p_partkey") % 3 == 0, F.lit("changed")).otherwise(F.col("h")))
    return chosen.join(p, ["p_partkey", "h"], "left_semi").select("p_partkey")


@query("ma13_frozen_probe")
def ma13(spark, d):
    from ..operators.probe import frozen_probe

    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 7).cast("double").alias("y"))
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "dev").otherwise("train")
    return frozen_probe(e.withColumn("split", split), "embedding", "y", 8, [0.01, 0.1, 1.0, 10.0])


def _resumed(spark, d):
    """Events as lines of six files, streamed in two runs, of which the second goes on where the first one stopped."""
    from ..streaming.resume import run_lines

    at = place(spark, "stream")
    lines = table(spark, d, "events").select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("line"))
    folder = put_lines(lines, f"{at}/lines", "txt", 6, ["event_id"])
    n = lines.count()
    first = run_lines(spark, folder, f"{at}/out", f"{at}/work", 2, 2, 1, most_batches=2, corpus=n)
    last = run_lines(spark, folder, f"{at}/out", f"{at}/work", 2, 2, 1, corpus=n)
    return spark.read.parquet(f"{at}/out"), first, last


@query("st09_resumed_stream", "SELECT event_id, event_type, 1::BIGINT AS times FROM events")
def st09(spark, d):
    got, _, _ = _resumed(spark, d)
    parts = F.split("line", " ")
    return got.groupBy(parts[0].cast("long").alias("event_id"), parts[1].alias("event_type")).agg(F.count("*").alias("times"))


@query("st10_saved_state", "SELECT count(*) AS lines, count(*) AS cursor, 1::BIGINT AS corpus_pass, 0::BIGINT AS corpus_offset, true AS went_on FROM events")
def st10(spark, d):
    """What the state says after the two runs, beside the lines that were written."""
    got, first, last = _resumed(spark, d)
    went_on = 0 < first.cursor < last.cursor and last.resume_cursor == first.cursor and last.consumed_since_resume == last.cursor - first.cursor
    return got.agg(F.count("*").alias("lines")).select("lines", F.lit(last.cursor).cast("long").alias("cursor"), F.lit(last.corpus_pass).cast("long").alias("corpus_pass"), F.lit(last.corpus_offset).cast("long").alias("corpus_offset"), F.lit(went_on).alias("went_on"))


@query("snk02_encoded_in_order", f"WITH {S}, q AS (SELECT doc_id, substr(nt, 1, (doc_id % 9 + 1)::INT) AS t FROM s) SELECT row_number() OVER (ORDER BY doc_id) AS line, array_to_string(string_split(t, ''), ' ') AS value FROM q WHERE NOT contains(t, 'ATG')")
def snk02(spark, d):
    """Encoded records of many tasks in one order, with their line numbers, as files that keep it."""
    from ..operators.windows import numbered

    q = sequences(spark, d).select("doc_id", F.substr("nt", F.lit(1), (F.col("doc_id") % 9 + 1).cast("int")).alias("sequence")).where(~F.contains("sequence", F.lit("ATG")))
    at = place(spark, "ordered")
    numbered(q, ["doc_id"], "line").select("line", F.array_join(F.split("sequence", ""), " ").alias("value")).sortWithinPartitions("line").write.json(at)
    return spark.read.schema("line long, value string").json(at)
