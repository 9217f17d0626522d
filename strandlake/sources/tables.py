"""Structure files, predictor tables, three-line records, metric trees, evidence documents, archives."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Three-letter residue names.
THREE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def ca_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width structure files -> file, chain, pos, residue, x, y, z, plddt: CA atoms, the first alternative of each.

    Confidence of 1 at most in a whole file is a fraction and is multiplied by 100.
    """
    part = lambda a, n: F.trim(F.substr("value", F.lit(a), F.lit(n)))
    rows = spark.read.text(path).select(_file(), "value").where((part(1, 6) == "ATOM") & (part(13, 4) == "CA") & part(17, 1).isin("", "A"))
    names = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    rows = rows.select("file", part(22, 1).alias("chain"), part(23, 4).cast("int").alias("pos"), F.try_element_at(names, part(18, 3)).alias("residue"), part(31, 8).cast("double").alias("x"), part(39, 8).cast("double").alias("y"), part(47, 8).cast("double").alias("z"), part(61, 6).cast("double").alias("b"))
    top = F.max("b").over(Window.partitionBy("file"))
    return rows.withColumn("plddt", F.when(top <= 1, F.col("b") * 100).otherwise(F.col("b"))).drop("b")


def ca_faults(atoms: DataFrame) -> DataFrame:
    """file, fault: several chains, repeated places, unknown residues."""
    by = atoms.groupBy("file").agg(F.countDistinct("chain").alias("chains"), F.count("*").alias("n"), F.countDistinct("chain", "pos").alias("places"), F.count_if(F.col("residue").isNull()).alias("unknown"))
    found = F.array(F.when(F.col("chains") > 1, "several_chains"), F.when(F.col("places") < F.col("n"), "repeated_residue"), F.when(F.col("unknown") > 0, "unknown_residue"))
    return by.select("file", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("fault"))


def predictor_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tables with a preamble and a header row whose first cell is Pos -> file, cells (map of column to text).

    A row with another number of cells, or a header with repeated names, is an error.
    """
    rows = spark.read.text(path).select(_file(), F.monotonically_increasing_id().alias("at"), F.split("value", "\t").alias("c"))
    heads = rows.where(F.trim(F.col("c")[0]) == "Pos").groupBy("file").agg(F.min(F.struct("at", "c")).alias("h")).select("file", "h.at", F.col("h.c").alias("names"))
    body = rows.alias("r").join(heads.alias("h"), "file").where("r.at > h.at and size(r.c) > 0 and trim(r.c[0]) <> ''")
    bad = (F.size("r.c") != F.size("names")) | (F.size(F.array_distinct("names")) != F.size("names"))
    return body.select("file", F.when(bad, F.raise_error(F.lit("malformed predictor table"))).otherwise(F.map_from_arrays(F.transform("names", F.trim), "r.c")).alias("cells"))


def mhc_class1(rows: DataFrame) -> DataFrame:
    c = lambda k, t: F.try_element_at("cells", F.lit(k)).try_cast(t)
    return rows.select("file", F.lit("I").alias("mhc_class"), c("Pos", "int").alias("position"), c("Peptide", "string").alias("peptide"), c("core", "string").alias("core"), c("ID", "string").alias("record_id"), c("EL-score", "double").alias("el_score"), c("EL_Rank", "double").alias("el_rank"), c("BA-score", "double").alias("ba_score"), c("BA_Rank", "double").alias("ba_rank"))


def mhc_class2(rows: DataFrame) -> DataFrame:
    c = lambda k, t: F.try_element_at("cells", F.lit(k)).try_cast(t)
    return rows.select("file", F.lit("II").alias("mhc_class"), c("Pos", "int").alias("position"), c("Peptide", "string").alias("peptide"), c("Core", "string").alias("core"), c("ID", "string").alias("record_id"), c("Score_EL", "double").alias("el_score"), c("%Rank_EL", "double").alias("el_rank"), c("Score_BA", "double").alias("ba_score"), c("%Rank_BA", "double").alias("ba_rank"))


def binding_level(mhc_class: Column, rank: Column) -> Column:
    """Strong or weak by rank: 0.5 and 2 for class I, 1 and 5 for class II."""
    strong, weak = F.when(mhc_class == "I", 0.5).otherwise(1.0), F.when(mhc_class == "I", 2.0).otherwise(5.0)
    return F.when(rank <= strong, "strong").when(rank <= weak, "weak").otherwise("none")


def regression_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with sequence and label -> sequence, normalized, label, sha256; rows with an empty label go, other faults fail."""
    from ..functions.sequence import normalize_nucleotides

    raw = spark.read.csv(path, header=True, mode="FAILFAST").where("label is not null and trim(label) <> ''")
    n = normalize_nucleotides(F.col("sequence"))
    ok = F.when(n.isNull(), F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), F.substr(F.coalesce("sequence", F.lit("")), F.lit(1), F.lit(20))))).otherwise(n)
    return raw.select("sequence", ok.alias("normalized"), F.col("label").cast("double").alias("label")).withColumn("sha256", F.sha2(F.col("normalized").cast("binary"), 256))


def classification_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV of (sequence, label) or (sequence1, sequence2, label) -> first, second (null), label; another number of columns is an error."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    if len(raw.columns) not in (2, 3):
        raise ValueError("two columns, or three for pairs")
    *texts, label = raw.columns
    return raw.select(F.col(texts[0]).alias("first"), (F.col(texts[1]) if len(texts) > 1 else F.lit(None).cast("string")).alias("second"), F.col(label).cast("int").alias("label"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their manifest (sinks.write_vectors): a number of rows or a width that differs is an error."""
    stated = spark.read.schema("rows long, width int").json(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/vectors")
    name = next(f.name for f in rows.schema if f.dataType.typeName() == "array")
    if rows.count() != stated["rows"]:
        raise ValueError("the manifest states another number of vectors")
    ok = F.when(F.size(name) == stated["width"], F.col(name)).otherwise(F.raise_error(F.lit("a vector has another width than the manifest states")))
    return rows.withColumn(name, ok)


def dataset(spark: SparkSession, kind: str, path: str, order: str, validation_percent: int) -> DataFrame:
    """A data set of a kind that Spark reads, with split: the first validation_percent of the rows in order are validation.

    Places come from ranges of the order and counts of them, not from one task.
    """
    from ..operators.windows import numbered

    rows = spark.read.format(kind).load(path)
    total = rows.agg(F.count("*").alias("_total"))
    placed = numbered(rows, [order], "_n").join(F.broadcast(total))  # one row
    return placed.withColumn("split", F.when(F.col("_n") <= F.floor(F.col("_total") * validation_percent / 100), "validation").otherwise("train")).drop("_n", "_total")


def resolved(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a pattern, sorted; a pattern that no file has is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise ValueError(f"no file matches {pattern}")
    return sorted(f.getPath().toString() for f in found)


def run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """<model>-seed<k>/results/*/eval_results.json below root -> model, seed, metrics. A missing metric is an error."""
    names = ("eval_spearman_corr", "eval_pearson_corr", "eval_r2_score", "eval_mse_loss")
    df = spark.read.schema(", ".join(f"{n} double" for n in names)).option("multiLine", "true").json(f"{root}/*/results/*/eval_results.json")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/results/[^/]+/eval_results\.json$", 1)
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull()
    return df.select(F.regexp_extract(run, r"^(.*)-seed\d+$", 1).alias("model"), F.when(bad, F.raise_error(F.concat(F.lit("missing metric: "), run))).otherwise(F.regexp_extract(run, r"-seed(\d+)$", 1)).cast("int").alias("seed"), *names)


def best_metric(states: DataFrame) -> DataFrame:
    """run, path, global_step, best_metric -> the metric of each run's last step, ties by path; nulls don't count."""
    return states.where("best_metric is not null").groupBy("run").agg(F.max_by("best_metric", F.struct("global_step", "path")).alias("best_metric"))


def throughput(spark: SparkSession, path: str) -> DataFrame:
    """A summary TSV, fastest first; what is no number is 0."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.withColumn("samples_per_second", F.coalesce(F.col("samples_per_second").try_cast("double"), F.lit(0.0))).orderBy(F.desc("samples_per_second"))


def evidence(spark: SparkSession, path: str, candidates: DataFrame) -> DataFrame:
    """Evidence documents (observations as an array) -> one row each, with fault: unknown candidate, other sequence,
    place outside it, unknown status; null if well."""
    kind = "observations array<struct<evidence_id: string, candidate_id: string, sequence_sha256: string, residue_start: int, residue_end: int, status: string>>"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("observations").alias("o")).select("o.*")
    c = candidates.select("candidate_id", F.length("sequence").alias("_n"), F.sha2(F.col("sequence").cast("binary"), 256).alias("_h"))
    inside = (F.col("residue_start") >= 1) & (F.col("residue_start") <= F.col("residue_end")) & (F.col("residue_end") <= F.col("_n"))
    fault = F.when(F.col("_n").isNull(), "unknown_candidate").when(F.col("sequence_sha256") != F.col("_h"), "sequence_differs").when(~inside, "outside").when(~F.col("status").isin("supported", "risk", "context", "not_supported"), "unknown_status")
    return rows.join(c, "candidate_id", "left").withColumn("fault", fault).drop("_n", "_h")


def usage_faults(usage: DataFrame) -> DataFrame:
    """codon, frequency -> codon, fault: missing or unknown codons, values that are negative or not finite, residues without any."""
    from ..functions.constants import CODONS, SENSE

    all61 = usage.sparkSession.createDataFrame([(c, CODONS[c]) for c in SENSE], "codon string, residue string")
    j = all61.join(usage, "codon", "full_outer")
    f = F.col("frequency").cast("double")
    one = F.when(F.col("residue").isNull(), "unknown_codon").when(f.isNull(), "missing_codon").when(F.isnan(f) | (F.abs(f) == float("inf")) | (f < 0), "bad_value")
    single = j.select("codon", one.alias("fault")).where("fault is not null")
    empty = j.where("residue is not null").groupBy("residue").agg(F.sum("frequency").alias("t")).where("coalesce(t, 0) <= 0").select(F.col("residue").alias("codon"), F.lit("residue_without_codon").alias("fault"))
    return single.unionByName(empty)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Files below path -> path, sha256, md5, size_bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.col("length").alias("size_bytes"))


def load_config(spark: SparkSession, path: str, required: dict[str, type]) -> dict:
    """A small JSON object with the required keys of the given types; true and false are no numbers."""
    got = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(got, dict):
        raise ValueError("the document is no object")
    for k, t in required.items():
        if k not in got or not isinstance(got[k], t) or (t in (int, float) and isinstance(got[k], bool)):
            raise ValueError(f"{k} is missing or no {t.__name__}")
    return got
