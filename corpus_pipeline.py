"""The corpus pipeline over `documents`: quality, line dedup, near-dedup, decontamination, mixing to target weights.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontaminate, line_dedup, mixing, quality, simhash

#: Near copies share this part of their shingles of five words.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
MIN_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any other; columns stay as they are."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = quality.SCORE
    while score.lower() in map(str.lower, docs.columns):
        score += "_"
    return quality.classify(docs, model, score).where(F.col(score) >= MIN_QUALITY).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; the documents stay, with n_chars of what is left of them. A null text stays null; a
    text that loses all its lines is empty."""
    done = line_dedup.line_dedup(docs)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; of rows that repeat a doc_id one. Texts
    without words are copies of each other; rows without doc_id stay."""
    return simhash.first_of_each(docs, SHINGLE_WORDS, SIMILARITY).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left: taken words, and the parts that go to each output shard (see
    mixing.shard_texts)."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: SQL expresses neither the classifier nor fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    """The stages one after another. Each one's output is written to the shared folder and read again; the last stays."""
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = common.scratch(spark, f"stage{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            common.remove(spark, before)
        before = at
    return docs
