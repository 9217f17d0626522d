"""Synthetic sequences derived from the tables, as Spark columns and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

_HEX = "0123456789abcdef"
NT, AA = "ACGTACGTACGTACGT", "ACDEFGHIKLMNPQRS"
BLOCKS = 8


def derived(seed: Column, letters: str, blocks: int = BLOCKS) -> Column:
    """32 letters for each block, from the MD5 of seed:block."""
    return F.concat(*[F.translate(F.md5(F.concat(seed, F.lit(f":{k}")).cast("binary")), _HEX, letters) for k in range(blocks)])


def derived_sql(seed: str, letters: str, blocks: int = BLOCKS) -> str:
    return "concat(" + ", ".join(f"translate(md5(concat({seed}, ':{k}')), '{_HEX}', '{letters}')" for k in range(blocks)) + ")"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, nt (256 bases), aa (256 residues)."""
    seed = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", derived(seed, NT).alias("nt"), derived(seed, AA).alias("aa"))


SEQUENCES_SQL = f"(SELECT doc_id, lang, source, {derived_sql('CAST(doc_id AS VARCHAR)', NT)} AS nt, {derived_sql('CAST(doc_id AS VARCHAR)', AA)} AS aa FROM documents)"
#: Copies of a document have the same sequence.
TEXT_NT_SQL = f"(SELECT doc_id, lang, source, {derived_sql('md5(text)', NT)} AS nt FROM documents)"


def text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", derived(F.md5(F.col("text").cast("binary")), NT).alias("nt"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, start1, end1: closed, counted from one."""
    e = F.col("event_id")
    start = F.pmod(e * 7, F.lit(500)) + 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", start.alias("start1"), (start + F.pmod(e * 13, F.lit(40))).alias("end1"))


INTERVALS_SQL = "(SELECT user_id, event_id, event_type, (event_id * 7) % 500 + 1 AS start1, (event_id * 7) % 500 + 1 + (event_id * 13) % 40 AS end1 FROM events)"
