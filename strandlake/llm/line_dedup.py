"""Lines that many documents share: explode, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCUMENTS = 10
MIN_POINTS = 1


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z in lower case."""
    return common.lowered(F.btrim(line, F.lit(common.SPACES)))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _digest(key: Column) -> Column:
    """128 bits, so that different lines don't meet even among 10^12."""
    return F.unhex(F.md5(key.cast("binary")))


def line_dedup(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_points: int = MIN_POINTS) -> DataFrame:
    """docs with doc_id and text -> row (a struct of the row as it came), n_lines, n_dropped, kept (the text without
    the lines whose key enough documents hold).

    Each row gives a row. Rows that share a doc_id count as one document; so do all rows without one. A null text is
    an empty one, which is one empty line; a text that loses all its lines becomes ''. Other columns only ride along, in
    row, whatever their names. A very long text is one text in memory. An empty table gives an empty one.

    Two shuffles of 16-byte digests, by digest: (digest, document) pairs, each once, are counted with map-side
    partial counts, and the same pairs are joined with the digests that reach min_documents (a line that a third of
    the documents hold is a skewed join, which adaptive execution splits). What is left, the documents that lose
    lines, meets the whole texts by doc_id.
    """
    source = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = F.array_distinct(F.filter(F.transform(_lines("text"), line_key), lambda k: F.char_length(k) >= min_points))
    pairs = source.select("doc_id", F.explode(F.transform(keys, _digest)).alias("h"))
    # Repeated rows of a document must count once.
    frequent = pairs.distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("h")
    losing = pairs.join(frequent, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    joined = source.alias("d").join(losing.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left").select("d.row", "d.text", "l.hs")
    lines = _lines("text")
    kept = F.when(F.col("hs").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("hs"), _digest(line_key(x)))))
    return joined.select("row", lines.alias("all_lines"), kept.alias("kept_lines")).select(
        "row", F.size("all_lines").cast("long").alias("n_lines"), (F.size("all_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.array_join("kept_lines", "\n").alias("kept")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: A relation of (doc_id, text) for {docs}; also a stage of the pipeline's SQL.
LINES_SQL = """
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS kept
FROM (
  SELECT d.doc_id, d.ls, list_filter(d.ls, lambda x: NOT list_contains(coalesce(f.ks, []), translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS kept
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}) d
  LEFT JOIN (
    SELECT doc_id, list(k) AS ks
    FROM (
      SELECT doc_id, k, count(*) OVER (PARTITION BY k) AS n
      FROM (
        SELECT DISTINCT doc_id, translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM {docs})
      ) WHERE length(k) >= 1
    ) WHERE n >= 10 GROUP BY doc_id
  ) f ON f.doc_id IS NOT DISTINCT FROM d.doc_id
)
"""

ORACLE = {"op2_line_dedup": "SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM (" + LINES_SQL.format(docs="documents") + ")"}
QUERIES = {"op2_line_dedup": op2_line_dedup}
