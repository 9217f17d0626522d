"""FASTA in several tolerances, aligned FASTA, annotated headers. Text is read and split by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

SUFFIXES = ("fa", "fasta", "fna")
#: Blocks of files (a row each, with the file's name) that are broadcast at most.
BROADCAST_BLOCKS = 100_000


def _glob() -> str:
    """Suffixes in any case, gzipped or not."""
    either = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
    return "{" + ",".join(f"*.{either(s)}{z}" for s in SUFFIXES for z in ("", f".{either('gz')}")) + "}"


def discovered(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """file: sequence files at or below the paths, each once however many paths lead to it. Suffixes count in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _glob()).load(paths)
    return files.select(F.col("path").alias("file")).distinct()


def lines(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """file, record (from one; 0: what stands before the first header), text: a file's records, cut at line begins with '>'
    by Spark's own reader, so large files are read by many tasks. Files may be gzipped. Only file names end in SUFFIXES count.

    A block of a file is one task's, and its rows have successive numbers. So a record's place is what the blocks before hold,
    from one aggregate with a row a block, and its number less its block's first: no text is shuffled.
    """
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _glob()).text(paths, lineSep="\n>")
    # The reader takes the '>' away from all records but one at a file's very begin.
    raw = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    blocks = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.min_by(F.col("value").startswith(">"), "row").alias("named"))
    head = ((F.col("block") == 0) & ~F.col("named")).cast("int")
    before = F.sum(F.col("n") - head).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = checkpointed(blocks.select("file", "block", "first", head.alias("head"), F.coalesce(before, F.lit(0)).alias("before")))
    small = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
    placed = raw.join(small, ["file", "block"])
    record = F.col("before") + F.col("row") - F.col("first") + 1 - F.col("head")
    marked = F.when((F.col("head") == 1) & (F.col("row") == F.col("first")), F.col("value")).when(F.col("value").startswith(">"), F.col("value")).otherwise(F.concat(F.lit(">"), "value"))
    return placed.select("file", record.alias("record"), marked.alias("text"))


def records(rows: DataFrame, comments: str | None = None) -> DataFrame:
    """file, record, header (null for what stands before the first), sequence (lines joined). comments: lines that begin
    with one of these signs go."""
    text = F.col("text") if comments is None else F.regexp_replace("text", f"(?m)^[{comments}].*$", "")
    got = rows.select("file", "record", F.col("text").startswith(">").alias("named"), text.alias("text"))
    head = F.when(F.col("named"), F.regexp_replace(F.substr(F.substring_index("text", "\n", 1), F.lit(2)), "\r$", ""))
    body = F.when(F.col("named"), F.when(F.instr("text", "\n") > 0, F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise("")).otherwise(F.col("text"))
    return got.select("file", "record", head.alias("header"), F.regexp_replace(body, r"\s", "").alias("sequence")).where("header is not null or sequence <> ''")


def raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records as they stand, without any change to their letters."""
    return records(lines(spark, paths))


def single(spark: SparkSession, path: str) -> str:
    """The one sequence of a file; several records or none are an error. For small files: it is read to the driver."""
    got = raw(spark, path).select("sequence").limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"{path} holds no single record")
    return got[0][0]


def tolerant(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_index (from one, by path), record, sequence: upper case, U as T; a body before any header is kept, empty ones go."""
    got = raw(spark, paths).withColumn("sequence", F.translate(F.upper("sequence"), "U", "T")).where("sequence <> ''")
    # One row a file: the order over all files is small.
    index = got.select("file").distinct().withColumn("file_index", F.row_number().over(Window.orderBy("file")))
    return got.join(index, "file").select("file_index", "file", "record", "sequence")


def strict_faults(rows: DataFrame) -> DataFrame:
    """records() -> record_id, fault: body before a header, empty header, empty body, repeated id. Nothing if all is well."""
    named = rows.withColumn("record_id", F.split("header", r"\s+")[0])
    one = F.when(F.col("header").isNull(), F.when(F.col("sequence") != "", "body_before_header")).when(F.trim("header") == "", "empty_header").when(F.col("sequence") == "", "empty_body")
    single = named.select("record_id", one.alias("fault")).where("fault is not null")
    twice = named.where("header is not null").groupBy("record_id").count().where("count > 1").select("record_id", F.lit("duplicate_id").alias("fault"))
    return single.unionByName(twice)


def strict(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """record_id, description, sequence; comment lines (# and ;) go; any fault is an error when rows are read."""
    rows = records(lines(spark, paths), "#;")
    faults = strict_faults(rows).agg(F.first(F.concat_ws(": ", "fault", "record_id")).alias("_fault"))
    good = rows.where("header is not null")
    ok = F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault"))).otherwise(F.split("header", r"\s+")[0])
    return good.join(F.broadcast(faults)).select(ok.alias("record_id"), F.regexp_replace("header", r"^\S+\s*", "").alias("description"), "sequence")  # one row


def aligned(rows: DataFrame) -> DataFrame:
    """records() with '.' as '-', upper case, and whether all lengths agree."""
    n = F.countDistinct
    got = rows.where("header is not null").select(F.split("header", r"\s+")[0].alias("record_id"), F.upper(F.translate("sequence", ".", "-")).alias("aligned"))
    widths = got.agg((n(F.length("aligned")) == 1).alias("equal_length"), (n("record_id") == F.count("*")).alias("unique_ids"))
    return got.join(F.broadcast(widths))  # one row


def parse(text: Column) -> Column:
    """A text's records as an array of (record_id, sequence): for small texts in a column."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n>"), lambda p, i: i > 0)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S*)", 1).alias("record_id"), F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"\s", "").alias("sequence")))


def wrapped(record_id: Column, sequence: Column, width: int = 80) -> Column:
    """A record as FASTA text with lines of `width` letters."""
    return F.concat(F.lit(">"), record_id, F.lit("\n"), F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), r"\n$", ""))
