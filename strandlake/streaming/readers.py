"""Partitioned line streams: which reader gets which line, by stride, by file, or by the line's first byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import numbered, running_sum

#: Parts whose totals are broadcast at most.
MOST_PARTS = 100_000


def partition_of(world: int, workers: int) -> int:
    """Partitions in all; rank r's worker w is partition r * workers + w."""
    if world < 1 or workers < 1:
        raise ValueError("world and workers are positive")
    return world * workers


def line_stride(lines: DataFrame, index: str, world: int, workers: int) -> DataFrame:
    """part: the line's index modulo the partitions; blank lines count."""
    return lines.withColumn("part", F.pmod(F.col(index), F.lit(partition_of(world, workers))).cast("int"))


def file_shard(lines: DataFrame, file_index: str, index: str, world: int, workers: int) -> DataFrame:
    """part: files by rank, lines of a file by worker."""
    rank = F.pmod(F.col(file_index), F.lit(world))
    return lines.withColumn("part", (rank * workers + F.pmod(F.col(index), F.lit(workers))).cast("int"))


def _places(lines: DataFrame, file: str, index: str, text: str) -> DataFrame:
    """_f, _t: the line's first byte in its file, and the file's bytes; a file of any size is many tasks."""
    size = F.octet_length(text) + 1
    total = lines.groupBy(file).agg(F.sum(size).alias("_t"))
    return running_sum(lines, [index], size, "_f", [file]).join(total, file)


def byte_range(lines: DataFrame, file: str, index: str, text: str, world: int, workers: int) -> DataFrame:
    """part: the range of equal bytes of the file that holds the line's first byte. Lines end with one byte each."""
    n = partition_of(world, workers)
    # Range p is [total * p // n, total * (p + 1) // n).
    return _places(lines, file, index, text).withColumn("part", F.floor(((F.col("_f") + 1) * n - 1) / F.col("_t")).cast("int")).drop("_f", "_t")


def file_shard_from(lines: DataFrame, file: str, index: str, text: str, world: int, workers: int, start_fraction: float) -> DataFrame:
    """Lines whose first byte is at or after this fraction of their file, with part: files by rank, the lines left by worker."""
    if not 0 <= start_fraction < 1:
        raise ValueError("start_fraction is at least 0 and below 1")
    left = _places(lines, file, index, text).where(F.col("_f") >= F.floor(F.col("_t") * start_fraction)).drop("_f", "_t")
    line = F.col("_line") - 1
    return numbered(left, [index], "_line", [file]).withColumn("part", (F.pmod(F.col(file), F.lit(world)) * workers + F.pmod(line, F.lit(workers))).cast("int")).drop("_line")


READERS = ("line-stride", "file-shard", "byte-range")


def dealt(lines: DataFrame, reader: str, file: str, index: str, text: str, world: int, workers: int, start_fraction: float = 0.0) -> DataFrame:
    """Lines with their part, by the named reader. Only the file-shard reader can begin within a file."""
    if reader not in READERS:
        raise ValueError(f"unknown reader {reader}; one of {', '.join(READERS)}")
    if start_fraction and reader != "file-shard":
        raise ValueError("only the file-shard reader has a start_fraction")
    if reader == "line-stride":
        return line_stride(lines, index, world, workers)
    if reader == "byte-range":
        return byte_range(lines, file, index, text, world, workers)
    return file_shard_from(lines, file, index, text, world, workers, start_fraction) if start_fraction else file_shard(lines, file, index, world, workers)


def epochs(lines: DataFrame, part: str, index: str, partitions: int, seed: int, buffer: int, skip: int, cap: int | None, passes: int) -> DataFrame:
    """What each part reads in `passes` passes: epoch, place (from 0, over all passes).

    A pass is shuffled by a sliding buffer of `buffer` lines, with a seed that the part and the pass pick. The global skip
    is split over parts and applied after the shuffle, then the global cap.
    """
    from ..operators.topk import ceil_share
    from .shuffle import sliding_shuffle

    rows = numbered(lines, [index], "_i", [part]).withColumn("_i", F.col("_i") - 1)
    totals = lines.groupBy(part).agg(F.count("*").alias("_n"))  # a row a part
    rows = rows.join(F.broadcast(totals), part) if partitions <= MOST_PARTS else rows.join(totals, part)
    every = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    drawn = sliding_shuffle(every, [part, "epoch"], "_i", buffer, F.lit(seed) + F.col(part) + F.col("epoch") * partitions, F.col("_n"), "_place")
    left = F.lit(skip // partitions) + F.when(F.col(part) < skip % partitions, 1).otherwise(0)
    rows = drawn.withColumn("place", (F.col("epoch") * F.col("_n") + F.col("_place") - left).cast("long")).where("place >= 0")
    rows = rows if cap is None else rows.where(F.col("place") < ceil_share(cap, partitions))
    return rows.drop("_i", "_n", "_place")


def check_partitions(files: int, world: int, reader: str) -> None:
    """A file-shard reader with fewer files than ranks would starve some."""
    if reader == "file-shard" and files < world:
        raise ValueError(f"{files} files can't feed {world} ranks")


def stream_lines(spark: SparkSession, folder: str, world: int, workers: int, files_per_batch: int = 16) -> DataFrame:
    """A structured stream of a folder's text lines that aren't blank, dealt to partitions by a hash of file and line."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    lines = raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.length(F.regexp_replace("line", r"\s", "")) > 0)
    return lines.withColumn("part", F.pmod(F.xxhash64("file", "line"), F.lit(partition_of(world, workers))).cast("int"))
