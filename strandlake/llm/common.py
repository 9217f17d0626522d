"""Helpers that the training-data operators share: lineage cuts, Arrow batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`, as characters. bytes.split() and bytes.strip() without arguments use the same six.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a batch for Python at most; long texts make Spark cut batches by bytes as well.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: what follows survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles and checkpoints that nothing refers to any more, before the next ones are written."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Python workers get a few MB at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null gives b''."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Rows that are sorted by their first `keys` columns (numbers) -> the columns of each group, whatever batches it spans."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new = np.zeros(b.num_rows, bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or any(c[0] != h[-1] for c, h in zip(cols[:keys], held[-1][:keys], strict=True))
        at = np.flatnonzero(new).tolist()
        if not at:
            held.append(cols)
            continue
        if at[0] > 0:
            held.append([c[: at[0]] for c in cols])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
        for i, j in zip(at, at[1:], strict=False):
            yield [c[i:j] for c in cols]
        held = [[c[at[-1] :] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows that are sorted by their first `keys` columns (numbers) -> columns of many whole groups, their begins and sizes."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = np.concatenate([[0], np.flatnonzero(new)])
        if at[-1]:
            yield [c[: at[-1]] for c in cols], at[:-1], np.diff(at)
        held = [c[at[-1] :] for c in cols]
    if held is not None:
        yield held, np.array([0]), np.array([len(held[0])])


#: Rows of numbers that are broadcast at most; with more, both sides are shuffled.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder, and broadcast to what it is joined with if its counted rows are few enough."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def packed(work, rows: int = 50_000):
    """work, with its small output batches joined to larger ones."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in work(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def lowered(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(src, dst) links between longs -> (id, component_id), the smallest id that is reachable; ids without links are absent.

    Alternating large and small stars: each round makes every node point at smaller ones, with aggregates that are
    combined before the shuffle and joins that adaptive execution can split, and keeps the edges in the shared
    folder. Nothing is collected but one number a round. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
