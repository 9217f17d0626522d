"""A line stream that stops and goes on: Spark's checkpoint of offsets, and a state document that says where it stands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..sources.sinks import exists
from .readers import stream_lines
from .state import State, load, resume, save

_STOP = "the run's share of batches is done"


def corpus_sha256(spark: SparkSession, folder: str) -> str:
    """The identity of a folder's files: their number, names and sizes, whatever the order. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "length")
    one = F.xxhash64("name", "length").cast("decimal(38,0)")
    return files.agg(sha256(F.concat_ws("|", F.count("*").cast("string"), F.sum("length").cast("string"), F.sum(one).cast("string")))).first()[0]


def run_lines(spark: SparkSession, folder: str, out: str, work: str, world: int, workers: int, files_per_batch: int = 16, most_batches: int | None = None, corpus: int = 0, after_write: Callable[[int], None] | None = None) -> State:
    """Goes through a folder's lines to out/batch=<id> (part, file, line), from where the last run with the same `work` folder
    stopped, and returns the state then.

    Offsets are Spark's (work/offsets): a batch that was cut off runs again with the same files and the same id, and
    writes the same folder anew, so each line is there once. The state (work/state.json) advances once a batch:
    its cursor is the number of lines so far. Another topology (world, workers) or other files than those of the first run
    are an error, before anything is read. most_batches: batches of this run at most; corpus: lines of a pass, if known.
    """
    path, manifest = f"{work}/state.json", corpus_sha256(spark, folder)
    if exists(spark, path):
        old = load(spark, path)
        at = resume(None, old, old.global_step, old.batch, world=world, workers=workers, manifest_sha256=manifest)
        state = replace(old, resume_step=old.global_step, resume_cursor=at, resume_source="state", consumed_since_resume=0)
    else:
        state = State(1, 0, 0, files_per_batch, world, workers, corpus, manifest, manifest_path=folder)
        save(spark, path, state)
    first = state.global_step
    held = [state]

    def batch(df: DataFrame, number: int) -> None:
        if most_batches is not None and number >= first + most_batches:
            raise RuntimeError(_STOP)
        now = held[0]
        at = f"{out}/batch={number}"
        df.select("part", "file", "line").write.mode("overwrite").parquet(at)
        if after_write:
            after_write(number)
        if number >= now.global_step:  # else the state was saved before the batch was cut off
            cursor = now.cursor + spark.read.parquet(at).count()
            known = {"corpus_pass": cursor // corpus, "corpus_offset": cursor % corpus} if corpus else {}
            held[0] = replace(now, global_step=number + 1, cursor=cursor, consumed_since_resume=cursor - now.resume_cursor, created_at=datetime.now(UTC).isoformat(), **known)
            save(spark, path, held[0])

    lines = stream_lines(spark, folder, world, workers, files_per_batch)
    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{work}/offsets").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _STOP not in str(e):
            raise
    return held[0]
