"""Cursors of resumable streams: where a run stands, and how the next one resumes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_document, write_document


@dataclass(frozen=True)
class State:
    version: int
    global_step: int
    cursor: int
    batch: int
    world: int
    workers: int
    corpus: int
    manifest_sha256: str
    resume_step: int = 0
    resume_cursor: int = 0
    consumed_since_resume: int = 0
    resume_source: str = "start"
    resume_mode: str = "exact-replay"
    reader: str = "line-stride"
    shuffle_buffer: int = 0
    shuffle_seed: int = 0
    manifest_path: str | None = None
    corpus_pass: int | None = None
    corpus_offset: int | None = None
    created_at: str = ""


def effective_batch(per_device: int, devices: int, accumulation: int) -> int:
    return per_device * devices * accumulation


def cursor(steps: DataFrame, step: str, start: int, start_step: int, batch: int, corpus: int) -> DataFrame:
    """cursor, and the pass over the corpus and the place in it."""
    c = F.lit(start) + (F.col(step) - start_step) * batch
    return steps.withColumn("cursor", c).withColumn("pass", F.floor(c / corpus).cast("long")).withColumn("at", c % corpus)


def resume(override: int | None, state: State | None, step: int, batch: int, *, world: int, workers: int, manifest_sha256: str) -> int:
    """The cursor to go on from: what is asked for, else the state's, else step * batch. Another topology or corpus is an error."""
    if override is not None:
        return override
    if state is None:
        return step * batch
    if (state.world, state.workers) != (world, workers):
        raise ValueError("the state was written by another topology")
    if state.manifest_sha256 != manifest_sha256:
        raise ValueError("the state belongs to another corpus")
    return state.cursor + (step - state.global_step) * batch


def advanced(state: State, step: int, created_at: str) -> State:
    """The state after training to a step: cursor, what was consumed since the last resume, pass and offset in the corpus."""
    at = state.cursor + (step - state.global_step) * state.batch
    known = state.corpus > 0
    return replace(state, global_step=step, cursor=at, consumed_since_resume=at - state.resume_cursor, corpus_pass=at // state.corpus if known else None, corpus_offset=at % state.corpus if known else None, created_at=created_at)


def save(spark: SparkSession, path: str, state: State) -> None:
    """Written beside and moved into place, on whatever file system the path names."""
    write_document(spark, path, asdict(state))


def load(spark: SparkSession, path: str) -> State:
    got = json.loads(read_document(spark, path))
    if got.get("version") != 1:
        raise ValueError("unknown version of the state")
    return State(**got)


def manifest_sha256(manifest: dict, timing: tuple[str, ...] = ("created_at", "elapsed_seconds")) -> str:
    """Of a shard manifest without its timing."""
    kept = {k: v for k, v in manifest.items() if k not in timing}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
