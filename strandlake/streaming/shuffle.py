"""Sliding-buffer shuffle: a line leaves the buffer when its slot is drawn for a later one. As a window, and on a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.hashing import sha256
from ..operators.windows import numbered


def _digest(*parts: Column) -> Column:
    """The first 60 bits of SHA-256 of the parts, joined by colons."""
    return F.conv(F.substr(sha256(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(1), F.lit(15)), 16, 10).cast("long")


def digest_of(*parts: object) -> int:
    """The same as _digest(), in Python."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def sliding_shuffle(df: DataFrame, keys: list[str], index: str, buffer: int, seed: Column, total: Column, name: str = "place") -> DataFrame:
    """df with name: each row's place (from 0) after a shuffle by a buffer of so many rows.

    index: the row's place within keys, from 0; total: rows of its keys. The first `buffer` rows fill the slots; each
    later one is put in the slot that a draw from (seed, index) picks, and the row that was there comes out. What is left at
    the end comes out in the order of draws from (seed, "end", index). So a row may come out any time later.

    A row in a slot comes out when the slot is next drawn: its successor within the slot. So no loop is needed: a
    slot is a group, of some total / buffer rows, and only the at most `buffer` rows that are left at the end are sorted
    together.
    """
    if buffer <= 1:
        return df.withColumn(name, F.col(index).cast("long"))
    drawn = F.pmod(_digest(seed, F.col(index)), F.lit(buffer))
    rows = df.withColumn("_slot", F.when(F.col(index) < buffer, F.col(index)).otherwise(drawn))
    rows = rows.withColumn("_out", F.lead(index).over(Window.partitionBy(*keys, "_slot").orderBy(index)))
    last = rows.where("_out is null").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(_digest(seed, F.lit("end"), F.col(index)), index)))
    last = last.withColumn(name, (total - F.least(total, F.lit(buffer)) + F.col("_r") - 1).cast("long")).drop("_r")
    gone = rows.where("_out is not null").withColumn(name, (F.col("_out") - buffer).cast("long"))
    return gone.unionByName(last).drop("_slot", "_out")


def shuffled(df: DataFrame, keys: list[str], order: str, buffer: int, seed: int, name: str = "place") -> DataFrame:
    """sliding_shuffle() of rows in their order within keys."""
    rows = numbered(df, [order], "_i", keys).withColumn("_i", F.col("_i") - 1)
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sliding_shuffle(rows.join(total, keys), keys, "_i", buffer, F.lit(seed), F.col("_n"), name).drop("_i", "_n")


class Reservoir(StatefulProcessor):
    """The buffer of one part of a stream: its slots, and how many lines have come so far."""

    def __init__(self, buffer: int, seed: int):
        self.buffer, self.seed = buffer, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.slots = handle.getMapState("slots", "slot long", "at long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Lines of a micro-batch in order of `at`; a null line is the end mark, which lets out what is left."""
        came = pd.concat(list(rows)).sort_values("at")
        n, out, end = (self.count.get()[0] if self.count.exists() else 0), [], False
        for at, line in came[["at", "line"]].itertuples(index=False):
            if line is None or line != line:
                end = True
                continue
            if self.buffer <= 1:
                out.append((n, int(at), line))
            else:
                slot = n if n < self.buffer else digest_of(self.seed + key[0], n) % self.buffer
                if n >= self.buffer:
                    out.append((n - self.buffer, *self.slots.getValue((slot,))[:2]))
                self.slots.updateValue((slot,), (int(at), line))
            n += 1
        self.count.update((n,))
        if end and self.buffer > 1:
            left = sorted((digest_of(self.seed + key[0], "end", v[0]), *v) for v in self.slots.values())
            out += [(n - len(left) + k, at, line) for k, (_, at, line) in enumerate(left)]
            self.slots.clear()
            self.count.clear()
        if out:
            place, at, line = zip(*out, strict=True)
            yield pd.DataFrame({"part": [key[0]] * len(out), "place": place, "at": at, "line": line})

    def close(self) -> None:
        pass


def stream_shuffle(lines: DataFrame, buffer: int, seed: int) -> DataFrame:
    """A stream of part, at (the line's place in its part, rising), line -> part, place, at, line as they leave the buffer.

    The buffer is Spark's state of the part, so a query that is stopped goes on with the buffer that it had, and memory
    holds a buffer a part. A row with a null line ends its part. The session needs the RocksDB state store.
    """
    return lines.groupBy("part").transformWithStateInPandas(Reservoir(buffer, seed), "part int, place long, at long, line string", "Append", "None")
