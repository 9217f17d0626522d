"""Pareto frontiers by sorting: frontiers of ranges, then whole blocks of them ruled out by their corners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Frontier vectors that travel as one block, and vectors that are compared at a time.
BLOCK = 512


def _undominated(v: np.ndarray, frontier: np.ndarray) -> np.ndarray:
    """Which of v no vector of the frontier dominates; all vectors differ."""
    out = np.ones(len(v), bool)
    for i in range(0, len(frontier), BLOCK):
        at = np.flatnonzero(out)
        if not len(at):
            break
        out[at] = ~(frontier[None, i : i + BLOCK] <= v[at][:, None]).all(2).any(1)
    return out


def _frontier(v: np.ndarray) -> np.ndarray:
    """Places of the undominated among different vectors in lexicographic order: only earlier ones can dominate."""
    kept: list[int] = []
    for i in range(0, len(v), BLOCK):
        part = v[i : i + BLOCK]
        at = np.flatnonzero(_undominated(part, v[kept]))
        le = (part[at][None] <= part[at][:, None]).all(2)
        np.fill_diagonal(le, False)
        kept += (i + at[~le.any(1)]).tolist()
    return np.array(kept, int)


def frontier(vectors: DataFrame, group: list[str], minimize: list[str]) -> DataFrame:
    """The undominated among each group's different vectors of objectives (numbers, all less is better; rows with a null
    or NaN objective dominate nothing and are on no frontier).

    Vectors are dealt to ranges of (group, objectives) and sorted. There a vector can only be dominated by an earlier one, so
    each range keeps its own frontier as it reads, whatever the size of a group; no task sees a group. Range frontiers
    become blocks of BLOCK vectors with their corners (the least of each objective); a vector is compared with a block of an
    earlier range only if the block's corner dominates it, so blocks that can't rule it out are skipped whole. Comparing is
    linear in the rows for frontiers that are small, and grows with the frontier where it is large.
    """
    g = F.struct(*group) if group else F.struct(F.lit(0))
    rows = vectors.select(*group, *minimize).dropna(subset=minimize).distinct()
    rows = rows.select(F.to_json(g).alias("g"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(minimize)])
    names = [f"m{k}" for k in range(len(minimize))]
    for n in names:
        rows = rows.where(~F.isnan(n))
    ranged = rows.repartitionByRange("g", *names).sortWithinPartitions("g", *names).withColumn("part", F.spark_partition_id())
    d = len(names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held = None, np.zeros((0, d))
        part = None

        def blocks() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(held), BLOCK):
                v = held[i : i + BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held_g]), pa.array([part], pa.int32()), pa.array([v.ravel().tolist()], pa.list_(pa.float64())), pa.array([v.min(0).tolist()], pa.list_(pa.float64()))], ["g", "part", "v", "corner"],
                )

        for b in batches:
            if not b.num_rows:
                continue
            gs = b.column(0).to_pylist()
            v = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(d)], 1)
            part = b.column(1 + d)[0].as_py()
            at = [0, *[i for i in range(1, len(gs)) if gs[i] != gs[i - 1]], len(gs)]
            for i, j in zip(at, at[1:], strict=False):
                if gs[i] != held_g:
                    yield from blocks()
                    held_g, held = gs[i], np.zeros((0, d))
                new = v[i:j]
                new = new[_undominated(new, held)]
                held = np.concatenate([held, new[_frontier(new)]])
        yield from blocks()

    blocks = checkpointed(ranged.mapInArrow(local, "g string, part int, v array<double>, corner array<double>"))
    dominates = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda ok: ok)
    # Blocks meet blocks first: by their corners, a block that no earlier corner reaches at all is done.
    far = blocks.select("g", F.col("part").alias("p2"), F.col("v").alias("v2"), F.col("corner").alias("c2"))
    most = blocks.select("*", F.array(*[F.array_max(F.transform(F.sequence(F.lit(k), F.size("v") - 1, F.lit(d)), lambda i: F.get("v", i))) for k in range(d)]).alias("top"))
    pairs = most.join(far, "g").where((F.col("p2") < F.col("part")) & dominates(F.col("c2"), F.col("top"))).select("g", "part", "v", "v2", "c2")

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g_, v, v2, c2 in zip(*(b.column(k) for k in (0, 2, 3, 4)), strict=True):
                a, f, c = (np.array(x.values.to_numpy(zero_copy_only=False)).reshape(-1, d) for x in (v, v2, c2))
                a = a[(c <= a).all(1)]
                a = a[~_undominated(a, f)]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([g_.as_py()] * len(a)), *[pa.array(a[:, k]) for k in range(d)]], ["g", *names])

    fields = ", ".join(f"{n} double" for n in names)
    gone = pairs.mapInArrow(beaten, f"g string, {fields}").distinct()
    at = F.transform(F.sequence(F.lit(0), F.size("v") - 1, F.lit(d)), lambda i: F.struct(*[F.get("v", i + k).alias(n) for k, n in enumerate(names)]))
    kept = blocks.select("g", F.explode(at).alias("x")).select("g", "x.*").join(gone, ["g", *names], "left_anti")
    kinds = dict(vectors.dtypes)
    back = F.from_json("g", ", ".join(f"`{c}` {kinds[c]}" for c in group) or "`0` int")
    return kept.select(*[back[c].alias(c) for c in group], *[F.col(n).cast(kinds[c]).alias(c) for n, c in zip(names, minimize, strict=True)])


def pareto(df: DataFrame, group: list[str], minimize: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best of each group: the Pareto frontier first, in order, then the others in order; copies stand together."""
    best = frontier(df, group, minimize).withColumn("on_frontier", F.lit(True))
    rows = df.join(best, [*group, *minimize], "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("on_frontier"), *order))
    return rows.withColumn("place", rn).where(F.col("place") <= k)
