"""Embedding near-duplicates: a small-world graph for each shard, every shard searched, cosine verified, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hnsw import Graph

COSINE = 0.95
#: Shards at least; bytes of a shard's vectors at about most (more vectors make more shards); first beam; recall that audits ask.
SHARDS, SHARD_BYTES, BEAM, RECALL = 8, 256 << 20, 48, 0.995
#: Bytes of the queries that a task holds while it goes through all shards' graphs.
QUERY_BYTES = 128 << 20


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, key (the components as float64 bytes; null if the vector links with nothing)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[bytes | None] = []
            for x in b.column(1):
                v = None if x.as_py() is None else np.array(x.values.to_numpy(zero_copy_only=False), float)
                fit = v is not None and len(v) and not x.values.null_count and np.isfinite(v).all() and v.any()
                keys.append((v + 0.0).tobytes() if fit else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return rows.mapInArrow(work, "vec_id long, key binary")


def _unit(keys: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(keys), float).reshape(len(keys), -1)
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, shards: int = SHARDS, audits: list | None = None) -> DataFrame:
    """vec_id, embedding -> vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors link if their cosine in double precision is `cosine` or more. Each row gives a row. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, nor do rows without vec_id; vectors of
    different length don't link with each other. Rows that repeat a vec_id are vectors of their own.

    Copies are one class, found by their bytes and combined before the shuffle, so a group of copies of any size is one
    node with a count. Classes are dealt to shards by hash, each with a task of its own, which builds the graph and writes
    it to the shared folder. Every class is then searched in every shard, where it is (the graphs travel, a shard at a
    time, not the queries; a task holds QUERY_BYTES of queries meanwhile, so graphs are read once for so many). A search
    whose beam is full of links runs again with a wider one, in the end against all nodes, so no link is capped; audits
    compare a bounded number of a task's queries with all nodes of the shard and widen all beams until RECALL is reached, in
    the end by comparing all. A vector that links with one node of a shard's group (nodes that verified links of the graph
    connect) is compared exactly with the whole group, so links are counted from both ends. Of a task's links only those that connect something new go on to the components; the others are counted.

    audits: gets the number of links that audits looked for and of those found. An empty table gives an empty one; other
    columns are ignored. Searching all vectors in all shards is work that grows with vectors times shards: the method's own cost.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = common.cut(packed_vectors(vectors).withColumn("h", F.unhex(F.md5("key"))))
    fit = rows.where("key is not null and vec_id is not null")
    classes = common.cut(fit.groupBy("h").agg(F.first("key").alias("key"), F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    shards = max(shards, -(-(classes.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // SHARD_BYTES))
    folder = common.scratch(spark, "hnsw")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        groups: dict[tuple[int, int], list] = {}
        for b in batches:
            for s, k, r, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.setdefault((s, len(k)), []).append((r, n, k))
        store, root = fs.FileSystem.from_uri(folder)
        done = []
        for (s, width), got in sorted(groups.items()):
            got.sort(key=lambda x: x[0])
            store.create_dir(root, recursive=True)
            # A task that runs again writes the same bytes under the same name.
            name = f"{root}/{s}-{width}"
            with store.open_output_stream(name + ".graph", compression=None) as f:
                f.write(Graph(_unit([k for *_, k in got])).dump())
            with store.open_output_stream(name + ".ids", compression=None) as f:
                f.write(np.array([(r, n) for r, n, _ in got], np.int64).tobytes())
            done.append((f"{folder}/{s}-{width}", width, len(got)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "width", "n"])

    dealt = classes.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("s"), "key", "node", "n").repartitionById(shards, F.col("s").cast("int"))
    built = common.cut(dealt.mapInArrow(build, "path string, width long, n long"))
    graphs = sorted((r["path"], r["width"]) for r in built.collect())  # one short row a shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def found(keys: list[bytes], reps: np.ndarray) -> pa.RecordBatch:
            links = np.zeros(len(keys), np.int64)
            src, dst, audit = [], [], np.zeros(2, np.int64)
            widths = np.fromiter(map(len, keys), np.int64, len(keys))
            for path, width in graphs:
                at = np.flatnonzero(widths == width)
                if not len(at):
                    continue
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name + ".graph", compression=None) as f:
                    g = Graph.load(f.read())
                with store.open_input_stream(name + ".ids", compression=None) as f:
                    ids, weight = np.frombuffer(f.read(), np.int64).reshape(-1, 2).T
                by = np.argsort(ids)
                place = np.minimum(np.searchsorted(ids, reps[at], sorter=by), len(ids) - 1)
                own = np.where(ids[by[place]] == reps[at], by[place], -1)
                count, a, b, seen = g.search(_unit([keys[k] for k in at]), own, weight, cosine, BEAM, RECALL)
                links[at] += count
                audit += seen
                src.append(reps[at[a]]), dst.append(ids[b])
            src, dst = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (src, dst))
            n, m = len(keys), len(src)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(reps), pa.array(src), pa.nulls(1, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(dst), pa.nulls(1, pa.int64())]),
                    pa.concat_arrays([pa.array(links), pa.nulls(m + 1, pa.int64())]), pa.concat_arrays([pa.nulls(n + m, pa.int64()), pa.array(audit[:1])]), pa.concat_arrays([pa.nulls(n + m, pa.int64()), pa.array(audit[1:])]),
                ], ["node", "other", "links", "audited", "audited_found"],
            )

        keys: list[bytes] = []
        reps: list[int] = []
        size = 0
        for b in batches:
            keys += b.column(0).to_pylist()
            reps += b.column(1).to_pylist()
            size += b.column(0).nbytes
            if size >= QUERY_BYTES:
                yield found(keys, np.array(reps, np.int64))
                keys, reps, size = [], [], 0
        if keys:
            yield found(keys, np.array(reps, np.int64))

    spread = classes.select("key", "node").repartition(max(12, spark.sparkContext.defaultParallelism), F.xxhash64("node"))
    got = common.cut(spread.mapInArrow(search, "node long, other long, links long, audited long, audited_found long"))
    common.remove(spark, folder)
    if audits is not None:
        audits.append(tuple(got.agg(F.coalesce(F.sum("audited"), F.lit(0)), F.coalesce(F.sum("audited_found"), F.lit(0))).first()))
    roots = common.components(got.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    linked = got.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("h", "node", "least", "n").join(linked, "node").join(roots.select(F.col("id").alias("node"), F.col("component_id").alias("root")), "node", "left")
    firsts = known.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(firsts, "root", "left").select("h", (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = fit.join(known, "h").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op9_embedding": op9_embedding}
