"""Conversation prefix trie: partial node tables of partitions, merged by hashed keys, rolled up from the ends of the paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A conversation borrows fewer than HEAD turns from the first of its BLOCK conversations.
HEAD, BLOCK = 9, 5
#: Partial node tables that a node's members are first merged into.
PARTS = 16
#: End lists travel as pieces of so many ids at most.
PIECE = 4096
_NODE = ["depth", "k1", "k2"]


def carried(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """df and running values within key, each row included: sums, and exclusive-ors of longs.

    Rows are dealt to ranges of (key, order), so a key of any size is split. What earlier ranges hold of a key is
    carried over by a table that has a row at most for each range, which is its proven bound for the broadcast.
    """
    xors = xors or {}
    values = {**sums, **xors}
    rows = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()]).repartitionByRange(F.col(key), *order)
    rows = common.cut(rows.withColumn("_part", F.spark_partition_id()))
    plus = lambda n, c: F.bit_xor(c) if n in xors else F.sum(c)
    parts = rows.groupBy(key, "_part").agg(*[plus(n, f"_v_{n}").alias(f"_c_{n}") for n in values])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(key, "_part", *[plus(n, f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in values]).where(F.col(f"_c_{next(iter(values))}").isNotNull())
    within = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[plus(n, f"_v_{n}").over(within).alias(f"_w_{n}") for n in values]).join(F.broadcast(carry), [key, "_part"], "left")
    full = {n: F.col(f"_w_{n}").bitwiseXOR(F.coalesce(f"_c_{n}", F.lit(0))) if n in xors else F.col(f"_w_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in values}
    return rows.select(*df.columns, *[c.alias(n) for n, c in full.items()])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, role, text -> the rebuilt conversations' turns (conv_id, depth from one, content, n_bytes of the
    text), and all conversations (conv_id, n_turns after rebuilding).

    A conversation c takes the first h turns of conversation c - c % BLOCK, h = crc32(c as text) % HEAD, then its own
    turns after its first h. content is the digest of role and text; no text is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.where("conv_id is not null")
    rows = common.cut(carried(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")], {"place": F.lit(1).cast("long")}).drop("turn", "role"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("long")
    first = sizes.select(F.col("conv_id").alias("first_id"), F.col("n").alias("n_first"))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first_id")).join(first, "first_id", "left")
    convs = common.cut(convs.select("conv_id", "first_id", "n", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken")))
    heads = rows.where((F.col("place") < HEAD) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "first_id")
    heads = convs.select("conv_id", "first_id", "taken").join(heads, "first_id").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "content", "n_bytes")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "content", "n_bytes")
    return heads.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, conv_id -> depth, k1, k2, ends_sha256: of the ids in ascending order, joined by commas.

    Ids are sorted in ranges, so a node's list of any length is split; tasks join them to pieces, and only pieces meet,
    in order, where the digest takes them one at a time. No list is ever whole.
    """
    common.small_batches(ends.sparkSession)
    ranged = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").select(*_NODE, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            new = np.ones(b.num_rows, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            at = np.flatnonzero(new)
            # A long list's pieces are cut by size as well.
            at = np.unique(np.concatenate([at, *[np.arange(i, j, PIECE) for i, j in zip(at, [*at[1:], b.num_rows], strict=True) if j - i > PIECE]]))
            ids = [str(x) for x in cols[3].tolist()]
            joined = [",".join(ids[i:j]) for i, j in zip(at.tolist(), [*at[1:].tolist(), b.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols] + [pa.array(joined)], [*_NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sha = None
        for b in batches:
            out = []
            for d, k1, k2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (d, k1, k2) == held:
                    sha.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((*held, sha.hexdigest()))
                held, sha = (d, k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*_NODE, "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, sha.hexdigest())], [*_NODE, "ends_sha256"])

    piece = ranged.mapInArrow(pieces, "depth long, k1 long, k2 long, first long, ids string")
    return piece.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> a row for each node of the prefix trie of the rebuilt conversations: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node's key is the exclusive-or of two 64-bit hashes of (depth, content) along its path, 128 bits; a conversation's
    keys are running values, so a conversation of any length is split. Each partition combines its members of a node
    (Spark's aggregation before the shuffle), partial tables are merged by (node, part) and then by node: members are
    counted, the smallest kept; end lists are merged as sorted pieces.

    The rollup goes up each path once, however deep the trie: a node belongs to its smallest member, whose nodes are the
    lower end of its path; values are summed from that end up, and what a conversation's own nodes hold counts for each
    node above them on its path. So one aggregate by node adds up all subtrees.

    Turns go by turn (null first), ties by role, then by the digest of role and text; repeated rows are repeated turns.
    Null roles and texts are empty. Rows without conv_id take no part. Without conversations there are no nodes.
    A very long text is hashed where it is read. Other columns are ignored.
    """
    rebuilt, convs = rebuilt_turns(turns)
    steps = rebuilt.select("conv_id", "depth", *[F.xxhash64(F.lit(s), "depth", "content").alias(x) for s, x in ((1, "x1"), (2, "x2"))], "n_bytes")
    zero = F.lit(0).cast("long")
    paths = carried(steps, "conv_id", [F.col("depth")], {}, {"k1": F.col("x1"), "k2": F.col("x2")})
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "x1", "x2", "n_bytes", "k1", "k2")])
    paths = common.cut(paths.unionByName(roots))

    partial = paths.withColumn("part", F.spark_partition_id() % PARTS).groupBy(*_NODE, "part").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), *[F.first(c).alias(c) for c in ("x1", "x2", "n_bytes")])
    nodes = partial.groupBy(*_NODE).agg(F.sum("n").alias("n_convs"), F.min("m").alias("conv_id"), *[F.first(c).alias(c) for c in ("x1", "x2", "n_bytes")])
    up = [(F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("k2")]
    nodes = common.cut(nodes)
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = common.cut(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")))

    own = carried(nodes.select("conv_id", *_NODE, "leaf", "saved"), "conv_id", [F.col("depth").desc()], {"leaves": F.col("leaf"), "bytes": F.col("saved")})
    own = common.cut(own.select("conv_id", *_NODE, "leaves", "bytes"))
    tops = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max_by(F.struct("leaves", "bytes"), -F.col("depth")).alias("v")).where("top > 0")
    above = paths.select("conv_id", *_NODE).join(tops, "conv_id").where("depth < top").select(*_NODE, "v.leaves", "v.bytes")
    totals = own.select(*_NODE, "leaves", "bytes").unionByName(above).groupBy(*_NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("bytes").alias("saved_tokens"))

    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"), F.max("depth").alias("depth"))
    ends = end_digests(last.select("depth", "k.k1", "k.k2", "conv_id"))

    # Only a conversation's topmost own node hangs on another's; all others hang on their own.
    top_nodes = nodes.join(tops.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).select(*up, F.col("conv_id").alias("child"))
    parents = top_nodes.join(nodes.select(*_NODE, F.col("conv_id").alias("parent")), _NODE).select("child", "parent", (F.col("depth") + 1).alias("child_depth"))
    out = nodes.join(totals, _NODE).join(ends, _NODE, "left").join(parents, (F.col("conv_id") == F.col("child")) & (F.col("depth") == F.col("child_depth")), "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = {
    "op13_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT c.conv_id, 0 AS src, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS b, md5(string_agg(md5(role) || md5(text), '') OVER w) AS k
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
  SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(b) AS b, count(*) AS n_convs FROM d GROUP BY k
), e AS (
  SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h
  FROM (SELECT conv_id, arg_max(k, depth) AS k FROM d GROUP BY conv_id) GROUP BY k
), f AS (
  SELECT n.*, p.k AS pk, p.conv_id AS parent FROM n LEFT JOIN d ON d.conv_id = n.conv_id AND d.depth = n.depth - 1 LEFT JOIN n p ON p.k = d.k
), g AS (SELECT pk, count(*) AS n FROM f WHERE pk IS NOT NULL GROUP BY pk
), s AS (
  SELECT a.k, sum(CASE WHEN g.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.b) AS saved
  FROM f LEFT JOIN g ON g.pk = f.k JOIN d a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.k
)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs::BIGINT AS n_convs, coalesce(g.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM f LEFT JOIN g ON g.pk = f.k JOIN s ON s.k = f.k LEFT JOIN e ON e.k = f.k
"""
}
QUERIES = {"op13_trie": op13_trie}
