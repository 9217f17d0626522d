"""Verification: checks as rows, stored results recomputed, artifacts against their index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, failing: Column, warn: bool = False) -> DataFrame:
    """One row check_id, status (pass, warn or fail), detail (how many rows fail)."""
    n = F.count_if(failing)
    return df.agg(F.lit(name).alias("check_id"), F.when(n == 0, "pass").otherwise("warn" if warn else "fail").alias("status"), n.cast("string").alias("detail"))


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reproduced(name: str, stored: DataFrame, again: DataFrame) -> DataFrame:
    """pass if both hold the same rows as often, whatever their order: one aggregate over both, by row."""
    cols = sorted(stored.columns)
    both = stored.select(*cols, F.lit(1).alias("_d")).unionByName(again.select(*cols, F.lit(-1).alias("_d")))
    return check(both.groupBy(*cols).agg(F.sum("_d").alias("_d")), name, F.col("_d") != 0)


def same_keys(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return check(x, name, F.col("_a").isNull() | F.col("_b").isNull())


def references(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key the parent lacks."""
    x = child.join(parent.select(key).distinct().withColumn("_p", F.lit(1)), key, "left")
    return check(x, name, F.col("_p").isNull())


def artifacts(files: DataFrame, index: DataFrame) -> DataFrame:
    """path, sha256 of files and of their index -> path, status: ok, changed, missing, not_indexed."""
    a, b = files.select("path", F.col("sha256").alias("_f")), index.select("path", F.col("sha256").alias("_i"))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_i").isNull(), "not_indexed").when(F.col("_f") == F.col("_i"), "ok").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


# --- Stored runs -----------------------------------------------------------------------------------------------------

#: Buckets of a stored run's leaves (16 bits of the keys' hash); so many in a node above.
BUCKETS, FANOUT = 1 << 16, 1 << 8
#: Buckets that are named in a filter at most; with more, rows are joined with them.
NAMED = 2000


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """_bucket by keys, and two 64-bit hashes of each whole row."""
    cols = [F.col(c) for c in sorted(df.columns)]
    null = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in sorted(df.columns)])  # xxhash64 passes nulls over
    return df.withColumns({"_bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"), "_h1": F.xxhash64(F.lit(1), null, *cols), "_h2": F.xxhash64(F.lit(2), null, *cols)})


def _sums(df: DataFrame, *by: str) -> DataFrame:
    """Rows and sums of hashes: equal for equal rows in any order and any number of files."""
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def _leaves(hashed: DataFrame) -> DataFrame:
    one = lambda c: F.col(c).cast("decimal(38,0)")
    return _sums(hashed.select("_bucket", F.lit(1).cast("long").alias("n"), one("_h1").alias("s1"), one("_h2").alias("s2")), "_bucket")


def store_run(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows in the order of their buckets, and the digests of all buckets: path/rows, path/digests. A later look at
    some buckets reads only the row groups that hold them."""
    spark = df.sparkSession
    _hashed(df, keys).drop("_h1", "_h2").repartitionByRange("_bucket").sortWithinPartitions("_bucket").write.parquet(f"{path}/rows")
    _leaves(_hashed(spark.read.parquet(f"{path}/rows").drop("_bucket"), keys)).write.parquet(f"{path}/digests")


def differing_buckets(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Digests of leaves on both sides -> the buckets that differ, found from the root down: nothing below an equal node is compared."""

    def level(df: DataFrame, width: int) -> DataFrame:
        return _sums(df.withColumn("node", F.floor(F.col("_bucket") / width).cast("int")), "node")

    under, under_width = None, BUCKETS
    for width in (BUCKETS, FANOUT, 1):
        a, b = (level(x if under is None else x.where(F.floor(F.col("_bucket") / under_width).isin(under)), width) for x in (stored, again))
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = F.coalesce((F.col("a.n") == F.col("b.n")) & (F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2") == F.col("b.s2")), F.lit(False))
        differ = both.where(~same).select("node")
        if width == 1:
            return differ.select(F.col("node").alias("_bucket"))
        under, under_width = [r[0] for r in differ.collect()], width  # BUCKETS / FANOUT numbers at most
    raise AssertionError


def row_faults(rows: DataFrame, mine: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Stored rows against recomputed ones, by key: keys, fault, columns (see against_stored)."""
    value = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(0).alias("_none"))
    packed = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(f"{c}n"), F.min(value).alias(f"{c}v"), F.max(value).alias(f"{c}w"), F.sum(F.xxhash64(*names).cast("decimal(38,0)") if names else F.lit(0)).alias(f"{c}s"))
    a, b = packed(rows, "a").alias("a"), packed(mine, "b").alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, same, "full_outer")
    single = (F.col("an") == 1) & (F.col("bn") == 1)
    changed = F.filter(F.array(*[F.when(~F.col(f"av.{c}").eqNullSafe(F.col(f"bv.{c}")), F.lit(c)) for c in names]), lambda c: c.isNotNull()) if names else F.array().cast("array<string>")
    fault = F.when(F.col("bn").isNull(), "missing").when(F.col("an").isNull(), "added").when(F.col("an") != F.col("bn"), "count").when(~F.col("as").eqNullSafe(F.col("bs")) | ~F.col("av").eqNullSafe(F.col("bv")) | ~F.col("aw").eqNullSafe(F.col("bw")), "changed")
    out = j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], fault.alias("fault"), F.when(single, changed).alias("columns"))
    return out.where("fault is not null")


def unlike_digests(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Buckets of a stored run whose rows no longer give the digests that were stored with them."""
    rows = spark.read.parquet(f"{path}/rows").drop("_bucket")
    return differing_buckets(spark.read.parquet(f"{path}/digests"), _leaves(_hashed(rows, keys)))


def against_stored(again: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A recomputed run against a stored one: keys, fault (missing: stored only; added: recomputed only; changed; count: the rows of a key
    that repeats differ), columns (those that changed). No rows if they are equal.

    Equal runs cost one aggregate of the recomputed rows by bucket: of the stored run only digests are read. Otherwise the
    differing buckets' rows are read on both sides, by a filter that reaches the scan while they are few.
    """
    from .graph import checkpointed

    spark = again.sparkSession
    hashed = checkpointed(_leaves(_hashed(again, keys)))
    found = checkpointed(differing_buckets(spark.read.parquet(f"{path}/digests"), hashed))
    rows = spark.read.parquet(f"{path}/rows")
    names = [c for c in again.columns if c not in keys]
    mine = _hashed(again, keys).drop("_h1", "_h2")
    if found.limit(NAMED + 1).count() <= NAMED:
        few = [r[0] for r in found.collect()]  # NAMED numbers at most
        rows, mine = (x.where(F.col("_bucket").isin(few)) for x in (rows, mine))
    else:
        rows, mine = (x.join(found, "_bucket", "left_semi") for x in (rows, mine))
    return row_faults(rows, mine, keys, names)
