"""Selection: round-robin over strata, hash budgets, tiers, Pareto frontiers, caps and skips by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from .windows import numbered


def round_robin(df: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """One of each group in group order, then the second of each, and so on, until n; within a group by score, then key."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return df.withColumn("round", rn).where(F.col("round") <= n).orderBy("round", F.col(group).cast("string")).limit(n)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows whose key's SHA-256 comes first."""
    return df.withColumn("_h", sha256(key)).orderBy("_h").limit(n).drop("_h")


def tiered(df: DataFrame, mandatory: str, group: str, score: str, key: str, n: int, strict: bool = True) -> DataFrame:
    """All mandatory rows, then round-robin of the others up to n. More mandatory rows than n is an error; if not strict, they are
    all there is."""
    tier1 = df.where(F.col(mandatory))
    checked = tier1.withColumn("tier", F.lit("mandatory"))
    if strict:
        count = tier1.agg(F.count("*").alias("_n"))
        checked = tier1.join(F.broadcast(count)).withColumn("tier", F.when(F.col("_n") > n, F.raise_error(F.lit("mandatory rows exceed the budget"))).otherwise(F.lit("mandatory"))).drop("_n")  # one row
    rest = df.where(~F.col(mandatory))
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    rest = rest.withColumn("_r", rn).where(F.col("_r") <= n)
    rest = numbered(rest.withColumn("_g", F.col(group).cast("string")), ["_r", "_g"], "_p").drop("_g")
    left = tier1.agg((F.lit(n) - F.count("*")).alias("_left"))
    rest = rest.join(F.broadcast(left)).where("_p <= _left").drop("_p", "_r", "_left")  # one row
    return checked.unionByName(rest.withColumn("tier", F.lit("round_robin")))


def capped(df: DataFrame, partition: str, order: str, cap: int, skip: int = 0) -> DataFrame:
    """At most cap rows of each partition after skipping some."""
    rn = F.row_number().over(Window.partitionBy(partition).orderBy(order))
    return df.withColumn("_n", rn).where((F.col("_n") > skip) & (F.col("_n") <= skip + cap)).drop("_n")


def share(total: int, partition: int, partitions: int) -> int:
    """A global skip split exactly over partitions: those before the remainder take one more."""
    return total // partitions + (partition < total % partitions)


def ceil_share(total: int, partitions: int) -> int:
    """A global cap's part for each partition, rounded up, so that all together are never short of it."""
    return -(-total // max(1, partitions))
