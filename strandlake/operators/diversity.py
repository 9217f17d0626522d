"""Greedy portfolios by rank and diversity, decided in parallel rounds over an inverted index of k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from .graph import checkpointed

KMER = 3


def kmer_list(text: Column, k: int = KMER) -> Column:
    """The distinct k-mers of a text in the order of their hashes; a shorter text is its own only one."""
    found = F.array_distinct(F.transform(fn.indexes(F.length(text) - k + 1), lambda i: F.substr(text, i + 1, F.lit(k))))
    found = F.when(F.length(text) < k, F.array(text)).otherwise(found)
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda x: x["x"])


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of distinct k-mers."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _leaders(rows: DataFrame) -> DataFrame:
    """Rows that no better one shares an indexed k-mer with: nothing that is still open can keep them out."""
    index = rows.select("g", "k", "o", F.explode("prefix").alias("x"))
    first = index.groupBy("g", "x").agg(F.min("o").alias("m"))
    best = index.join(first, ["g", "x"]).groupBy("g", "k", "o").agg(F.min("m").alias("m"))
    return best.where(F.col("m") == F.col("o")).select("g", "k")


def _similar(chosen: DataFrame, rows: DataFrame, most: float) -> DataFrame:
    """(g, k) of rows that are more similar than most to a chosen one of their group: pairs come from the index."""
    a = chosen.select("g", F.col("k").alias("c"), F.explode("prefix").alias("x"))
    b = rows.select("g", "k", F.explode("prefix").alias("x"))
    pairs = a.join(b, ["g", "x"]).select("g", "c", "k").distinct()
    pairs = pairs.join(chosen.select("g", F.col("k").alias("c"), F.col("kmers").alias("a")), ["g", "c"]).join(rows.select("g", "k", "kmers"), ["g", "k"])
    return pairs.where(similarity(F.col("a"), F.col("kmers")) > most).select("g", "k").distinct()


def diverse(rows: DataFrame, held: DataFrame, needed: DataFrame, most: float) -> DataFrame:
    """The greedy choice by rank: a row is taken unless it is more similar than most to one taken before it.

    rows: g, k, o (rank and key), seq; held: the same, chosen already; needed: g, n (rows wanted of a group). ->
    g, k, o of at least the first n that the greedy rule takes (all, where there are fewer).

    A row is decided once all better-ranked rows that may be similar are: in each round, rows that are the best on all
    their indexed k-mers are taken, and what is similar to them goes. Rows of similarity above `most` share one of the
    first |x| - ceil(most |x|) + 1 k-mers in any fixed order, so only these are indexed. Rows beyond the n-th one taken
    no longer matter and go too, so a group ends after n rounds at most, mostly after a few. Equal texts meet once, as
    the best of them. No group is in one task; all groups share the rounds.
    """
    first = Window.partitionBy("g", "seq").orderBy("o")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kmers = kmer_list(F.col("seq"))
    size = F.size("kmers")
    indexed = lambda df: df.select("g", "k", "o", kmers.alias("kmers")).withColumn("prefix", F.slice("kmers", F.lit(1), F.least(size, size - F.ceil(size * most - 1e-9).cast("int") + 1)))
    held, open_ = indexed(held), checkpointed(indexed(rows))
    open_ = checkpointed(open_.join(_similar(held, open_, most), ["g", "k"], "left_anti"))
    taken = None
    while not open_.isEmpty():
        now = checkpointed(open_.join(_leaders(open_), ["g", "k"]))
        taken = now.select("g", "k", "o") if taken is None else checkpointed(taken.unionByName(now.select("g", "k", "o")))
        place = F.row_number().over(Window.partitionBy("g").orderBy("o"))
        ends = taken.join(needed, "g").withColumn("_p", place).where("_p = n").select("g", F.col("o").alias("last"))
        rest = open_.join(now.select("g", "k"), ["g", "k"], "left_anti").join(ends, "g", "left").where("last is null or o < last").drop("last")
        open_ = checkpointed(rest.join(_similar(now, rest, most), ["g", "k"], "left_anti"))
    return rows.select("g", "k", "o").limit(0) if taken is None else taken


def portfolio(ranked: DataFrame, key: str, sequence: str, group: str, budget: int, most_similar: float, controls: int = 0, others: int = 0) -> DataFrame:
    """The greedy portfolio of each group: key, group, place, reason.

    ranked: key, sequence, group, rank, is_control, of eligible rows. First the minimum of controls by rank, then the
    minimum of other rows by rank, however similar; then by rank each row whose similarity (3-mer Jaccard; equal texts 1)
    to every chosen one is at most most_similar, until the budget is reached.
    """
    if budget < 1 or not 0 <= most_similar <= 1 or min(controls, others) < 0 or controls + others > budget:
        raise ValueError("a portfolio needs a positive budget that holds both minimums, and a similarity from 0 to 1")
    rows = checkpointed(ranked.select(F.col(group).alias("g"), F.col(key).alias("k"), F.struct("rank", key).alias("o"), F.col(sequence).alias("seq"), F.coalesce("is_control", F.lit(False)).alias("c")))
    place = F.row_number().over(Window.partitionBy("g", "c").orderBy("o"))
    least = rows.withColumn("p", place).where(F.when(F.col("c"), F.col("p") <= controls).otherwise(F.col("p") <= others)).drop("p") if controls or others else rows.limit(0)
    least = checkpointed(least)
    rest = rows.join(least.select("g", "k"), ["g", "k"], "left_anti")
    needed = rows.select("g").distinct().join(least.groupBy("g").agg(F.count("*").alias("m")), "g", "left").select("g", (budget - F.coalesce("m", F.lit(0))).alias("n"))
    needed = checkpointed(needed)
    more = rest.select("g", "k", "o") if most_similar == 1 else diverse(rest.drop("c").join(needed.where("n > 0"), "g", "left_semi"), least.drop("c"), needed, most_similar)
    tier, reason = F.when(F.col("c"), 0).otherwise(1), F.when(F.col("c"), "required_control").otherwise("required_other")
    both = least.select("g", "k", "o", tier.alias("tier"), reason.alias("reason")).unionByName(more.select("g", "k", "o", F.lit(2).alias("tier"), F.lit("rank_and_diversity").alias("reason")))
    both = both.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("tier", "o"))).where(F.col("place") <= budget)
    return both.select(F.col("g").alias(group), F.col("k").alias(key), "place", "reason")
