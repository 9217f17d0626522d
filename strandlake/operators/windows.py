"""Gaps and islands, sliding windows, interval merging, first occurrences, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..functions.constants import HYDROPATHY


def label_runs(df: DataFrame, keys: list[str], pos: str, label: str) -> DataFrame:
    """Runs of consecutive places with equal labels: keys, label, start1, end1."""
    g = F.col(pos) - F.row_number().over(Window.partitionBy(*keys, label).orderBy(pos))
    return df.withColumn("_g", g).groupBy(*keys, label, "_g").agg(F.min(pos).cast("int").alias("start1"), F.max(pos).cast("int").alias("end1")).drop("_g")


def runs_where(df: DataFrame, keys: list[str], pos: str, condition: Column, *values: Column) -> DataFrame:
    """Runs of consecutive places that meet a condition, with aggregates over them."""
    held = df.where(condition)
    g = F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return held.withColumn("_g", g).groupBy(*keys, "_g").agg(F.min(pos).cast("int").alias("start1"), F.max(pos).cast("int").alias("end1"), *values).drop("_g")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start1", end: str = "end1", *values: Column) -> DataFrame:
    """Closed integer intervals that overlap or touch become one. values: aggregates over the merged ones."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > before + 1).cast("int"), F.lit(1))
    flagged = df.withColumn("_new", new)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), *values).drop("_i", "_new")


def sliding_mean(df: DataFrame, keys: list[str], pos: str, value: str, n: int) -> DataFrame:
    """Full windows of n places: keys, start1, end1, score (mean)."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(1 - n, 0)
    full = df.withColumn("score", F.avg(value).over(w)).withColumn("_n", F.count(value).over(w)).where(F.col("_n") == n)
    return full.select(*keys, (F.col(pos) - n + 1).alias("start1"), F.col(pos).alias("end1"), "score")


def ordered_means(stored: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A stored Parquet table -> key and the mean of each value, added up in the table's own order (file, row).

    A sum of fractions depends on its order, and so does on which side of a limit a mean on it lies; partial sums come in whatever
    order tasks end. Rows of a key are sorted in its task, which spills; none is held in an array.
    """
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    w = Window.partitionBy(key).orderBy("_at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = stored.select(key, *values, at.alias("_at"))
    rows = rows.select(key, *[F.avg(v).over(whole).alias(v) for v in values], F.row_number().over(w).alias("_n"))
    return rows.where("_n = 1").drop("_n")


def first_occurrence(df: DataFrame, content: list[str], order: list[str], key: str) -> DataFrame:
    """duplicate_of: the key of the first row with the same content, null for that row itself."""
    first = F.first(key).over(Window.partitionBy(*content).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("duplicate_of", F.when(first != F.col(key), first))


def residues(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return df.select(*keys, F.posexplode(fn.letters(F.col(seq))).alias("_p", "residue")).withColumn("pos", F.col("_p") + 1).drop("_p")


def sliding(values: Column, n: int, join) -> Column:
    """join over every n neighbours of an array, by powers of two: about 2 log n passes. The last n - 1 are null."""
    shifted = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))

    def grown(power: Column, size: int, done: Column | None, held: int, rest: int) -> Column:
        if rest & 1:
            done, held = power if done is None else F.zip_with(done, shifted(power, held), join), held + size
        if rest < 2:
            return done
        wider = F.zip_with(power, shifted(power, size), join)
        if done is None:
            return fn.let(wider, lambda p: grown(p, 2 * size, None, held, rest >> 1))
        return fn.let(F.struct(wider.alias("p"), done.alias("d")), lambda x: grown(x["p"], 2 * size, x["d"], held, rest >> 1))

    return fn.let(values, lambda v: grown(v, 1, None, 0, n))


def merged_places(starts: Column, n: int, gap: int) -> Column:
    """Sorted begins (from one) of windows of n places -> array of (start1, end1): windows that begin at most gap apart are one."""

    def of(h: Column) -> Column:
        first = F.filter(h, lambda x, i: (i == 0) | (x - F.get(h, i - 1) > gap))
        last = F.filter(h, lambda x, i: (i == F.size(h) - 1) | (F.get(h, i + 1) - x > gap))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start1"), (b + n - 1).alias("end1")))

    return fn.let(starts, of)


def hydrophobic_places(seq: Column, n: int = 19, threshold_tenths: int = 16) -> Column:
    """Array of (start1, end1, top): merged windows whose mean hydropathy reaches the threshold, top: the largest sum of tenths, which
    are integers, so the edge is exact."""
    tenths = fn.literal_map({a: round(v * 10) for a, v in HYDROPATHY.items()})
    sums = sliding(F.transform(fn.letters(seq), lambda a: F.coalesce(F.element_at(tenths, a), F.lit(0))), n, lambda a, b: a + b)

    def of(t: Column) -> Column:
        hits = F.transform(F.filter(fn.indexes(F.size(t) - n + 1), lambda i: F.get(t, i) >= threshold_tenths * n), lambda i: i + 1)
        top = lambda r: F.array_max(F.slice(t, r["start1"], r["end1"] - r["start1"] - n + 2)).cast("long")
        return F.transform(merged_places(hits, n, n), lambda r: F.struct(r["start1"].alias("start1"), r["end1"].alias("end1"), top(r).alias("top")))

    return fn.let(sums, of)


def hydrophobic_regions(df: DataFrame, keys: list[str], n: int = 19, threshold_tenths: int = 16) -> DataFrame:
    """keys, seq -> start1, end1, top of each row's hydrophobic_places()."""
    return df.select(*keys, F.inline(hydrophobic_places(F.col("seq"), n, threshold_tenths)))


def homopolymer_places(seq: Column, least: int = 3) -> Column:
    """Array of (start1, end1): runs of `least` equal letters and more."""

    def of(a: Column) -> Column:
        same = lambda i: F.forall(F.slice(a, i + 2, least - 1), lambda x: x == F.get(a, i))
        return merged_places(F.transform(F.filter(fn.indexes(F.size(a) - least + 1), same), lambda i: i + 1), least, 1)

    return fn.let(fn.letters(seq), of)


def liability(df: DataFrame, n: int = 19) -> DataFrame:
    """doc_id, seq -> windows of n residues with a mean hydropathy of 1.6 at least, longest run, 1 - min(1, windows / 10 + max(0, longest - 3) / 6)."""
    tenths = fn.literal_map({a: round(v * 10) for a, v in HYDROPATHY.items()})
    vs = F.transform(fn.letters(F.col("seq")), lambda a: F.element_at(tenths, a))
    # Prefix sums: each window is one subtraction.
    zero = F.array(F.lit(0))
    sums = F.aggregate(vs, F.struct(zero.alias("a"), F.lit(0).alias("t")), lambda s, v: F.struct(F.concat(s["a"], F.array(s["t"] + v)).alias("a"), (s["t"] + v).alias("t")))["a"]
    rows = df.select("doc_id", "seq", sums.alias("ps"))
    hits = F.size(F.filter(fn.indexes(F.length("seq") - n + 1), lambda i: F.element_at("ps", i + n + 1) - F.element_at("ps", i + 1) >= 16 * n))
    rows = rows.select("doc_id", hits.alias("windows"), fn.longest_homopolymer(F.col("seq")).alias("longest"))
    bad = F.least(F.lit(1.0), F.col("windows") / 10.0 + F.greatest(F.lit(0), F.col("longest") - 3) / 6.0)
    return rows.select("doc_id", "windows", "longest", F.round(1 - bad, 6).alias("liability"))


def low_complexity_places(seq: Column, letters: str, n: int = 12, bits: float = 2.2) -> Column:
    """Array of (start1, end1) of what windows of n letters with an entropy below `bits` cover, merged.

    A window of d different letters has the least entropy where all but one of them stand there once, so windows of too many, which
    are nearly all, go by one bit for each letter, before any entropy is computed.
    """
    least = lambda d: -((n - d + 1) / n * math.log2((n - d + 1) / n) + (d - 1) / n * math.log2(1 / n))
    most = max((d for d in range(1, n + 1) if least(d) < bits + 1e-9), default=0)
    other = 1 << 62
    bit = fn.literal_map({a: 1 << k for k, a in enumerate(letters)})

    def of(s: Column) -> Column:
        held = sliding(F.transform(fn.letters(s), lambda a: F.coalesce(F.element_at(bit, a), F.lit(other))), n, lambda a, b: a.bitwiseOR(b))
        few = fn.let(held, lambda m: F.filter(fn.indexes(F.size(m) - n + 1), lambda i: (F.get(m, i) >= other) | (F.bit_count(F.get(m, i)) <= most)))
        low = F.filter(few, lambda i: fn.let(F.substr(s, i + 1, F.lit(n)), lambda x: fn.entropy(x, letters)) < bits)
        return merged_places(F.transform(low, lambda i: i + 1), n, n)

    return fn.let(seq, of)


def low_complexity_regions(df: DataFrame, keys: list[str], letters: str, n: int = 12, bits: float = 2.2) -> DataFrame:
    """keys, seq -> start1, end1 of each row's low_complexity_places()."""
    return df.select(*keys, F.inline(low_complexity_places(F.col("seq"), letters, n, bits)))


def neighbours(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the next one's columns (next_...); the last row of a key goes."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.withColumn("_has", F.lead(F.lit(1)).over(w)).where("_has = 1").drop("_has")


def short_ids(df: DataFrame, order: list[str], prefix: str = "c", digits: int = 3) -> DataFrame:
    """short_id: prefix and a number from 0 in order. For batches that go to an external tool as a whole."""
    rows = numbered(df, order, "_n")
    return rows.withColumn("short_id", F.concat(F.lit(prefix), F.lpad((F.col("_n") - 1).cast("string"), digits, "0"))).drop("_n")


def running_sum(df: DataFrame, order: list, value: Column, name: str, keys: list[str] | None = None) -> DataFrame:
    """df with name: the sum of value over the rows before each in the order, within keys (not null).

    Rows are dealt to ranges of (keys, order), and rows are added up within their own range, so no task sees all rows of
    a key. What earlier ranges hold of a key is carried over by a table of the keys that go on from one range to the next: a
    row a range at most, which is the bound of the broadcast. The order should be unique; among ties it is open.
    """
    from .graph import checkpointed

    by = keys or []
    ranged = checkpointed(df.withColumn("_rs_value", value).repartitionByRange(*by, *order).withColumn("_rs_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_rs_part").agg(F.sum("_rs_value").alias("_rs_sum"))
    earlier = Window.partitionBy(*by).orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_rs_part", F.sum("_rs_sum").over(earlier).alias("_rs_base")).where("_rs_base is not null")
    within = Window.partitionBy("_rs_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_rs_within", F.coalesce(F.sum("_rs_value").over(within), F.lit(0))).join(F.broadcast(base), ["_rs_part", *by], "left")
    return rows.withColumn(name, F.coalesce("_rs_base", F.lit(0)) + F.col("_rs_within")).drop("_rs_part", "_rs_value", "_rs_within", "_rs_base")


def numbered(df: DataFrame, order: list, name: str, keys: list[str] | None = None) -> DataFrame:
    """df with name: each row's place in the order, from one, within keys. See running_sum()."""
    return running_sum(df, order, F.lit(1), name, keys).withColumn(name, F.col(name) + 1)
