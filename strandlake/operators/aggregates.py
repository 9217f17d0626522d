"""Aggregates: model metrics, codon usage, best of a group, conditional counts, alignment profiles, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CODONS, SENSE


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def mean_and_deviation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Over finite values: count, mean (NaN if none), sample deviation (0 for one, NaN for none)."""
    v = F.when(finite(F.col(value)), F.col(value))
    n = F.count(v)
    nan = F.lit(float("nan"))
    return df.groupBy(*group).agg(n.alias("n"), F.when(n > 0, F.avg(v)).otherwise(nan).alias("mean"), F.when(n > 1, F.stddev_samp(v)).when(n == 1, 0.0).otherwise(nan).alias("deviation"))


def average_rank(df: DataFrame, value: str, name: str, partition: list[str] | None = None) -> DataFrame:
    """Ranks from one, the mean rank for ties, within a partition of few values. Values are counted first; the ranks of what
    is left come from ranges of them. Null values have no rank."""
    from .windows import running_sum

    part = partition or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("_n"))
    ranks = running_sum(counts, [value], F.col("_n"), "_before", part)
    return df.join(ranks.select(*part, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name)), [*part, value], "left")


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null where either is constant, instead of an error."""
    ok = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def regression_metrics(df: DataFrame, label: str, prediction: str, group: list[str]) -> DataFrame:
    """MSE, Spearman (mean ranks), R2 as 1 - SSE / SST, Pearson, for each group."""
    rows = average_rank(average_rank(df, label, "_rl", group), prediction, "_rp", group)
    e = F.col(label) - F.col(prediction)
    return rows.groupBy(*group).agg(F.avg(e * e).alias("mse"), correlation("_rl", "_rp").alias("spearman"), (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count("*"))).alias("r2"), correlation(label, prediction).alias("pearson"))


def classification_metrics(df: DataFrame, label: str, prediction: str, mask: int = -100) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over the union of classes (0 where undefined), Matthews' coefficient.

    One shuffle to the confusion counts; the rest works on classes.
    """
    cells = df.where(F.col(label) != mask).groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("l").alias("k"), "n", F.lit(0).cast("long").alias("m"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(cells.select(F.col("p").alias("k"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"), F.lit(0).cast("long").alias("hit")))
    by = sides.groupBy("k").agg(F.sum("n").alias("t"), F.sum("m").alias("p"), F.sum("hit").alias("c"))
    z = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("c", "p"), z), F.coalesce(F.try_divide("c", "t"), z)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), z)
    out = by.agg(F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))
    d = F.sqrt((F.col("s") * F.col("s") - F.col("pp")).cast("double")) * F.sqrt((F.col("s") * F.col("s") - F.col("tt")).cast("double"))
    return out.select(F.coalesce(F.try_divide("c", "s"), z).alias("accuracy"), "precision", "recall", "f1", F.coalesce(F.try_divide((F.col("c") * F.col("s") - F.col("pt")).cast("double"), d), z).alias("mcc"))


def masked_accuracy(label: str, prediction: str, mask: int = -100) -> Column:
    return F.coalesce(F.avg(F.when(F.col(label) != mask, (F.col(label) == F.col(prediction)).cast("double"))), F.lit(0.0))


def codon_usage(df: DataFrame, cds: str) -> DataFrame:
    """All 61 sense codons with counts (0 if absent) and shares of all counts."""
    from ..functions.sequence import triplets

    spark = df.sparkSession
    counts = df.select(F.explode(triplets(F.col(cds))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    all61 = spark.createDataFrame([(c, CODONS[c]) for c in SENSE], "codon string, residue string")
    total = F.sum("n").over(Window.partitionBy())
    return all61.join(counts, "codon", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("frequency", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def cds_reason(flags: dict[str, Column]) -> Column:
    """The name of the first flag that holds; null if none does. The order of the flags is the order of reasons."""
    names = list(flags)
    out = F.when(flags[names[0]], names[0])
    for n in names[1:]:
        out = out.when(flags[n], n)
    return out


def best_of(df: DataFrame, group: list[str], value: str, by: list[Column]) -> DataFrame:
    """The value of each group's first row in the order of `by`."""
    return df.groupBy(*group).agg(F.min_by(value, F.struct(*[c.alias(f"_{k}") for k, c in enumerate(by)])).alias(value))


def status_counts(spine: DataFrame, observations: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """One row for each key of the spine with the number of observations of each status, 0 where none. Counted before the join."""
    counts = observations.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])
    return spine.select(key).join(counts, key, "left").fillna(0, values)


def alignment_profile(df: DataFrame, aligned: str, ident: str) -> DataFrame:
    """Columns of an alignment: coverage, the share of the most frequent residue, entropy in bits; '-' and 'X' don't count."""
    from ..functions.sequence import letters

    rows = df.select(ident, F.posexplode(letters(F.col(aligned))).alias("_p", "r"))
    counts = rows.groupBy("_p", "r").agg(F.count("*").alias("n"))
    real = ~F.col("r").isin("-", "X")
    n = F.sum(F.when(real, F.col("n")).otherwise(0)).over(Window.partitionBy("_p"))
    share = F.when(real & (n > 0), F.col("n") / n)
    by = counts.withColumn("share", share).groupBy("_p")
    return by.agg(F.try_divide(F.sum(F.when(real, F.col("n")).otherwise(0)), F.sum("n")).alias("coverage"), F.max("share").alias("conservation"), F.coalesce(-F.sum(F.col("share") * F.log2("share")), F.lit(0.0)).alias("entropy")).select((F.col("_p") + 1).alias("pos"), "coverage", "conservation", "entropy")


def set_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the sorted distinct rows' JSON. For batches that fit one string."""
    row = F.to_json(F.struct(*columns))
    return df.agg(F.sha2(F.array_join(F.sort_array(F.collect_set(row)), ",").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def bucketed_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the digests of 4,096 buckets of the distinct rows' hashes, in order; n. For sets of any size: a
    task joins a bucket's sorted hashes, and only the buckets' digests meet."""
    rows = df.select(F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256).alias("h")).distinct()
    digest = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ",").cast("binary"), 256)
    buckets = rows.groupBy(F.substr("h", F.lit(1), F.lit(3)).alias("b")).agg(digest("h").alias("d"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return buckets.agg(F.sha2(F.array_join(ordered, ",").cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def geometry(df: DataFrame, group: list[str], pos: str = "pos") -> DataFrame:
    """Centroid, radius of gyration, end-to-end distance of points (x, y, z) along pos, by one aggregate."""
    ends = [F.min_by(F.struct("x", "y", "z"), pos).alias("a"), F.max_by(F.struct("x", "y", "z"), pos).alias("b")]
    rg = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))
    out = df.groupBy(*group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), rg.alias("radius_of_gyration"), F.count("*").alias("n"), *ends)
    d = sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2) for c in "xyz"), F.lit(0.0))
    return out.withColumn("end_to_end", F.sqrt(d)).drop("a", "b")


def distances_to_centroid(df: DataFrame, group: str) -> DataFrame:
    """Points (x, y, z) with their group's centroid (cx, cy, cz) and their Euclidean distance from it."""
    c = df.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    d = sum((F.pow(F.col(k) - F.col(f"c{k}"), 2) for k in "xyz"), F.lit(0.0))
    return df.join(c, group).withColumn("distance", F.sqrt(d))


def distance_rmsd(df: DataFrame, group: list[str], pos: str = "pos") -> DataFrame:
    """Points (x, y, z) and (x2, y2, z2) at equal places: root mean square difference of their pair distances."""
    a = df.select(*group, F.col(pos).alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("x", "y", "z", "x2", "y2", "z2")])
    b = df.select(*group, F.col(pos).alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("x", "y", "z", "x2", "y2", "z2")])
    d = lambda s: F.sqrt(sum((F.pow(F.col(f"{c}{s}_i") - F.col(f"{c}{s}_j"), 2) for c in "xyz"), F.lit(0.0)))
    return a.join(b, group).where("i < j").groupBy(*group).agg(F.sqrt(F.avg(F.pow(d("") - d("2"), 2))).alias("rmsd"))
