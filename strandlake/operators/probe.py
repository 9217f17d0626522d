"""A frozen probe: principal components, scaling and ridge regression on vectors, the penalty chosen on a development split."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import regression_metrics


def frozen_probe(df: DataFrame, vector: str, label: str, k: int, alphas: list[float]) -> DataFrame:
    """df with split (train, dev, test) -> alpha, dev_spearman, dev_mse, chosen, and for the chosen one test_spearman, test_mse.

    Components and scales are fitted on train. The chosen penalty has the best Spearman correlation on dev, then the least
    error, then the least alpha; the test split is looked at once. alpha is ridge's penalty on the sum of squared errors.
    """
    rows = df.select("split", array_to_vector(F.col(vector).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y"))
    train = rows.where("split = 'train'")
    n = train.count()
    steps = Pipeline(stages=[PCA(k=k, inputCol="_x", outputCol="_c"), StandardScaler(withMean=True, inputCol="_c", outputCol="_z")]).fit(train)
    ready = steps.transform(rows).select("split", "_z", "_y")
    parts = []
    for a in alphas:
        model = LinearRegression(featuresCol="_z", labelCol="_y", predictionCol="_p", regParam=a / n, elasticNetParam=0.0, standardization=False).fit(ready.where("split = 'train'"))
        got = regression_metrics(model.transform(ready.where("split <> 'train'")).select("split", "_y", "_p"), "_y", "_p", ["split"])
        parts.append(got.select(F.lit(float(a)).alias("alpha"), "split", "spearman", "mse"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    by = every.groupBy("alpha").agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("dev", "test") for m in ("spearman", "mse")])
    best = by.agg(F.max_by("alpha", F.struct(F.coalesce("dev_spearman", F.lit(-2.0)), -F.col("dev_mse"), -F.col("alpha"))).alias("_best"))
    got = by.join(F.broadcast(best))  # one row
    chosen = F.col("alpha") == F.col("_best")
    return got.select("alpha", "dev_spearman", "dev_mse", chosen.alias("chosen"), *[F.when(chosen, F.col(c)).alias(c) for c in ("test_spearman", "test_mse")])
