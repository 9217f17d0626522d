"""Transparent ranking: min-max normalization, hard gates as data, weighted scores, ranks, sensitivity, selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered


@dataclass(frozen=True)
class Feature:
    name: str
    weight: float
    maximize: bool = True
    required: bool = False


@dataclass(frozen=True)
class Gate:
    name: str
    feature: str
    operator: str
    threshold: float
    exclude_missing: bool = False


_OPERATORS = {">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t, ">": lambda c, t: c > t, "<": lambda c, t: c < t, "==": lambda c, t: c == t}


def validate(features: list[Feature], gates: list[Gate]) -> None:
    names = [f.name for f in features]
    if len(set(names)) != len(names) or any(isinstance(f.weight, bool) or f.weight < 0 for f in features) or sum(f.weight for f in features) <= 0:
        raise ValueError("features need distinct names and weights that are not negative, one of them positive")
    seen = [g.name for g in gates]
    if len(set(seen)) != len(seen) or any(g.operator not in _OPERATORS or g.feature not in names for g in gates):
        raise ValueError("gates need distinct names, known features and operators")


def normalized(df: DataFrame, features: list[Feature]) -> DataFrame:
    """n_<feature>: 0 to 1 over all rows, reversed where less is better, 0.5 if all are equal, null where missing.

    One aggregate row of minima and maxima is joined to all rows.
    """
    ends = df.agg(*[x for f in features for x in (F.min(f.name).alias(f"_lo_{f.name}"), F.max(f.name).alias(f"_hi_{f.name}"))])
    out = df.join(F.broadcast(ends))  # one row

    def scaled(f: Feature) -> Column:
        lo, hi = F.col(f"_lo_{f.name}"), F.col(f"_hi_{f.name}")
        x = F.try_divide(F.col(f.name) - lo, hi - lo)
        return F.when(F.col(f.name).isNull(), None).when(lo == hi, 0.5).otherwise(x if f.maximize else 1 - x)

    return out.withColumns({f"n_{f.name}": scaled(f) for f in features}).drop(*[f"_{e}_{f.name}" for f in features for e in ("lo", "hi")])


def gate_reasons(features: list[Feature], gates: list[Gate]) -> Column:
    """Why a row is not eligible: required features that are missing, gates that fail or whose value is missing."""
    found = [F.when(F.col(f.name).isNull(), f"required_feature_missing:{f.name}") for f in features if f.required and f.weight > 0]
    for g in gates:
        c = F.col(g.feature)
        missing = F.lit(f"{g.name}:missing") if g.exclude_missing else F.lit(None)
        found.append(F.when(c.isNull(), missing).when(~_OPERATORS[g.operator](c, g.threshold), f"{g.name}:failed"))
    return F.filter(F.array(*found), lambda r: r.isNotNull()) if found else F.array().cast("array<string>")


def scored(df: DataFrame, key: str, features: list[Feature], gates: list[Gate], partition: list[str] | None = None) -> DataFrame:
    """score (missing values add nothing but stay in the denominator), coverage, reasons, eligible, and rank among the
    eligible by score, then key; null for the others."""
    validate(features, gates)
    total = sum(f.weight for f in features)
    score, have = F.lit(0.0), F.lit(0.0)
    for f in features:
        if f.weight > 0:
            score = score + F.coalesce(F.col(f"n_{f.name}") * f.weight, F.lit(0.0))
            have = have + F.when(F.col(f"n_{f.name}").isNotNull(), f.weight).otherwise(0.0)
    out = df.withColumns({"score": F.round(score / total, 8), "coverage": F.round(have / total, 8), "reasons": gate_reasons(features, gates)})
    out = out.withColumn("eligible", F.size("reasons") == 0)
    if partition:
        rank = F.row_number().over(Window.partitionBy(*partition, "eligible").orderBy(F.desc("score"), key))
        return out.withColumn("rank", F.when(F.col("eligible"), rank))
    ranked = numbered(out.where("eligible"), [F.desc("score"), key], "rank")
    return ranked.unionByName(out.where("not eligible").withColumn("rank", F.lit(None).cast("long")))


def sensitivity(df: DataFrame, key: str, features: list[Feature], gates: list[Gate], change: float) -> DataFrame:
    """Lowest, highest and span of the rank as each weight goes down and up by a share; df has n_ columns.

    Scenarios are rows: one explode, one ranking of each scenario by ranges of the score, one aggregate.
    """
    weights = {f.name: f.weight for f in features}
    scenarios = [("base", weights)] + [(f"{n}:{e}", weights | {n: w * (1 + s * change)}) for n, w in weights.items() if w > 0 for e, s in (("low", -1), ("high", 1))]
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(w[f.name])).alias(f"w_{f.name}") for f in features]) for n, w in scenarios])
    rows = df.withColumn("eligible", F.size(gate_reasons(features, gates)) == 0).withColumn("s", F.explode(cases))
    total, score = F.lit(0.0), F.lit(0.0)
    for f in features:
        total = total + F.col(f"s.w_{f.name}")
        score = score + F.coalesce(F.col(f"n_{f.name}") * F.col(f"s.w_{f.name}"), F.lit(0.0))
    rows = rows.select(key, "eligible", F.col("s.scenario").alias("scenario"), F.round(score / total, 8).alias("score"))
    ranked = numbered(rows.where("eligible"), [F.desc("score"), key], "rank", ["scenario"])
    rows = ranked.unionByName(rows.where("not eligible").withColumn("rank", F.lit(None).cast("long")))
    return rows.groupBy(key).agg(F.min("rank").alias("minimum_rank"), F.max("rank").alias("maximum_rank"), (F.max("rank") - F.min("rank")).alias("rank_span"), F.count("*").alias("scenario_count"))
