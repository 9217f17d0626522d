"""Evidence adapters: what is declared, whose evidence it is, what an observation may say, and what is still required."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema of evidence documents, the statuses of observations.
SCHEMA = 1
STATUSES = ("supported", "risk", "context", "not_supported")
#: Adapter, family, suffix of its requirement, class of the requirement, and the stage before which it is due.
ADAPTERS = (
    ("mhc_binding", "immune", "evidence", "required_before_ranking", "integrated_ranking"),
    ("host_similarity", "immune", "evidence", "required_before_ranking", "integrated_ranking"),
    ("epitope_support", "immune", "evidence", "required_before_release", "experiment_release"),
    ("signal_peptide", "developability", "prediction", "design_variable", "experiment_release"),
    ("transmembrane_topology", "developability", "prediction", "design_variable", "experiment_release"),
    ("disorder", "developability", "prediction", "required_before_ranking", "integrated_ranking"),
    ("solubility", "developability", "prediction", "required_before_release", "experiment_release"),
    ("aggregation", "developability", "prediction", "required_before_release", "experiment_release"),
)


def registry(df: DataFrame, family: str | None = None) -> DataFrame:
    """adapter, family, suffix, requirement_class, required_before_stage: a declared list."""
    rows = [a for a in ADAPTERS if family in (None, a[1])]
    return df.sparkSession.createDataFrame(rows, "adapter string, family string, suffix string, requirement_class string, required_before_stage string")


def _first(*faults: tuple[Column, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c, name in faults:
        out = out.when(F.coalesce(c, F.lit(True)), name)
    return out


def declaration_faults(declared: DataFrame) -> DataFrame:
    """declared (adapter, status: provided or not_configured, has_result) -> adapter, fault: unknown_adapter, unknown_status,
    unwanted_result, missing_result, repeated. Nothing if all is well."""
    known = registry(declared).select("adapter", F.lit(True).alias("_known"))
    rows = declared.join(F.broadcast(known), "adapter", "left")  # a declared list
    fault = _first(
        (F.col("_known").isNull(), "unknown_adapter"), (~F.col("status").isin("provided", "not_configured"), "unknown_status"),
        ((F.col("status") == "not_configured") & F.col("has_result"), "unwanted_result"), ((F.col("status") == "provided") & ~F.col("has_result"), "missing_result"),
    )
    twice = declared.groupBy("adapter").count().where("count > 1").select("adapter", F.lit("repeated").alias("fault"))
    return rows.select("adapter", fault.alias("fault")).where("fault is not null").unionByName(twice)


def document_faults(documents: DataFrame, batch_sha256: str, set_sha256: str, bound: bool = False) -> DataFrame:
    """documents (adapter, of: the adapter that it names, schema_version, batch_sha256, set_sha256, tool: name, version, revision)
    -> adapter, fault: identity, candidate_set (another set; or none, if they must be bound), tool (not pinned)."""
    pinned = F.lit(True)
    for part in ("name", "version", "revision"):
        pinned = pinned & (F.trim(F.coalesce(F.col(f"tool.{part}"), F.lit(""))) != "")
    same = (F.col("schema_version") == SCHEMA) & (F.col("of") == F.col("adapter")) & (F.col("batch_sha256") == batch_sha256)
    other = ~F.col("set_sha256").eqNullSafe(F.lit(set_sha256)) if bound else F.coalesce(F.col("set_sha256") != set_sha256, F.lit(False))
    return documents.select("adapter", _first((~same, "identity"), (other, "candidate_set"), (~pinned, "tool")).alias("fault")).where("fault is not null")


def observation_faults(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Observations (adapter, evidence_id, candidate_id, sequence_sha256, start1, end1, status) against candidates (candidate_id,
    sequence_sha256, length): adapter, evidence_id, candidate_id, fault, the first of unknown_candidate, sequence_hash, residue_range,
    status, evidence_id. Nothing if all is well."""
    c = candidates.select("candidate_id", F.col("sequence_sha256").alias("_sha"), F.col("length").alias("_n"))
    rows = observations.join(c, "candidate_id", "left")
    inside = (F.col("start1") >= 1) & (F.col("start1") <= F.col("end1")) & (F.col("end1") <= F.col("_n"))
    fault = _first((F.col("_sha").isNull(), "unknown_candidate"), (F.col("sequence_sha256") != F.col("_sha"), "sequence_hash"), (~inside, "residue_range"), (~F.col("status").isin(*STATUSES), "status"), (F.col("evidence_id").isNull(), "evidence_id"))
    return rows.select("adapter", "evidence_id", "candidate_id", fault.alias("fault")).where("fault is not null")


def states(declared: DataFrame, observations: DataFrame, family: str) -> DataFrame:
    """A family's adapters -> adapter, status (evaluated if its evidence is provided, else not_evaluated), observation_count."""
    n = observations.groupBy("adapter").agg(F.count("*").alias("n"))
    every = registry(declared, family).join(declared.select("adapter", "status"), "adapter", "left").join(n, "adapter", "left")
    given = F.coalesce(F.col("status") == "provided", F.lit(False))
    return every.select("adapter", F.when(given, "evaluated").otherwise("not_evaluated").alias("status"), F.when(given, F.coalesce("n", F.lit(0))).otherwise(0).alias("observation_count"))


def requirements(adapter_states: DataFrame, family: str) -> DataFrame:
    """What adapters that aren't evaluated leave to do: requirement_id, requirement_class, required_before_stage."""
    open_ = registry(adapter_states, family).join(adapter_states.where("status <> 'evaluated'"), "adapter", "left_semi")
    name = F.concat(F.lit("provide-"), F.replace("adapter", F.lit("_"), F.lit("-")), F.lit("-"), F.col("suffix"))
    return open_.select(name.alias("requirement_id"), "requirement_class", "required_before_stage")


def summaries(candidates: DataFrame, adapter_states: DataFrame, observations: DataFrame) -> DataFrame:
    """candidate_id, adapter, status, observation_count and a count of each status, zero where there is none: a row for each candidate
    and adapter of the (short) list. Observations are combined before they meet candidates."""
    counts = observations.groupBy("candidate_id", "adapter").agg(F.count("*").alias("observation_count"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES])
    names = ["observation_count", *[f"{s}_count" for s in STATUSES]]
    held = [(r["adapter"], r["status"]) for r in adapter_states.select("adapter", "status").collect()]  # a row an adapter
    listed = F.array(*[F.struct(F.lit(a).alias("adapter"), F.lit(s).alias("status")) for a, s in sorted(held)])
    every = candidates.select("candidate_id", F.explode(listed).alias("a")).select("candidate_id", "a.adapter", "a.status")
    got = every.join(counts, ["candidate_id", "adapter"], "left")
    given = F.col("status") == "evaluated"
    return got.select("candidate_id", "adapter", "status", *[F.when(given, F.coalesce(n, F.lit(0))).otherwise(0).alias(n) for n in names])


def candidate_states(summary: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """candidate_id, evaluated, categories, status: partial while a category isn't evaluated. others: candidate_id and status of further
    categories, such as surface and conservation."""
    rows = summary.select("candidate_id", "status")
    rows = rows if others is None else rows.unionByName(others.select("candidate_id", "status"))
    got = rows.groupBy("candidate_id").agg(F.count_if(F.col("status") == "evaluated").alias("evaluated"), F.count("*").alias("categories"))
    return got.withColumn("status", F.when(F.col("evaluated") < F.col("categories"), "partial").otherwise("evaluated"))
