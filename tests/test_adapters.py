"""Evidence adapters, shards and digests on small rows."""

from pyspark.sql import functions as F

from strandlake.operators import adapters as ad
from strandlake.operators import aggregates, windows
from strandlake.sources import sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_declarations_and_documents(spark):
    declared = spark.createDataFrame([("disorder", "provided", False), ("solubility", "not_configured", True), ("magic", "provided", True), ("mhc_binding", "later", True), ("aggregation", "provided", True), ("aggregation", "provided", True), ("epitope_support", None, False)], "adapter string, status string, has_result boolean")
    assert rows(ad.declaration_faults(declared), "adapter", "fault") == [("aggregation", "repeated"), ("disorder", "missing_result"), ("epitope_support", "unknown_status"), ("magic", "unknown_adapter"), ("mhc_binding", "unknown_status"), ("solubility", "unwanted_result")]
    tool = ("t", "1", "r")
    docs = [("a", "a", 1, "b", "s", tool), ("c", "d", 1, "b", "s", tool), ("e", "e", 2, "b", "s", tool), ("f", "f", 1, "x", "s", tool), ("g", "g", 1, "b", "z", tool), ("h", "h", 1, "b", None, tool), ("i", "i", 1, "b", "s", ("t", " ", "r")), ("j", "j", 1, "b", "s", None)]
    df = spark.createDataFrame(docs, "adapter string, of string, schema_version int, batch_sha256 string, set_sha256 string, tool struct<name: string, version: string, revision: string>")
    loose = [("c", "identity"), ("e", "identity"), ("f", "identity"), ("g", "candidate_set"), ("i", "tool"), ("j", "tool")]
    assert rows(ad.document_faults(df, "b", "s"), "adapter", "fault") == loose
    assert rows(ad.document_faults(df, "b", "s", bound=True), "adapter", "fault") == sorted([*loose, ("h", "candidate_set")])


def test_observations_counts_and_requirements(spark):
    candidates = spark.createDataFrame([(1, "x", 10), (2, "y", 5)], "candidate_id long, sequence_sha256 string, length int")
    seen = [("disorder", "e1", 1, "x", 1, 10, "risk"), ("disorder", "e2", 3, "x", 1, 2, "risk"), ("disorder", "e3", 2, "x", 1, 2, "risk"), ("solubility", "e4", 2, "y", 1, 6, "context"), ("solubility", "e5", 2, "y", 3, 2, "context"), ("solubility", "e6", 2, "y", 1, 5, "good"), ("solubility", None, 2, "y", 1, 5, "supported"), ("solubility", "e8", 2, "y", None, 5, "supported")]
    obs = spark.createDataFrame(seen, "adapter string, evidence_id string, candidate_id long, sequence_sha256 string, start1 int, end1 int, status string")
    assert {(r["evidence_id"], r["fault"]) for r in ad.observation_faults(obs, candidates).collect()} == {("e2", "unknown_candidate"), ("e3", "sequence_hash"), ("e4", "residue_range"), ("e5", "residue_range"), ("e6", "status"), (None, "evidence_id"), ("e8", "residue_range")}
    declared = spark.createDataFrame([("disorder", "provided", True), ("solubility", "provided", True), ("aggregation", "not_configured", False)], "adapter string, status string, has_result boolean")
    states = ad.states(declared, obs, "developability")
    assert rows(states, "adapter", "status", "observation_count") == [("aggregation", "not_evaluated", 0), ("disorder", "evaluated", 3), ("signal_peptide", "not_evaluated", 0), ("solubility", "evaluated", 5), ("transmembrane_topology", "not_evaluated", 0)]
    assert rows(ad.requirements(states, "developability"), "requirement_id", "requirement_class") == [("provide-aggregation-prediction", "required_before_release"), ("provide-signal-peptide-prediction", "design_variable"), ("provide-transmembrane-topology-prediction", "design_variable")]
    summary = ad.summaries(candidates, states, obs)
    assert summary.count() == 10 and rows(summary.where("candidate_id = 2 and adapter = 'solubility'"), "observation_count", "supported_count", "context_count", "risk_count") == [(5, 2, 2, 0)]
    assert rows(ad.candidate_states(summary), "candidate_id", "evaluated", "categories", "status") == [(1, 2, 5, "partial"), (2, 2, 5, "partial")]
    every = summary.withColumn("status", F.lit("evaluated"))
    more = spark.createDataFrame([(1, "not_evaluated"), (2, "evaluated")], "candidate_id long, status string")
    assert rows(ad.candidate_states(every, more), "candidate_id", "status") == [(1, "partial"), (2, "evaluated")]


def test_shards_of_lines_part_copies_and_are_kept(spark, tmp_path):
    lines = spark.createDataFrame([(k, "same" if k % 2 else f"line {k}") for k in range(400)] + [(999, "  ")], "at long, value string")
    at = str(tmp_path / "s")
    got = {r["shard"]: (r["lines"], r["bytes"]) for r in sinks.write_shards(lines, at, 4, 7, ["at"]).collect()}
    assert sum(n for n, _ in got.values()) == 400 and min(n for n, _ in got.values()) > 60
    held = spark.read.option("basePath", at).text(at).where("value = 'same'")
    assert held.select("shard").distinct().count() == 4
    files = sorted(p.name for p in (tmp_path / "s").rglob("part-*"))
    sinks.write_shards(lines, at, 4, 7, ["at"])
    assert sorted(p.name for p in (tmp_path / "s").rglob("part-*")) == files
    sinks.write_shards(lines.where("at < 100"), at, 4, 7, ["at"])
    assert spark.read.option("basePath", at).text(at).count() == 100 and sorted(p.name for p in (tmp_path / "s").rglob("part-*")) != files


def test_digests_of_sets(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    one = aggregates.bucketed_digest(df, ["id", "v"]).first()
    assert one["n"] == 3000 and aggregates.bucketed_digest(df.unionByName(df).repartition(9), ["id", "v"]).first() == one
    assert aggregates.bucketed_digest(df.where("id > 0"), ["id", "v"]).first()["digest"] != one["digest"]


def test_low_complexity(spark):
    df = spark.createDataFrame([(1, "ACDEFGHIKLMN" + "AAAAAAAAAAAA" + "ACDEFGHIKLMN"), (2, "AC")], "k int, seq string")
    (r,) = windows.low_complexity_regions(df, ["k"], "ACDEFGHIKLMNPQRSTVWY").collect()
    assert r["k"] == 1 and r["start1"] < 13 and r["end1"] > 24
