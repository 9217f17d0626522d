"""Rules over rows: coding sequences, boundaries, filters with counted drops, stages and deadlines, requirements, feedback, lanes, lineage, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import sequence as fn
from ..functions.constants import CODONS, STOPS
from . import aggregates as ag
from . import joins as jn

#: Annotated exceptions that don't change the translation, requirement classes, routing lanes.
BENIGN_EXCEPTIONS = ("annotated by transcript or proteomic data",)
REQUIREMENT_CLASSES = ("blocking_now", "design_variable", "required_before_ranking", "required_before_release")
LANES = ("priority", "diversity_rescue", "archive")
SEVERITIES = ("error", "warning", "info")


# --- Coding sequences ------------------------------------------------------------------------------------------------


def cds_fault(header: Column, sequence: Column, benign: tuple[str, ...] = BENIGN_EXCEPTIONS) -> Column:
    """The first of twelve reasons why an annotated record is no usable coding sequence; null if it is one.

    Reasons go by the header's [key=value] fields first, then by the sequence (upper case, without its last stop codon).
    """
    fields = fn.header_fields(header)
    values = lambda key: F.transform(F.filter(fields, lambda f: f["key"] == key), lambda f: f["value"])
    lower = lambda key: F.transform(values(key), F.lower)
    codons = fn.triplets(sequence)
    sense = F.when(F.element_at(codons, -1).isin(*STOPS), F.slice(codons, 1, F.size(codons) - 1)).otherwise(codons)
    known = F.array(*map(F.lit, sorted(CODONS)))
    return ag.cds_reason(
        {
            "not_cds": ~F.coalesce(values("gbkey") == F.array(F.lit("CDS")), F.lit(False)),
            "pseudo": F.arrays_overlap(lower("pseudo"), F.array(*map(F.lit, ("true", "yes", "1")))),
            "partial": F.exists(lower("partial"), lambda v: ~v.isin("false", "no", "0")),
            "translation_exception": (F.size(values("transl_except")) > 0) | F.exists(values("exception"), lambda v: ~v.isin(*benign)),
            "nonstandard_translation_table": F.exists(values("transl_table"), lambda v: v != "1"),
            "missing_gene_id": fn.gene_id(header).isNull(),
            "empty_sequence": sequence == "",
            "ambiguous_or_invalid_base": F.translate(sequence, "ACGT", "") != "",
            "length_not_multiple_of_three": F.length(sequence) % 3 != 0,
            "no_sense_codons": F.size(sense) == 0,
            "internal_stop": F.arrays_overlap(sense, F.array(*map(F.lit, STOPS))),
            "unknown_codon": F.size(F.array_except(sense, known)) > 0,
        }
    )


def longest_valid(records: DataFrame) -> DataFrame:
    """header, sequence -> gene, sequence: of each gene's usable records the longest, of equal ones the first by text."""
    good = records.where(cds_fault(F.col("header"), F.col("sequence")).isNull()).select(fn.gene_id(F.col("header")).alias("gene"), "sequence")
    return ag.best_of(good, ["gene"], "sequence", [-F.length("sequence"), F.col("sequence")])


def cds_selection(records: DataFrame) -> DataFrame:
    """One row: records, accepted, genes, distinct sequences among the selected, and reasons (a map of reason to count)."""
    reason = cds_fault(F.col("header"), F.col("sequence"))
    by = records.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    counts = by.agg(F.sum("n").alias("records"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("accepted"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"))
    chosen = longest_valid(records).agg(F.count("*").alias("genes"), F.countDistinct("sequence").alias("distinct_sequences"))
    return counts.join(F.broadcast(chosen))  # one row each


def coding_constraints(cds: Column, least_gc: float, most_gc: float, longest_run: int, motifs: tuple[str, ...]) -> Column:
    """Whether GC content, homopolymers and forbidden motifs are within what a construct may have."""
    gc = fn.fraction(cds, "GC")
    free = ~F.lit(False)
    for m in motifs:
        free = free & ~F.contains(cds, F.lit(m))
    return (gc >= least_gc) & (gc <= most_gc) & (fn.longest_homopolymer(cds) <= longest_run) & free


# --- Filters with counted drops --------------------------------------------------------------------------------------


def allowed_intervals(intervals: DataFrame, key: str, ident: str, length: Column, least: int, excluded: DataFrame) -> DataFrame:
    """Intervals (key, ident, start1, end1) within their source, long enough, that overlap no excluded interval of it."""
    rows = intervals.where((F.col("start1") >= 1) & (F.col("end1") <= length) & (F.col("end1") - F.col("start1") + 1 >= least))
    a = jn.binned(rows.select(key, ident, "start1", "end1"), "start1", "end1")
    b = jn.binned(excluded.select(key, F.col("start1").alias("x_start"), F.col("end1").alias("x_end")), "x_start", "x_end")
    hit = a.join(b, [key, "bin"]).where((F.col("start1") <= F.col("x_end")) & (F.col("x_start") <= F.col("end1"))).select(ident).distinct()
    return rows.join(hit, ident, "left_anti")


def length_and_duplicates(df: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """df with status: length_filtered, duplicate_filtered (the text came with a smaller key) or kept."""
    fits = F.length(text) <= longest
    first = F.min(F.when(fits, F.col(key))).over(Window.partitionBy(text))
    return df.withColumn("status", F.when(~fits, "length_filtered").when(F.col(key) > first, "duplicate_filtered").otherwise("kept"))


def covered_conservation(df: DataFrame, group: str, least: float) -> DataFrame:
    """conservation and coverage of residues -> for each group the evaluated share, mean and least conservation of the
    residues whose coverage suffices, and whether there are any."""
    usable = F.col("conservation").isNotNull() & (F.col("coverage") >= least)
    v = F.when(usable, F.col("conservation"))
    out = df.groupBy(group).agg(F.avg(usable.cast("double")).alias("evaluated_fraction"), F.avg(v).alias("mean_conservation"), F.min(v).alias("least_conservation"))
    return out.withColumn("status", F.when(F.col("mean_conservation").isNull(), "not_evaluated").otherwise("evaluated"))


# --- Stages, deadlines, requirements, feedback -----------------------------------------------------------------------


def due(required: Column, current: Column, targets: Column, stages: list[str]) -> Column:
    """Whether an open action blocks a handoff: its stage is here or past, or is a target; an unknown stage always blocks."""
    place = lambda c: F.array_position(F.array(*map(F.lit, stages)), c)
    unknown = (place(required) == 0) | (place(current) == 0) | F.exists(targets, lambda t: place(t) == 0)
    return unknown | (place(required) <= place(current)) | F.array_contains(targets, required)


def blocking_actions(actions: DataFrame, current: str, stages: list[str]) -> DataFrame:
    """action, required_stage, executes (whether it stops execution) -> for each stage as the next: due actions, those of
    them that block execution, and the first of them."""
    targets = actions.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    found = actions.join(F.broadcast(targets), due(F.col("required_stage"), F.lit(current), F.array("stage"), stages))  # the declared stages
    return found.groupBy("stage").agg(F.count("*").alias("n_due"), F.count_if("executes").alias("n_blocking"), F.min("action").alias("first_due"), F.min(F.when(F.col("executes"), F.col("action"))).alias("first_blocking"))


def requirements(df: DataFrame, stages: list[str]) -> DataFrame:
    """requirement_id, requirement_class, required_before_stage -> typed rows: status, whether exploration may go on. An
    unknown class or stage is an error."""
    bad = F.when(~F.col("requirement_class").isin(*REQUIREMENT_CLASSES), F.concat(F.lit("unknown requirement class: "), "requirement_class")).when(~F.col("required_before_stage").isin(*stages), F.concat(F.lit("unknown stage: "), "required_before_stage"))
    ok = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.lit("missing"))
    return df.select("requirement_id", ok.alias("status"), "requirement_class", "required_before_stage", (F.col("requirement_class") != "blocking_now").alias("exploratory_progress_allowed"))


def counted(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A row for each value with its count, 0 where there is none; another value is an error."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    ok = F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null"))))).otherwise(F.col("n"))
    every = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"{column} string, place int")
    return every.join(found.select(column, ok.alias("n")), column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def ratios(df: DataFrame, group: list[str], numerator: Column) -> DataFrame:
    """numerator (rows that hold), denominator (rows), ratio."""
    out = df.groupBy(*group).agg(F.count_if(numerator).alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("ratio", F.try_divide("numerator", "denominator"))


def feedback(documents: dict[str, DataFrame], key: str) -> DataFrame:
    """Requests of all stages: origin_stage, place (by stage, then key), their columns. A key that comes twice is an error."""
    rows = None
    for stage, df in documents.items():
        one = df.select(F.lit(stage).alias("origin_stage"), *df.columns)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    n = F.count("*").over(Window.partitionBy(key))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate request: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return rows.withColumn(key, ok)


# --- Orders, jobs, lineage, lanes ------------------------------------------------------------------------------------


def parent_orders(parents: DataFrame, slot: str, key: str, priority: str, limit: int) -> DataFrame:
    """One parent from each of two slots, in both orders, distinct: the first by mean priority, then by the hash of the keys.

    Only the `limit` best of a slot and the ties of the last can be in the first `limit` orders' halves, so both slots are
    cut there before they meet.
    """
    rank = F.rank().over(Window.partitionBy(slot).orderBy(F.desc(priority)))
    best = parents.withColumn("_r", rank).where(F.col("_r") <= limit + 1)
    a = best.where(F.col(slot) == 0).select(F.col(key).alias("a"), F.col(priority).alias("pa"))
    b = best.where(F.col(slot) == 1).select(F.col(key).alias("b"), F.col(priority).alias("pb"))
    pairs = a.join(F.broadcast(b), F.col("a") != F.col("b"))  # at most limit + 1 and ties
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("first"), F.col("b").alias("second")), F.struct(F.col("b").alias("first"), F.col("a").alias("second")))).alias("o"), ((F.col("pa") + F.col("pb")) / 2).alias("mean"))
    rows = both.select("o.first", "o.second", "mean").distinct()
    return rows.withColumn("digest", hs.sha256(F.concat_ws("|", F.col("first").cast("string"), F.col("second").cast("string")))).orderBy(F.desc("mean"), "digest").limit(limit)


def mutable_positions(sequence: Column, flank: int, protected: Column) -> Column:
    """Places (from one) in the first and last `flank` residues, without the protected ones and without cysteines."""
    n = F.length(sequence)
    ends = F.array_union(F.sequence(F.lit(1), F.least(F.lit(flank), n)), F.sequence(F.greatest(F.lit(1), n - flank + 1), n))
    cysteines = F.transform(F.filter(F.transform(fn.letters(sequence), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: x["c"] == "C"), lambda x: x["i"])
    return F.when(n > 0, F.array_sort(F.array_except(ends, F.array_union(protected, cysteines)))).otherwise(F.array().cast("array<int>"))


def concatenations(parents: DataFrame, key: str, order: str, text: str, linkers: list[str], longest: int) -> DataFrame:
    """Parents in order with each of the linkers between them -> key, linker, sequence, for those that aren't too long."""
    whole = parents.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("_ts"))
    made = whole.withColumn("linker", F.explode(F.array(*map(F.lit, linkers))))
    joined = F.aggregate(F.slice("_ts", 2, F.size("_ts")), F.col("_ts")[0], lambda s, t: F.concat(s, F.col("linker"), t))
    return made.select(key, "linker", joined.alias("sequence")).where(F.length("sequence") <= longest)


def seeds(batch: DataFrame, kind: str, components: str) -> DataFrame:
    """batch with part: source_control (which must have exactly one source component) or manual."""
    one = (F.size(components) == 1) & (F.col(components)[0] == "source_segment")
    ok = F.when(F.col(kind) != "source_control", "manual").when(one, "source_control").otherwise(F.raise_error(F.lit("a source control has no exact source component")))
    return batch.withColumn("part", ok)


def lanes(df: DataFrame, band: Column, priority: list[str], forced: Column) -> DataFrame:
    """df with lane and reason before any rescue: priority by band, rescue of forced generators, null for the others."""
    by_band = band.isin(*priority)
    return df.withColumn("lane", F.when(by_band, LANES[0]).when(forced, LANES[1])).withColumn("reason", F.when(by_band, "structure_confidence_priority").when(forced, "forced_control_rescue"))


def lane_counts(df: DataFrame, drafting: list[str], expensive: list[str]) -> DataFrame:
    """Counts of each lane, 0 where none, and how many are eligible for drafting and for expensive follow-up."""
    got = counted(df.select("lane"), "lane", LANES)
    return got.select("lane", "n", F.when(F.col("lane").isin(*drafting), F.col("n")).otherwise(0).alias("drafting"), F.when(F.col("lane").isin(*expensive), F.col("n")).otherwise(0).alias("expensive"))


def job_records(candidates: DataFrame, longest: int) -> DataFrame:
    """candidate_id, sequence, sequence_sha256 -> job records of those with canonical residues, a fitting length and the
    declared hash, and the reason for the others."""
    canonical = F.translate("sequence", "ACDEFGHIKLMNPQRSTVWY", "") == ""
    reason = F.when(F.length("sequence") == 0, "empty").when(~canonical, "not_canonical").when(F.length("sequence") > longest, "too_long").when(hs.sha256(F.col("sequence")) != F.col("sequence_sha256"), "hash_differs")
    return candidates.select("candidate_id", F.length("sequence").alias("length"), reason.alias("reason"))


def input_audit(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row for each row of df and failed check: key, requirement, action (an id of both)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    rows = df.select(key, F.explode(failed).alias("requirement"))
    return rows.withColumn("action", hs.short_id("action-", 12, F.col(key).cast("string"), F.col("requirement")))


# --- Evidence adapters -----------------------------------------------------------------------------------------------


def adapter_summary(spine: DataFrame, key: str, evidence: DataFrame, adapters: list[str]) -> DataFrame:
    """Evidence (key, adapter, status, start1, end1) -> for each key and declared adapter: status (evaluated if it has rows),
    counts of supported and risk rows, and the residues that they cover, overlaps once."""
    from . import windows as wi

    every = spine.select(key, F.explode(F.array(*map(F.lit, adapters))).alias("adapter"))
    mine = evidence.where(F.col("adapter").isin(*adapters))
    counts = mine.groupBy(key, "adapter").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status") == "risk").alias("risk"))
    covered = wi.merge_intervals(mine.select(key, "adapter", "start1", "end1"), [key, "adapter"]).groupBy(key, "adapter").agg(F.sum(F.col("end1") - F.col("start1") + 1).alias("residues"))
    got = every.join(counts, [key, "adapter"], "left").join(covered, [key, "adapter"], "left").fillna(0, ["n", "supported", "risk", "residues"])
    return got.withColumn("state", F.when(F.col("n") > 0, "evaluated").otherwise("not_evaluated"))


def residue_rollup(residues: DataFrame, key: str, least_coverage: float) -> DataFrame:
    """exposed, conservation and coverage of residues -> exposed share, conservation of the covered ones, status (partial if
    nothing is covered)."""
    usable = F.col("conservation").isNotNull() & (F.col("coverage") >= least_coverage)
    v = F.when(usable, F.col("conservation"))
    out = residues.groupBy(key).agg(F.avg(F.col("exposed").cast("double")).alias("exposed_fraction"), F.avg(usable.cast("double")).alias("evaluated_fraction"), F.avg(v).alias("mean_conservation"), F.min(v).alias("least_conservation"))
    return out.withColumn("status", F.when(F.col("evaluated_fraction") > 0, "evaluated").otherwise("partial"))


def exact_segments(predictions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """predictions (key, pos, label) of exactly the candidates' keys -> runs of labels; a key of one side only is an error."""
    from . import windows as wi

    sides = predictions.select(key).distinct().withColumn("_a", F.lit(1)).join(candidates.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("predictions and candidates differ"))).otherwise(F.lit(True))
    return wi.label_runs(predictions.join(sides.select(key, ok.alias("_ok")).where("_ok"), key).drop("_ok"), [key], "pos", "label")


def followed_up(designs: DataFrame, scores: DataFrame, key: str, identity: str) -> DataFrame:
    """Designs with their scores; a score of another identity, a design without one or a score without a design is an error."""
    d, s = designs.alias("d"), scores.alias("s")
    j = d.join(s, F.col(f"d.{key}") == F.col(f"s.{key}"), "full_outer")
    bad = F.col(f"d.{key}").isNull() | F.col(f"s.{key}").isNull() | (F.col(f"d.{identity}") != F.col(f"s.{identity}"))
    ok = F.when(bad, F.raise_error(F.lit("scores don't match designs"))).otherwise(F.col(f"d.{key}"))
    return j.select(ok.alias(key), F.col(f"d.{identity}").alias(identity), "s.score")
