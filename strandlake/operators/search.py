"""Candidate search: interval and fusion features, boundary anchors, products, tilings, mutation masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as fn
from .joins import seed_and_extend

#: Names of the features that an interval's priority weighs.
INTERVAL_FEATURES = ("retention", "confidence", "order", "boundary", "compactness")


def weighted(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight times value over the sum of positive weights; 0 without any."""
    total = sum(w for w in weights.values() if w > 0)
    out = F.lit(0.0)
    for k, v in values.items():
        out = out + F.lit(float(weights[k])) * v
    return out / total if total else F.lit(0.0)


def interval_features(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """start1, end1, source_length, held and all epitopes, covered low-confidence and disordered residues, distance to
    the nearest declared boundary -> the five features and priority. Nothing to retain, or no boundary, counts 0.5."""
    n = F.col("end1") - F.col("start1") + 1
    values = {
        "retention": F.coalesce(F.try_divide("held_epitopes", "all_epitopes"), F.lit(0.5)),
        "confidence": 1.0 - F.col("low_residues") / n,
        "order": 1.0 - F.col("disordered_residues") / n,
        "boundary": F.coalesce(1.0 / (1.0 + F.col("boundary_distance") / 12.0), F.lit(0.5)),
        "compactness": 1.0 - n / F.col("source_length"),
    }
    return df.withColumns({k: F.round(v, 6) for k, v in values.items()} | {"priority": F.round(weighted(values, weights), 6)})


def fusion_features(parents: DataFrame, key: str, features: list[str], longest: int) -> DataFrame:
    """A row for each parent (length, features) -> for each fusion the features' means weighted by length, and compactness."""
    means = [F.try_divide(F.sum(F.col(f) * F.col("length")), F.sum("length")).alias(f) for f in features]
    return parents.groupBy(key).agg(*means, (1.0 - F.sum("length") / longest).alias("compactness"))


def anchors(parts: dict[str, DataFrame]) -> DataFrame:
    """key, pos of several sources -> key, pos, sources (sorted)."""
    rows = None
    for name, df in parts.items():
        one = df.select("key", "pos", F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key", "pos").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def boundary_grid(starts: DataFrame, ends: DataFrame, offsets: list[int], least: int) -> DataFrame:
    """Starts and ends of a key, each moved by offsets, with the best score of each (start, end): key, s, e, score."""
    moved = lambda df, n: df.select("key", "pos", "score", F.explode(F.array(*map(F.lit, offsets))).alias("_o")).select("key", (F.col("pos") + F.col("_o")).alias(n), F.col("score").alias(f"{n}_score"))
    a = moved(starts, "s").groupBy("key", "s").agg(F.max("s_score").alias("s_score"))
    b = moved(ends, "e").groupBy("key", "e").agg(F.max("e_score").alias("e_score"))
    pairs = a.join(b, "key").where((F.col("s") >= 1) & (F.col("e") - F.col("s") + 1 >= least))
    return pairs.select("key", "s", "e", (F.col("s_score") + F.col("e_score")).alias("score"))


def best_boundaries(starts: DataFrame, ends: DataFrame, offsets: list[int], least: int) -> DataFrame:
    """The best (start, end) of each key, both moved by offsets, of at least `least` places: key, s, e, score, and n, the number of
    such pairs. Ties go to the smallest start, then the smallest end.

    Of a start only the best end at or beyond s + least - 1 counts: a maximum over the ends from the right, which one sorted
    pass keeps, with their number. No start meets an end, so a key costs the sum of its starts and ends, not their product.
    """
    moved = lambda df: df.select("key", "pos", "score", F.explode(F.array(*map(F.lit, offsets))).alias("_o")).select("key", (F.col("pos") + F.col("_o")).alias("p"), "score").groupBy("key", "p").agg(F.max("score").alias("score"))
    a = moved(starts).where("p >= 1").select("key", (F.col("p") + least - 1).alias("at"), F.lit(1).alias("kind"), "p", "score")
    b = moved(ends).select("key", F.col("p").alias("at"), F.lit(0).alias("kind"), "p", "score")
    # From the right; at one place ends come before starts.
    right = Window.partitionBy("key").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("kind") == 0, F.struct("score", (-F.col("p")).alias("e")))
    seen = a.unionByName(b).select("key", "kind", "p", "score", F.max(end).over(right).alias("best"), F.sum(1 - F.col("kind")).over(right).alias("n"))
    seen = seen.where("kind = 1 and best is not null")
    top = F.max(F.struct((F.col("score") + F.col("best.score")).alias("score"), (-F.col("p")).alias("s"), F.col("best.e").alias("e"))).alias("t")
    return seen.groupBy("key").agg(top, F.sum("n").alias("n")).select("key", (-F.col("t.s")).alias("s"), (-F.col("t.e")).alias("e"), "t.score", "n")


def linker_patterns(linkers: DataFrame, junctions: int) -> DataFrame:
    """All ways to put one of the linkers (a small table) on each junction: l1 .. ln, text."""
    out = linkers.select(F.col("linker").alias("l1"))
    for k in range(2, junctions + 1):
        out = out.join(linkers.select(F.col("linker").alias(f"l{k}")), F.lit(True))
    return out.withColumn("text", F.concat(*[f"l{k}" for k in range(1, junctions + 1)]))


def mutation_faults(parent: Column, variant: Column, mutable: Column, protected: Column, most: int) -> Column:
    """Why a variant is refused: length, a change outside mutable or inside protected places (from one), too many changes."""
    changed = F.filter(F.transform(fn.indexes(F.length(parent)), lambda i: F.when(F.substr(parent, i + 1, F.lit(1)) != F.substr(variant, i + 1, F.lit(1)), i + 1)), lambda x: x.isNotNull())

    def of(c: Column) -> Column:
        found = F.array(F.when(F.length(parent) != F.length(variant), "length"), F.when(F.size(F.array_except(c, mutable)) > 0, "not_mutable"), F.when(F.size(F.array_intersect(c, protected)) > 0, "protected"), F.when(F.size(c) > most, "too_many"))
        return F.filter(found, lambda x: x.isNotNull())

    return fn.let(changed, of)


def reconstructed(components: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Components in order -> key, their concatenation, and each one's begin and end (from one) in it."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.length(text)
    end = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = components.select(key, F.struct(order, F.col(text).alias("t"), (end - n + 1).alias("start1"), end.alias("end1")).alias("c"))
    got = rows.groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    return got.select(key, F.array_join(F.transform("cs", lambda c: c["t"]), "").alias("sequence"), F.transform("cs", lambda c: F.struct(c["start1"].alias("start1"), c["end1"].alias("end1"))).alias("places"))


def tile(queries: DataFrame, key: str, text: str, library: list[tuple[str, str]]) -> DataFrame:
    """Each query as an exact sequence of library entries (a small list), the longest first at each place: key, names or
    null. A place where none fits ends it."""
    entries = sorted((e for e in library if e[1]), key=lambda x: (-len(x[1]), x[0]))
    names: dict[str, str] = {}
    for name, part in entries:
        names.setdefault(part, name)
    # The first alternative that fits is taken at each place; what is passed over is missing from the joined parts.
    parts = F.regexp_extract_all(F.col(text), F.lit("(" + "|".join(f"\\Q{p}\\E" for p in names) + ")"), F.lit(1))
    return queries.select(key, fn.let(parts, lambda ps: F.when(F.array_join(ps, "") == F.col(text), F.transform(ps, lambda p: fn.literal_map(names)[p]))).alias("names"))


def segments(queries: DataFrame, key: str, text: str, library: DataFrame, name: str, source: str, least: int = 8) -> DataFrame:
    """Greedy cut of each query into runs of library texts (the longest at each place, ties to the greater name and
    offset; least letters at least) and additions: key, place, source (null: addition), start0, length, offset0.

    The best run of every place comes from seed_and_extend(); where a run begins the next one begins at or after its end, so
    one fold over a query's runs, in the order of their places, picks those that the greedy cut takes. The gaps between
    are additions. Texts without any letters have no parts.
    """
    best = seed_and_extend(queries, library, (key, text), (name, source), least)
    run = F.struct(F.col("q_at").alias("start0"), "length", F.col("l_id").alias("source"), F.col("l_at").alias("offset0"))
    runs = best.groupBy(F.col("q_id").alias(key)).agg(F.sort_array(F.collect_list(run)).alias("runs"))
    rows = queries.select(key, F.length(text).alias("n")).where("n > 0").join(runs, key, "left")
    none = F.slice(F.col("runs"), 1, 0)
    step = lambda s, r: F.when(r["start0"] >= s["at"], F.struct(F.concat(s["taken"], F.array(r)).alias("taken"), (r["start0"] + r["length"]).alias("at"))).otherwise(s)
    taken = F.aggregate("runs", F.struct(none.alias("taken"), F.lit(0).alias("at")), step)["taken"]
    rows = rows.select(key, "n", F.when(F.col("runs").isNotNull(), taken).alias("taken"))
    blank = rows.select(F.element_at(F.col("taken"), 1).alias("t")).schema["t"].dataType
    added = lambda a, b: F.struct(a.alias("start0"), (b - a).alias("length"), F.lit(None).cast(blank["source"].dataType).alias("source"), F.lit(None).cast("int").alias("offset0"))
    # Before each run, and after the last one, what no run covers.
    ends = F.concat(F.array(F.lit(0)), F.transform("taken", lambda r: r["start0"] + r["length"]))
    begins = F.concat(F.transform("taken", lambda r: r["start0"]), F.array(F.col("n")))
    gaps = F.when(F.col("taken").isNull(), F.array(added(F.lit(0), F.col("n")))).otherwise(F.zip_with(ends, begins, added))
    parts = F.array_sort(F.concat(F.coalesce("taken", F.array().cast(rows.schema["taken"].dataType)), F.filter(gaps, lambda g: g["length"] > 0)))
    out = rows.select(key, F.posexplode(parts).alias("place", "p"))
    return out.select(key, "place", "p.source", "p.start0", "p.length", "p.offset0")
