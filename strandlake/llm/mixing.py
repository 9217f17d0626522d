"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words in a block, words of a shard that shards are counted by, shards at least (powers of two), documents in a bucket
#: of the running sum, seed.
BLOCK_WORDS, SHARD_WORDS, SHARDS, BUCKET, SEED = 4096, 1 << 24, 16, 2000, 42
#: Rounds of a permutation, and steps back into its domain: the domain exceeds the blocks by less than its shorter side,
#: so either so many steps are always enough or each one misses with a chance under 1/25.
_ROUNDS, _WALK = 4, 24


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of the values, each of which is computed once."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), body)[0]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text -> row (numbers the rows), doc_id, source, size (words), copy (of the whole row), for each row."""
    text = F.col("text").cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"), _copy().alias("copy"))


def _copy() -> Column:
    return F.xxhash64(F.lit(SEED), F.coalesce(F.col("source").cast("string"), F.lit("\0")), F.coalesce(F.col("text").cast("string"), F.lit("\0")))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, n (rows), i (rank by code point, null last), target.

    The targets share all words by weight, none above max_repeats times its source; the excess goes to the others by
    weight until none is above. This is a level l with sum(min(cap, l * weight)) = all words: a source is at its cap
    if the level at which it gets there takes no more than all words. One row a source; windows over those rows.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("i", F.row_number().over(order) - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(max_repeats))
    level, everything = F.col("cap") / F.col("w"), Window.partitionBy()
    upto = Window.orderBy("level", "i").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("level", level).withColumn("all", F.sum("source_size").over(everything).cast("double"))
    by = by.withColumn("used", F.sum("cap").over(upto) + F.col("level") * (F.sum("w").over(everything) - F.sum("w").over(upto)))
    capped = F.col("used") <= F.col("all")
    free = F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).over(everything)
    rest = F.col("all") - F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).over(everything)
    return by.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("w") * rest / free)).select("source", "source_size", "n", F.col("i").cast("int").alias("i"), "target")


def _hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """The u-quantile of how many good ones are among `draws` of `pop`, by summing the exact mass outwards.

    Log masses run from the lower bound by the ratio of neighbours, are taken relative to the mode, and are summed
    within 9 standard deviations and 16 more, beyond which a double holds no mass.
    """
    p, g, d = pop.cast("double"), good.cast("double"), draws.cast("double")
    sd = F.sqrt(F.greatest(d * g / F.greatest(p, F.lit(1.0)) * (1 - g / F.greatest(p, F.lit(1.0))), F.lit(0.0)))

    def bounded(v: Column) -> Column:
        lo = F.greatest(F.lit(0), v["draws"] - (v["pop"] - v["good"]), v["mode"] - v["reach"]).cast("long")
        hi = F.least(v["good"], v["draws"], v["mode"] + v["reach"]).cast("long")
        return _let({"lo": lo, "hi": hi, "mode": v["mode"], "p": v["pop"].cast("double"), "g": v["good"].cast("double"), "d": v["draws"].cast("double"), "u": v["u"]}, from_mode)

    def step(v: Column, k: Column) -> Column:  # from k to k + 1
        return F.log((v["g"] - k) * (v["d"] - k) / ((k + 1) * (v["p"] - v["g"] - v["d"] + k + 1)))

    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def from_mode(v: Column) -> Column:
        top = F.aggregate(upto(v["lo"], F.least(F.greatest(v["mode"], v["lo"]), v["hi"])), F.lit(0.0), lambda s, k: s + step(v, k.cast("double")))
        return _let({"v": v, "top": top}, summed)

    def summed(w: Column) -> Column:
        def add(s: Column, k: Column) -> Column:
            return _let({"l": s["l"] + step(w["v"], k.cast("double")), "t": s["t"]}, lambda n: F.struct(n["l"].alias("l"), (n["t"] + F.exp(n["l"])).alias("t")))

        first = F.struct((-w["top"]).alias("l"), F.exp(-w["top"]).alias("t"))
        whole = F.aggregate(upto(w["v"]["lo"], w["v"]["hi"]), first, add)["t"]
        return _let({"v": w["v"], "top": w["top"], "goal": w["v"]["u"] * whole}, found)

    def found(w: Column) -> Column:
        def walk(s: Column, k: Column) -> Column:
            n = F.struct((s["l"] + step(w["v"], k.cast("double"))).alias("l"))
            on = F.transform(F.array(n), lambda x: F.struct(x["l"].alias("l"), (s["t"] + F.exp(x["l"])).alias("t"), (k + 1).alias("x")))[0]
            return F.when(s["t"] < w["goal"], on).otherwise(s)

        first = F.struct((-w["top"]).alias("l"), F.exp(-w["top"]).alias("t"), w["v"]["lo"].alias("x"))
        return F.aggregate(upto(w["v"]["lo"], w["v"]["hi"]), first, walk)["x"]

    mode = F.floor((d + 1) * (g + 1) / (p + 2)).cast("long")
    return _let({"pop": pop, "good": good, "draws": draws, "mode": mode, "reach": (F.ceil(sd * 9) + 16).cast("long"), "u": u}, bounded)


def _permuted(x: Column, n: Column, key: list[Column], back: bool = False) -> Column:
    """Where a permutation of 0 to n - 1, which key picks, takes x; back: what it takes to x.

    x is a cell of a table of about the square root of n rows and columns. A round moves it down its column by a hash
    of the column, then along its row by a hash of the row, which can be undone; cells beyond n go on until they
    are within.
    """

    def shift(side: str, k: Column, of: Column, m: Column) -> Column:
        return F.pmod(F.xxhash64(*key, F.lit(side), k, of), m)

    def once(v: Column, cell: Column) -> Column:
        def there(s: Column, k: Column) -> Column:
            return _let({"a": F.pmod(s["a"] + shift("a", k, s["b"], v["rows"]), v["rows"]), "b": s["b"]}, lambda t: F.struct(t["a"].alias("a"), F.pmod(t["b"] + shift("b", k, t["a"], v["columns"]), v["columns"]).alias("b")))

        def home(s: Column, k: Column) -> Column:
            return _let({"a": s["a"], "b": F.pmod(s["b"] - shift("b", k, s["a"], v["columns"]), v["columns"])}, lambda t: F.struct(F.pmod(t["a"] - shift("a", k, t["b"], v["rows"]), v["rows"]).alias("a"), t["b"].alias("b")))

        start = F.struct(F.floor(cell / v["columns"]).cast("long").alias("a"), F.pmod(cell, v["columns"]).alias("b"))
        rounds = F.sequence(F.lit(_ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(_ROUNDS))
        return _let({"s": F.aggregate(rounds, start, home if back else there)}, lambda t: t["s"]["a"] * v["columns"] + t["s"]["b"])

    def walked(v: Column) -> Column:
        within = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(v, v["x"]), lambda c, _: F.when(c < v["n"], c).otherwise(once(v, c)))
        return _let({"c": within}, lambda t: F.when(t["c"] < v["n"], t["c"]).otherwise(F.raise_error(F.lit("a permutation left its domain"))))

    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return _let({"x": x, "n": n, "rows": rows, "columns": F.ceil(n / rows).cast("long")}, walked)


def _key(seed: int, i: Column, repeat: Column) -> list[Column]:
    return [F.lit(seed), i.cast("long"), repeat.cast("long")]


def blocks_of(by: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """targets() and n_blocks (of the source), whole (repeats that take all of them), limit, blocks (drawn in all).

    The repeat after the whole ones takes the first blocks of its permutation. Place p of it stands for the words from p *
    block_words on; the source's last block is short, so what stands there is less. limit is where the taken words end.
    """
    words = F.least(F.round("target"), F.col("source_size") * MAX_REPEATS).cast("long")
    by = by.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long")).withColumn("words", words)
    by = by.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    rest, short = F.col("words") - F.col("whole") * F.col("source_size"), F.col("source_size") - (F.col("n_blocks") - 1) * block_words
    place = F.when(F.col("n_blocks") > 0, _permuted(F.col("n_blocks") - 1, F.col("n_blocks"), _key(seed, F.col("i"), F.col("whole")), back=True))
    by = by.withColumn("limit", rest + F.when(rest > place * block_words + short, block_words - short).otherwise(0))
    return by.withColumn("blocks", F.col("whole") * F.col("n_blocks") + F.ceil(F.col("limit") / block_words).cast("long")).drop("words")


def quotas(by: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """i, blocks -> i, shard, first, blocks: which of a source's drawn blocks an output shard gets.

    The root holds each source's blocks. A node of c blocks gives its left half floor(c / 2) of them, and of each
    source in turn a hypergeometric share of what is left: together a multivariate hypergeometric draw, exact in
    every source and in every node. A row is a node with an array over sources, so this is as large as the number of
    sources times shards, not of documents.
    """
    root = by.select(F.struct("i", F.col("blocks").alias("q")).alias("x")).groupBy().agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["q"]).alias("q"))
    level = root.select(F.lit(0).cast("long").alias("path"), F.lit(1).alias("width"), "q")
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    width = 1
    while width < shards:
        state = F.struct(sum_of(F.col("q")).alias("pop"), F.floor(sum_of(F.col("q")) / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))

        def draw(s: Column, good: Column) -> Column:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("width"), F.col("path"), F.size(s["out"])), 11) / float(1 << 53)
            x = _hypergeometric(s["pop"], good, s["draws"], u)
            return _let({"x": x}, lambda v: F.struct((s["pop"] - good).alias("pop"), (s["draws"] - v["x"]).alias("draws"), F.concat(s["out"], F.array(v["x"])).alias("out")))

        halves = level.select("path", "width", "q", F.aggregate("q", state, draw)["out"].alias("l"))
        both = F.array(F.struct((F.col("path") * 2).alias("path"), (F.col("width") * 2).alias("width"), F.col("l").alias("q")), F.struct((F.col("path") * 2 + 1).alias("path"), (F.col("width") * 2).alias("width"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))
        level = halves.select(F.explode(both).alias("x")).select("x.*")
        if width == 256:
            level = level.repartition("path")
        width *= 2
    level = common.cut(level)
    flat = level.select(F.col("path").alias("shard"), F.posexplode("q").alias("i", "blocks"))
    before = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select("i", "shard", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"), "blocks")


def drawn_blocks(by: DataFrame, shards: int, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """blocks_of() -> a row for each drawn block: i, block, repeat, shard, words (of the block's beginning that count).

    Shards get consecutive places of a source's permutations, one for each repeat, so their blocks are disjoint. A
    shard's quota bounds what a row expands to.
    """
    slots = quotas(by.select("i", "blocks"), shards, seed).where("blocks > 0").select("i", "shard", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("slot"))
    at = slots.join(F.broadcast(by.select("i", "n_blocks", "whole", "limit")), "i")
    repeat, place = F.floor(F.col("slot") / F.col("n_blocks")).cast("long"), F.pmod("slot", "n_blocks")
    at = at.select("i", "shard", "n_blocks", "whole", "limit", repeat.alias("repeat"), place.alias("place"))
    words = F.when(F.col("repeat") < F.col("whole"), F.lit(block_words).cast("long")).otherwise(F.least(F.col("limit") - F.col("place") * block_words, F.lit(block_words)))
    return at.select("i", _permuted(F.col("place"), F.col("n_blocks"), _key(seed, F.col("i"), F.col("repeat"))).alias("block"), "repeat", "shard", words.alias("block_words"))


def mix(docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, text -> (rows: row, doc_id, source, size, source_size, target, copy; parts: row, shard, place,
    repeat, start_word, words: what each output shard takes of each row, place by place).

    A source's documents, in the order of a hash of doc_id, make a stream of words, cut into blocks of block_words. As
    many blocks are drawn as the target asks, without repeats until all were taken once, the last one in part: whole
    words to the target. The splitting tree deals each source's quota to the shards, whose number (a power of two)
    follows the words in all; each draws blocks of its own from the source's seeded permutation. place is the
    part's place in its shard after the local shuffle, by a hash.

    Null texts have no words and are never taken; a null source is a source, the last; rows with equal doc_id are rows
    of their own, and their order among themselves is open if their sizes are equal. A very long text is cut into many
    parts. An empty table gives empty ones; other columns are ignored. Places in the stream are running sums in two
    levels: over buckets of about BUCKET documents, cut by hash, and within a bucket (rows that share one doc_id share a
    bucket), so a source with a third of all rows is cut like the rest; only the sums of buckets, one row for 2,000
    documents, meet a source at a time. Parts meet their blocks by (source, block), of which none is large.
    """
    sized = common.cut(sizes(docs))
    by = common.cut(blocks_of(targets(sized), block_words, seed))
    if shards is None:
        words, shards = by.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], SHARDS
        while shards * SHARD_WORDS < words:
            shards *= 2
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    rows = sized.alias("d").join(by.alias("s"), same).select("d.row", "d.doc_id", "d.source", "d.size", "d.copy", "s.i", "s.source_size", "s.n", "s.target")
    found = rows.select("row", "doc_id", "source", "size", "source_size", "target", "copy")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)
    rows = rows.where("size > 0").select("row", "doc_id", "size", "i", h.alias("h"), F.floor(h / float(1 << 53) * F.ceil(F.col("n") / BUCKET)).cast("long").alias("bucket"))
    sums = rows.groupBy("i", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("i", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("i", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["i", "bucket"])
    rows = rows.select("row", "i", "size", (F.col("base") + F.col("inside")).alias("begin"))
    held = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block_words).cast("long"))))
    low = F.greatest(F.col("begin"), F.col("block") * block_words)
    high = F.least(F.col("begin") + F.col("size"), F.col("block") * block_words + F.col("block_words"))
    drawn = drawn_blocks(by, shards, block_words, seed)
    parts = held.join(drawn, ["i", "block"]).select("row", "i", "block", "shard", "repeat", (low - F.col("begin")).alias("start_word"), (high - low).alias("words")).where("words > 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "i", "block", "repeat"), "i", "block", "repeat", "row")
    return found, parts.select("row", "shard", (F.row_number().over(local) - 1).alias("place"), "repeat", "start_word", "words")


def mixed_words(mixed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """mix() -> row, doc_id, source, size, source_size, target, copy, taken (words), parts (of the row, by repeat and word), for each row."""
    rows, parts = mixed
    per = parts.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("repeat", "start_word", "words", "shard", "place"))).alias("parts"))
    none = F.array().cast("array<struct<repeat:bigint,start_word:bigint,words:bigint,shard:bigint,place:int>>")
    return rows.join(per, "row", "left").select(*rows.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("parts", none).alias("parts"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with size, source_size, target, taken and parts. Columns of docs that have these names are replaced.

    Rows that are alike (doc_id, source and text) are told apart by number, so each gets one of their parts lists.
    """
    new = ["size", "source_size", "target", "taken", "parts"]
    number = F.row_number().over(Window.partitionBy("k_doc", "k_copy").orderBy(F.lit(0)))
    found = mixed_words(mix(docs, **how)).select(F.col("doc_id").alias("k_doc"), F.col("copy").alias("k_copy"), *new).withColumn("k", number)
    whole = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("d"), F.col("doc_id").alias("k_doc"), _copy().alias("k_copy")).withColumn("k", number)
    same = F.col("a.k_doc").eqNullSafe(F.col("b.k_doc")) & (F.col("a.k_copy") == F.col("b.k_copy")) & (F.col("a.k") == F.col("b.k"))
    return whole.alias("a").join(found.alias("b"), same).select("a.d.*", *[f"b.{c}" for c in new])


def shard_texts(mixed: DataFrame) -> DataFrame:
    """mixed_documents() -> a row for each part: shard, place, doc_id, source, text (its words, with the white space between
    them), by shard and place: what a writer of shards writes."""
    parts = mixed.select("doc_id", "source", F.col("text").cast("string").alias("t"), F.explode("parts").alias("p"))
    # A word with the white space that follows it; what stands before the first goes with it.
    words = F.regexp_extract_all("t", F.lit(r"(^[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    text = F.array_join(F.slice(words, F.col("p.start_word").cast("int") + 1, F.col("p.words").cast("int")), "")
    return parts.select("p.shard", "p.place", "doc_id", "source", text.alias("text")).repartition("shard").sortWithinPartitions("shard", "place")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(mix(common.documents(spark, sf_dir))).select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "taken", "parts")


QUERIES = {"op10_mixing": op10_mixing}
