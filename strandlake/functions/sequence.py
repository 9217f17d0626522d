"""Sequence expressions: every function takes and returns columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODONS, HYDROPATHY, RESIDUE_MASS, STOPS, WATER_MASS


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def indexes(n: Column) -> Column:
    """0 .. n - 1; nothing if n is below one, where sequence() would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def letters(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def triplets(s: Column) -> Column:
    """Whole codons from the begin."""
    return F.regexp_extract_all(s, F.lit("(...)"), F.lit(1))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda's variable, where a column would be computed again inside each lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


# --- Normalization ---------------------------------------------------------------------------------------------


def normalize(s: Column) -> Column:
    """White space at both ends goes, upper case, U becomes T."""
    return F.translate(F.upper(F.regexp_replace(s, r"^\s+|\s+$", "")), "U", "T")


def normalize_nucleotides(s: Column) -> Column:
    """White space and brackets go, upper case, U becomes T; null if nothing or anything but ACGTN is left."""
    t = F.translate(F.upper(F.regexp_replace(s, r"[\s\[\]]", "")), "U", "T")
    return F.when(t.rlike("^[ACGTN]+$"), t)


def issues(*cases: tuple[Column, str, str]) -> Column:
    """Those of (condition, severity, code) that hold, in order, as an array of structs."""
    made = F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for c, s, k in cases])
    return F.filter(made, lambda x: x.isNotNull())


def amino_acids(s: Column) -> Column:
    """Struct of sequence and issues: one stop at the end is dropped with a warning; stops inside, other signs and nothing are errors."""
    raw = F.upper(F.regexp_replace(s, r"\s", ""))
    seq = F.regexp_replace(raw, r"\*$", "")
    return F.struct(
        seq.alias("sequence"),
        issues((raw.endswith("*"), "warning", "terminal_stop_removed"), (seq.contains("*"), "error", "internal_stop"), (seq.rlike(r"[^ACDEFGHIKLMNPQRSTVWY*]"), "error", "invalid_symbol"), (F.length(seq) == 0, "error", "empty_sequence")).alias("issues"),
    )


def nucleotides(s: Column) -> Column:
    """Struct of sequence and issues: U to T with a warning; other signs and nothing are errors."""
    raw = F.upper(F.regexp_replace(s, r"\s", ""))
    seq = F.translate(raw, "U", "T")
    return F.struct(seq.alias("sequence"), issues((raw.contains("U"), "warning", "rna_converted"), (seq.rlike("[^ACGTN]"), "error", "invalid_symbol"), (F.length(seq) == 0, "error", "empty_sequence")).alias("issues"))


# --- Reading frames and codon text -----------------------------------------------------------------------------


def longest_orf(s: Column) -> Column:
    """Struct start0, end0x (half open, stop included) of the longest frame, the earliest of equals; null if none.

    In each frame one fold: the first ATG since the last stop opens, the next stop closes.
    """

    def frame(f: int) -> Column:
        # Codons carry their place, so that the fold reads nothing but its element.
        cs = F.transform(triplets(F.substr(s, F.lit(f + 1))), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        zero = F.struct(F.lit(-1).alias("open"), F.lit(0).alias("len"), F.lit(-1).alias("start"))

        def fold(a: Column, x: Column) -> Column:
            stop = x["c"].isin(*STOPS)
            n = (x["i"] - a["open"] + 1) * 3
            better = stop & (a["open"] >= 0) & (n > a["len"])
            return F.struct(
                F.when(stop, -1).when((a["open"] < 0) & (x["c"] == "ATG"), x["i"]).otherwise(a["open"]).alias("open"),
                F.when(better, n).otherwise(a["len"]).alias("len"),
                F.when(better, a["open"] * 3 + f).otherwise(a["start"]).alias("start"),
            )

        return let(F.aggregate(cs, zero, fold), lambda got: F.struct(got["len"].alias("len"), (-got["start"]).alias("neg")))

    best = F.array_max(F.array(frame(0), frame(1), frame(2)))
    return let(best, lambda b: F.when(b["len"] > 0, F.struct((-b["neg"]).alias("start0"), (b["len"] - b["neg"]).alias("end0x"))))


def encode(s: Column, region: Column) -> Column:
    """Bases outside the region, codons inside, joined by spaces; no region: all bases."""
    return let(region, lambda r: _encoded(s, r))


def _encoded(s: Column, region: Column) -> Column:
    before, after = F.substr(s, F.lit(1), region["start0"]), F.substr(s, region["end0x"] + 1)
    inside = F.substr(s, region["start0"] + 1, region["end0x"] - region["start0"])
    parts = F.when(region.isNull(), letters(s)).otherwise(F.concat(letters(before), triplets(inside), letters(after)))
    return F.array_join(parts, " ")


def split_codons(s: Column) -> Column:
    """The text as codons; the last may have one or two letters."""
    return F.array_join(F.regexp_extract_all(s, F.lit("(.{1,3})"), F.lit(1)), " ")


def split_marked(s: Column) -> Column:
    """Bases outside brackets, codons inside. An open bracket runs to the end; a bracket opened again inside turns
    what it holds so far into bases."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(False).alias("open"))

    def fold(a: Column, c: Column) -> Column:
        as_codons = F.regexp_extract_all(a["held"], F.lit("(.{1,3})"), F.lit(1))
        flushed = F.when(c == "[", F.concat(a["out"], letters(a["held"]))).when(c == "]", F.concat(a["out"], F.when(a["open"], as_codons).otherwise(letters(a["held"])))).otherwise(a["out"])
        mark = c.isin("[", "]")
        return F.struct(flushed.alias("out"), F.when(mark, "").otherwise(F.concat(a["held"], c)).alias("held"), F.when(c == "[", True).when(c == "]", False).otherwise(a["open"]).alias("open"))

    end = F.aggregate(letters(s), zero, fold)
    rest = F.when(end["open"], F.regexp_extract_all(end["held"], F.lit("(.{1,3})"), F.lit(1))).otherwise(letters(end["held"]))
    return F.array_join(F.concat(end["out"], rest), " ")


def translate_cds(s: Column) -> Column:
    """Struct protein, issues. Null protein if the length is no multiple of three or signs other than ACGTN occur; a
    codon with N is X with a warning; one stop at the end is dropped, stops inside are an error."""
    code = literal_map(CODONS)
    aa = F.array_join(F.transform(triplets(s), lambda c: F.when(c.contains("N"), "X").otherwise(F.coalesce(F.try_element_at(code, c), F.lit("?")))), "")
    framed = F.length(s) % 3 == 0
    clean = s.rlike("^[ACGTN]*$")

    def made(protein: Column) -> Column:
        return F.struct(
            F.when(framed & clean, protein).alias("protein"),
            issues((~framed, "error", "frame"), (framed & s.contains("N"), "warning", "ambiguous_codon"), (framed & protein.contains("*"), "error", "internal_stop"), (framed & ~s.startswith("ATG"), "warning", "non_atg_start")).alias("issues"),
            F.transform(F.filter(indexes(F.length(protein)), lambda i: F.substr(protein, i + 1, F.lit(1)) == "*"), lambda i: i + 1).alias("internal_stops1"),
        )

    return let(F.regexp_replace(aa, r"\*$", ""), made)


def first_mismatch(a: Column, b: Column) -> Column:
    """The first place, from one, where the two differ; the shorter one's end + 1 if it begins the longer; null if equal."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(indexes(n), lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))
    return F.when(F.size(at) > 0, F.element_at(at, 1) + 1).when(F.length(a) != F.length(b), n + 1)


def translation_relation(declared: Column, translated: Column) -> Column:
    """exact, n_addition, c_addition, both_additions or mismatch: whether the translation holds the declared sequence once."""
    at = F.instr(translated, declared)
    rest = F.instr(F.substr(translated, at + 1), declared)
    more = F.length(translated) - F.length(declared) - at + 1
    return F.when(declared == translated, "exact").when((at == 0) | (rest > 0), "mismatch").when((at > 1) & (more > 0), "both_additions").when(at > 1, "n_addition").otherwise("c_addition")


# --- Composition -----------------------------------------------------------------------------------------------


def count_of(s: Column, signs: str) -> Column:
    return F.length(s) - F.length(F.translate(s, signs, ""))


def fraction(s: Column, signs: str) -> Column:
    return F.try_divide(count_of(s, signs), F.length(s))


def gc_at(s: Column, place: int) -> Column:
    """GC fraction of every third base from place 1, 2 or 3 on, those of an incomplete last codon among them."""
    lead = F.substr(s, F.lit(place))
    return fraction(F.regexp_replace(lead, "(.)..?", "$1"), "GC")


def longest_homopolymer(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def entropy(s: Column, alphabet: Iterable[str]) -> Column:
    """Shannon entropy of the letters, in bits."""
    n = F.length(s)
    parts = [F.when(count_of(s, c) > 0, -(count_of(s, c) / n) * F.log2(count_of(s, c) / n)).otherwise(0.0) for c in alphabet]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(n > 0, total).otherwise(0.0)


def scale_sum(s: Column, scale: dict[str, float]) -> Column:
    """Counts times values, letter by letter in alphabetical order: the same sum in any engine."""
    total = F.lit(0.0)
    for c in sorted(scale):
        total = total + count_of(s, c) * F.lit(scale[c])
    return total


def mass(s: Column) -> Column:
    return F.when(F.length(s) > 0, scale_sum(s, RESIDUE_MASS) + WATER_MASS).otherwise(0.0)


def gravy(s: Column) -> Column:
    return F.try_divide(scale_sum(s, HYDROPATHY), F.length(s))


def charge_proxy(s: Column) -> Column:
    return count_of(s, "KR") + 0.1 * count_of(s, "H") - count_of(s, "DE")


def motif_starts(s: Column) -> Column:
    """Places, from one, of N[^P][ST], overlapping ones too."""
    return F.transform(F.filter(indexes(F.length(s) - 2), lambda i: F.substr(s, i + 1, F.lit(3)).rlike("N[^P][ST]")), lambda i: i + 1)


def kmers(s: Column, k: int = 3) -> Column:
    return F.array_distinct(F.transform(indexes(F.length(s) - k + 1), lambda i: F.substr(s, i + 1, F.lit(k))))


def kmer_similarity(a: Column, b: Column, k: int = 3) -> Column:
    """Jaccard similarity of k-mer sets: 1 for equal sequences, 0 if either is shorter than k."""
    x, y = kmers(a, k), kmers(b, k)
    return F.when(a == b, 1.0).when((F.length(a) < k) | (F.length(b) < k), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


# --- Codon choice ----------------------------------------------------------------------------------------------


def best_codons(frequency: dict[str, float]) -> dict[str, list[str]]:
    """Residue -> its codons, the most frequent first, ties by name."""
    out: dict[str, list[str]] = {}
    for c in sorted(CODONS, key=lambda c: (-frequency.get(c, 0.0), c)):
        out.setdefault(CODONS[c], []).append(c)
    return out


def backtranslate(s: Column, frequency: dict[str, float]) -> Column:
    """Each residue's most frequent codon, then the most frequent stop."""
    best = {a: cs[0] for a, cs in best_codons(frequency).items()}
    m = literal_map(best)
    return F.concat(F.array_join(F.transform(letters(s), lambda a: F.element_at(m, a)), ""), F.lit(best["*"]))


def synonymous_cds(s: Column, frequency: dict[str, float], seed: int, trial: Column, name: Column, stop: str = "TAA") -> Column:
    """Trial 0 takes the best codons; others draw by the first four bytes of SHA-256(seed:trial:name:place): the best
    one for a remainder by 100 under 65, else one of the others."""
    by = best_codons(frequency)
    m = F.create_map(*[x for a, cs in by.items() if a != "*" for x in (F.lit(a), F.array(*map(F.lit, cs)))])

    def one(a: Column, i: Column) -> Column:
        cs = F.element_at(m, a)
        digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), name, i.cast("string")).cast("binary"), 256)
        draw = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")
        rank = F.when((trial == 0) | (F.size(cs) == 1) | (draw % 100 < 65), F.lit(0).cast("long")).otherwise(1 + draw % (F.size(cs) - 1))
        return F.element_at(cs, rank.cast("int") + 1)

    return F.concat(F.array_join(F.transform(letters(s), one), ""), F.lit(stop))


def cai(s: Column, frequency: dict[str, float]) -> Column:
    """exp of the mean log of each sense codon's frequency over its residue's best, floored at 1e-12."""
    best = {a: max(frequency.get(c, 0.0) for c in cs) for a, cs in best_codons(frequency).items()}
    logs = {c: max(frequency.get(c, 0.0) / best[a], 1e-12) if best[a] else 1e-12 for c, a in CODONS.items() if a != "*"}
    m = literal_map(logs)
    cs = F.filter(triplets(s), lambda c: ~c.isin(*STOPS) & ~c.contains("N"))
    total = F.aggregate(cs, F.lit(0.0), lambda t, c: t + F.ln(F.element_at(m, c)))
    return F.when(F.size(cs) > 0, F.exp(total / F.size(cs))).otherwise(0.0)


# --- Text ------------------------------------------------------------------------------------------------------


def header_fields(header: Column) -> Column:
    """[key=value] parts of a header, as an array of structs in order."""
    keys = F.regexp_extract_all(header, F.lit(r"\[([^=\]]+)=([^\]]*)\]"), F.lit(1))
    values = F.regexp_extract_all(header, F.lit(r"\[([^=\]]+)=([^\]]*)\]"), F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def gene_id(header: Column) -> Column:
    got = F.regexp_extract(header, r"GeneID:(\d+)", 1)
    return F.when(got != "", got)


def model_name(name: Column) -> Column:
    """Lower case, runs of other signs as one hyphen; a legacy prefix goes."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(clean, r"^legacy-", "")


def format_bytes(n: Column) -> Column:
    """1536 as 1.5 KB; steps of 1024 up to TB; halves go to the even digit."""
    out = F.format_string("%.1f TB", F.bround(n / 1024.0**4, 1))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**k, 1))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60)


def token_ids(text: Column, vocabulary: list[str], length: int, unknown: str = "[UNK]", pad: str = "[PAD]") -> Column:
    """Ids of space-separated tokens, cut or padded to length."""
    m = literal_map({t: i for i, t in enumerate(vocabulary)})
    ids = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(vocabulary.index(unknown))))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(vocabulary.index(pad)), length)), 1, length)


def blocks(tokens: Column, size: int) -> Column:
    """Whole blocks of so many tokens; the rest goes."""
    return F.transform(indexes(F.floor(F.size(tokens) / size)), lambda i: F.slice(tokens, i * size + 1, size))
