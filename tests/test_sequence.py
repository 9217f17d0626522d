"""Sequence functions against independent Python."""

import random

from pyspark.sql import functions as F

from strandlake.functions import sequence as fn
from strandlake.functions.constants import CODONS, STOPS


def orf(s):
    best = None
    for f in range(3):
        start = None
        for i in range(f, len(s) - 2, 3):
            c = s[i : i + 3]
            if c in STOPS:
                if start is not None and (best is None or (i + 3 - start, -start) > (best[1] - best[0], -best[0])):
                    best = (start, i + 3)
                start = None
            elif c == "ATG" and start is None:
                start = i
    return best


def test_longest_orf_on_random_sequences(spark):
    rng = random.Random(1)
    seqs = ["", "A", "ATG", "ATGTAA", "ATGTAAATGTAA", "CCCATGAAATAAGGATGCCCCCCTGA"] + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 200))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", fn.longest_orf(F.col("s")).alias("o"))
    for r in df.collect():
        assert (tuple(r["o"]) if r["o"] else None) == orf(r["s"]), r["s"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def test_known_encodings(spark):
    enc = lambda c: fn.encode(fn.normalize(c), fn.longest_orf(fn.normalize(c)))
    assert one(spark, "CCCATGAAATAAGG", enc) == "C C C ATG AAA TAA G G"
    assert one(spark, " cccaugaaauaagg\n", enc) == "C C C ATG AAA TAA G G"
    assert one(spark, "AACCGG", enc) == "A A C C G G"
    assert one(spark, "AA[ATGCCCTAA]TT", fn.split_marked) == "A A ATG CCC TAA T T"
    assert one(spark, "AA[ATGCC", fn.split_marked) == "A A ATG CC"
    assert one(spark, "[ATG[CCC]", fn.split_marked) == "A T G CCC"
    assert one(spark, "ATGCCCT", fn.split_codons) == "ATG CCC T"


def test_translation(spark):
    r = one(spark, "ATGNAATAATGA", fn.translate_cds)
    assert r["protein"] == "MX*" and [x["code"] for x in r["issues"]] == ["ambiguous_codon", "internal_stop"] and r["internal_stops1"] == [3]
    assert one(spark, "ATGA", fn.translate_cds)["protein"] is None
    assert one(spark, "ATGZZZ", fn.translate_cds)["protein"] is None
    assert len(CODONS) == 64 and [CODONS[c] for c in ("ATG", "TGG", "GGG", "TTT", "CGA")] == ["M", "W", "G", "F", "R"]


def test_edges_of_metrics(spark):
    assert one(spark, "", fn.longest_homopolymer) == 0
    assert one(spark, "", lambda s: fn.fraction(s, "GC")) is None
    assert one(spark, "", fn.motif_starts) == []
    assert one(spark, "NNSTNPS", fn.motif_starts) == [1, 2]
    assert one(spark, "AB", lambda s: fn.kmer_similarity(s, F.lit("ABC"))) == 0.0
    assert one(spark, "x [a=1] [b=x y] GeneID:77", fn.gene_id) == "77"
    assert [tuple(x) for x in one(spark, "x [a=1] [b=x y]", fn.header_fields)] == [("a", "1"), ("b", "x y")]
