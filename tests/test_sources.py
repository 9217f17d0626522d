"""Sources, sinks, streams and state on small files."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph, verify
from strandlake.sources import fasta, sinks, tables
from strandlake.sources import readers as sources
from strandlake.streaming import readers, state


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("acgu\n>r1 first\nAAC\n\nGG\n>r2\nTT\n")
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "b.fasta.gz", "wt") as f:
        f.write(">r3 [gene=x]\nCC\n")
    (tmp_path / "no.txt").write_text(">x\nA\n")
    got = [(r["file_index"], r["record"], r["sequence"]) for r in fasta.tolerant(spark, str(tmp_path)).orderBy("file_index", "record").collect()]
    assert got == [(1, 0, "ACGT"), (1, 1, "AACGG"), (1, 2, "TT"), (2, 1, "CC")]
    with pytest.raises(Exception, match="body_before_header"):
        fasta.strict(spark, str(tmp_path)).collect()
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "c.fna").write_text("# note\n>p one two\nMK\nL\n>q\nM\n")
    assert sorted(map(tuple, fasta.strict(spark, str(tmp_path / "ok")).collect())) == [("p", "one two", "MKL"), ("q", "", "M")]
    assert spark.range(1).select(fasta.wrapped(F.lit("x"), F.lit("A" * 5), 2)).first()[0] == ">x\nAA\nAA\nA"
    parsed = spark.range(1).select(fasta.parse(F.lit(">a b\nAC\nG\n>c\nT"))).first()[0]
    assert [tuple(x) for x in parsed] == [("a", "ACG"), ("c", "T")]


def test_structures_and_predictors(spark, tmp_path):
    atom = "ATOM  {:5d}  CA  {} A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00{:6.2f}"
    (tmp_path / "m.pdb").write_text("\n".join(atom.format(i, n, i, 3.8 * i, 1.0, 2.0, 0.85) for i, n in enumerate(("ALA", "GLY", "TRP"), 1)) + "\nTER\n")
    got = tables.ca_atoms(spark, str(tmp_path / "m.pdb"))
    assert [(r["residue"], r["pos"], round(r["plddt"])) for r in got.orderBy("pos").collect()] == [("A", 1, 85), ("G", 2, 85), ("W", 3, 85)]
    assert tables.ca_faults(got).count() == 0
    (tmp_path / "p.xls").write_text("\tHLA-A\nPos\tPeptide\tID\tcore\tEL-score\tEL_Rank\n1\tMKL\tc000\tMKL\t0.5\t0.4\n2\tKLL\tc000\tKLL\t0.1\tNA\n")
    c1 = tables.mhc_class1(tables.predictor_rows(spark, str(tmp_path / "p.xls"))).orderBy("position")
    assert [(r["peptide"], r["el_rank"]) for r in c1.collect()] == [("MKL", 0.4), ("KLL", None)]
    assert c1.select(tables.binding_level(F.col("mhc_class"), F.col("el_rank"))).first()[0] == "strong"
    (tmp_path / "t.3line").write_text(">a\nMKL\nHH.\n>b\nMM\n..\n")
    assert [r["labels"] for r in sources.three_line(spark, str(tmp_path / "t.3line")).orderBy("record_id").collect()] == ["HH.", ".."]


def test_metric_tree_and_archives(spark, tmp_path):
    for k in (1, 2):
        d = tmp_path / f"m-x-seed{k}" / "results" / "r"
        d.mkdir(parents=True)
        (d / "eval_results.json").write_text(json.dumps({f"eval_{n}": k / 2 for n in ("spearman_corr", "pearson_corr", "r2_score", "mse_loss")}))
    assert sorted((r["model"], r["seed"]) for r in tables.run_metrics(spark, str(tmp_path)).collect()) == [("m-x", 1), ("m-x", 2)]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("d/x.json")
        i.size = 2
        t.addfile(i, io.BytesIO(b"{}"))
    assert [(r["member"], bytes(r["content"])) for r in sources.archive_members(spark, str(tmp_path / "a.tar.gz")).collect()] == [("d/x.json", b"{}")]
    index = tables.digests(spark, str(tmp_path / "m-x-seed1")).select("path", "sha256")
    index = spark.createDataFrame(index.collect(), index.schema)  # stored, as an index is
    assert verify.artifacts(index, index).where("status <> 'ok'").count() == 0
    (tmp_path / "m-x-seed1" / "results" / "r" / "new.txt").write_text("x")
    assert verify.artifacts(tables.digests(spark, str(tmp_path / "m-x-seed1")), index).where("status = 'not_indexed'").count() == 1


def test_csv_records(spark, tmp_path):
    (tmp_path / "d.csv").write_text("sequence,label\nacgu,1.5\n[GG] G,\nNNA,2\n")
    assert sorted((r["normalized"], r["label"]) for r in tables.regression_records(spark, str(tmp_path / "d.csv")).collect()) == [("ACGT", 1.5), ("NNA", 2.0)]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {k}",) for k in range(200)] + [("  ",), ("line 1",)], "value string")
    back = sinks.write_shards(lines, str(tmp_path / "s"), 4, 7)
    assert back.agg(F.sum("lines")).first()[0] == 201 and back.count() == 4
    sinks.write_split(lines, str(tmp_path / "t"), str(tmp_path / "v"), 0.2, 3)
    t, v = (spark.read.text(str(tmp_path / x)) for x in "tv")
    assert t.count() + v.count() == 201 and t.intersect(v).count() == 0 and 10 < v.count() < 80
    csv = spark.createDataFrame([("acguc", "1", "e")], "a string, b string, c string")
    assert tuple(sinks.split_csv(csv, "codon").first()) == ("ACG TC", "1", "e")
    flat = spark.createDataFrame([(1, [("x", ["p", "q"])])], "k int, xs array<struct<n: string, ys: array<string>>>")
    assert tuple(sinks.flattened(flat, ["k"], "xs", ["n", "ys"]).first()) == (1, 1, "x", "p|q")
    sinks.write_published(csv, str(tmp_path / "run"), verify.check(csv, "some", F.lit(False)))
    assert spark.read.parquet(str(tmp_path / "run")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_published(csv, str(tmp_path / "run"), verify.check(csv, "some", F.lit(True)))


def test_readers_agree_with_loops(spark):
    texts = [(f, k, "x" * ((k * 7 + f) % 11)) for f, n in enumerate((17, 23, 11)) for k in range(n)]
    df = spark.createDataFrame(texts, "file int, idx int, text string")
    for world, workers in ((1, 1), (1, 4), (4, 1), (3, 2), (2, 3)):
        n = world * workers
        a = {(r["file"], r["idx"]): r["part"] for r in readers.byte_range(df, "file", "idx", "text", world, workers).collect()}
        for f in range(3):
            own = [len(t) + 1 for g, _, t in texts if g == f]
            total, at = sum(own), 0
            for k, size in enumerate(own):
                want = next(p for p in range(n) if total * p // n <= at < total * (p + 1) // n)
                assert a[f, k] == want
                at += size
        assert {r["part"] for r in readers.line_stride(df, "idx", world, workers).collect()} <= set(range(n))
    with pytest.raises(ValueError):
        readers.check_partitions(2, 3, "file-shard")


def test_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(["a", " ", "b", "", f"c{k}"]) + "\n")
    s = readers.stream_lines(spark, str(tmp_path / "in"), 2, 2, 1)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_state(spark, tmp_path):
    s = state.State(1, 100, 9600, 96, 3, 4, 1000, "h")
    state.save(spark, str(tmp_path / "s.json"), s)
    assert state.load(spark, str(tmp_path / "s.json")) == s
    how = {"world": 3, "workers": 4, "manifest_sha256": "h"}
    assert state.resume(5, s, 110, 96, **how) == 5 and state.resume(None, s, 110, 96, **how) == 9600 + 960 and state.resume(None, None, 10, 96, **how) == 960
    with pytest.raises(ValueError):
        state.resume(None, s, 110, 96, **(how | {"world": 2}))
    assert state.manifest_sha256({"a": 1, "created_at": 2}) == state.manifest_sha256({"created_at": 3, "a": 1})


def test_verification_and_graphs(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert verify.reproduced("r", a, a.orderBy("v")).first()["status"] == "pass"
    assert verify.reproduced("r", a, a.distinct()).first()["status"] == "fail"
    assert verify.references("f", a, a.where("k = 1"), "k").first()["detail"] == "1"
    stages = spark.createDataFrame([(x,) for x in "abcd"], "stage string")
    good = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "src string, dst string")
    assert graph.workflow_faults(stages, good).count() == 0
    bad = good.unionByName(spark.createDataFrame([("z", "d"), ("e", "f"), ("f", "e")], "src string, dst string"))
    faults = {(r["fault"], r["stage"]) for r in graph.workflow_faults(spark.createDataFrame([(x,) for x in "abcdef"], "stage string"), bad).collect()}
    assert ("unknown_dependency", "z") in faults and ("not_reached_or_cycle", "e") in faults


def test_fasta_suffixes_in_any_case_and_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "A.FASTA").write_text("".join(f">r{k} x\n{'ACGT' * (k % 7)}\nA\n" for k in range(400)))
    with gzip.open(tmp_path / "b.Fa.GZ", "wt") as f:
        f.write("lead\n>q\nCC\n")
    (tmp_path / "c.fna").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = fasta.raw(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r["file"].rsplit("/", 1)[1], r["record"], r["header"], r["sequence"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["file"].rsplit("/", 1)[1] for r in fasta.discovered(spark, str(tmp_path)).collect()) == ["A.FASTA", "b.Fa.GZ"]  # the reader passes empty files over
    assert got == sorted([("A.FASTA", k + 1, f"r{k} x", "ACGT" * (k % 7) + "A") for k in range(400)] + [("b.Fa.GZ", 0, None, "lead"), ("b.Fa.GZ", 1, "q", "CC")])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_three_line_records_by_ranges(spark, tmp_path, size):
    (tmp_path / "a.txt").write_text("".join(f">p{k} d\n{'MK' * k}L\n\n{'H.' * k}S\n" for k in range(12)))
    (tmp_path / "b.txt").write_text("\n>z\r\nM\r\nB\r\n")
    (tmp_path / "_no").write_text("x")
    got = sources.three_line(spark, str(tmp_path), size).select("record_id", "sequence", "labels").collect()
    assert sorted(map(tuple, got)) == sorted([(f"p{k}", "MK" * k + "L", "H." * k + "S") for k in range(12)] + [("z", "M", "B")])
    (tmp_path / "c.txt").write_text("lost\n>a\nMK\nH\n>b\nMK\n>c\nM\nx\n>\nM\nH\n>d\nM\nH\nmore\nmore\n>e\nM\nH")
    faults = sources.three_line_rows(spark, str(tmp_path / "c.txt"), size).select("record_id", "fault").collect()
    assert sorted((r["record_id"], r["fault"] or "") for r in faults if r["record_id"] != "" or r["fault"] == "empty_id") == [("", "empty_id"), ("a", "length"), ("b", "incomplete"), ("c", "labels"), ("d", "no_header"), ("e", "")]
    with pytest.raises(Exception, match="malformed"):
        sources.three_line(spark, str(tmp_path / "c.txt"), size).collect()
    (tmp_path / "d.txt").write_text(">z\nM\nB\n" * 2)
    with pytest.raises(Exception, match="repeated record: z"):
        sources.three_line(spark, str(tmp_path / "d.txt"), size).collect()


def test_archives_hold_exactly_what_is_expected(spark, tmp_path):
    def put(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for n, kind in members:
                i = tarfile.TarInfo(n)
                i.type, i.size = kind, 2 if kind == tarfile.REGTYPE else 0
                i.linkname = "a"
                t.addfile(i, io.BytesIO(b"{}") if i.size else None)

    plain = tarfile.REGTYPE
    put("ok.tar.gz", [("a", plain), ("d", tarfile.DIRTYPE), ("d/b", plain)])
    read = lambda name, *how: sources.archive_members(spark, str(tmp_path / name), *how).collect()
    assert sorted(r["member"] for r in read("ok.tar.gz", ["a", "d/b"])) == ["a", "d/b"]
    put("twice.tar.gz", [("a", plain), ("a", plain)])
    put("up.tar.gz", [("../a", plain)])
    put("link.tar.gz", [("a", tarfile.SYMTYPE)])
    (tmp_path / "no.tar.gz").write_bytes(b"\x1f\x8bnothing")
    for name, expected, what in (("ok.tar.gz", ["a"], "unexpected"), ("ok.tar.gz", ["a", "d/b", "c"], "lacks"), ("twice.tar.gz", ["a"], "repeated"), ("up.tar.gz", None, "unsafe"), ("link.tar.gz", None, "unsafe"), ("no.tar.gz", None, "can't be read")):
        with pytest.raises(Exception, match=what):
            read(name, expected)
    with pytest.raises(Exception, match="more than 3 bytes"):
        read("ok.tar.gz", None, 3)
