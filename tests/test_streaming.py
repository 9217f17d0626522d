"""Sliding-buffer shuffle against a loop, as a window and on a stream; streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from strandlake.streaming import resume, shuffle, state
from strandlake.streaming.shuffle import digest_of


def loop(n, buffer, seed):
    """The same draws, a row at a time."""
    held, out = [], []
    for i in range(n):
        if len(held) < buffer:
            held.append(i)
        else:
            k = digest_of(seed, i) % buffer
            out.append(held[k])
            held[k] = i
    return out + sorted(held, key=lambda i: (digest_of(seed, "end", i), i)) if buffer > 1 else list(range(n))


@pytest.mark.parametrize("buffer", [1, 5, 64, 1000])
def test_sliding_shuffle_equals_the_loop(spark, buffer):
    sizes = {"a": 300, "b": 7, "c": 1}
    df = spark.createDataFrame([(k, i * 3 + 1) for k, n in sizes.items() for i in range(n)], "k string, at long")
    got = shuffle.shuffled(df, ["k"], "at", buffer, 9).collect()
    for k, n in sizes.items():
        assert [(r["at"] - 1) // 3 for r in sorted(got, key=lambda r: r["place"]) if r["k"] == k] == loop(n, buffer, 9)
        assert sorted(r["place"] for r in got if r["k"] == k) == list(range(n))
    if buffer == 5:
        far = [abs(r["place"] - (r["at"] - 1) // 3) for r in got if r["k"] == "a"]
        assert max(far) > 15  # beyond any block of five


def test_stream_shuffle_keeps_its_buffer_between_runs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src, out = tmp_path / "in", tmp_path / "out"
        src.mkdir()
        schema = "part int, at long, line string"

        def put(name, rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))

        def run():
            lines = spark.readStream.schema(schema).parquet(str(src / "*"))
            q = shuffle.stream_shuffle(lines, 4, 7).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(300)

        rows = [(p, i, f"{p}-{i}") for p in (0, 1) for i in range(30 + p)]
        put("first", rows[:25] + rows[30:40])
        run()
        half = spark.read.parquet(str(out)).count()
        assert half == 21 + 6
        put("second", rows[25:30] + rows[40:] + [(0, 99, None), (1, 99, None)])
        run()
        got = spark.read.parquet(str(out)).collect()
        for p in (0, 1):
            assert [r["at"] for r in sorted(got, key=lambda r: r["place"]) if r["part"] == p] == loop(30 + p, 4, 7 + p)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_stops_twice_and_gets_each_line_once(spark, tmp_path):
    folder, out, work = (str(tmp_path / x) for x in ("in", "out", "work"))
    (tmp_path / "in").mkdir()
    lines = []
    for k in range(9):
        mine = [f"{k}:{i}" for i in range(k + 1)]
        lines += mine
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join([*mine, " ", ""]))

    def crash(number):
        if number == 4:
            raise RuntimeError("lost")

    go = lambda **how: resume.run_lines(spark, folder, out, work, 2, 3, 1, corpus=len(lines), **how)
    first = go(most_batches=3)
    assert first.global_step == 3 and 0 < first.cursor < len(lines)
    # Cut off after the batch was written, before the state was: the same files again, under the same number.
    with pytest.raises(Exception, match="lost"):
        go(after_write=crash)
    assert state.load(spark, f"{work}/state.json").global_step == 4
    last = go()
    got = [r["line"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(lines) and last.cursor == len(lines) and (last.corpus_pass, last.corpus_offset) == (1, 0)
    assert last.resume_source == "state" and last.consumed_since_resume == last.cursor - last.resume_cursor
    assert go().cursor == len(lines) and spark.read.parquet(out).count() == len(lines)
    with pytest.raises(ValueError, match="topology"):
        resume.run_lines(spark, folder, out, work, 3, 2, 1)
    (tmp_path / "in" / "9.txt").write_text("new\n")
    with pytest.raises(ValueError, match="corpus"):
        go()


def test_resume_order_of_sources():
    s = state.State(1, 10, 500, 8, 2, 2, 0, "m")
    how = {"world": 2, "workers": 2, "manifest_sha256": "m"}
    assert state.resume(7, s, 12, 8, **how) == 7 and state.resume(None, s, 12, 8, **how) == 516 and state.resume(None, None, 12, 8, **how) == 96
    for bad in ({"workers": 1}, {"manifest_sha256": "x"}):
        with pytest.raises(ValueError):
            state.resume(None, s, 12, 8, **(how | bad))


def test_epochs_repeat_with_other_seeds(spark):
    from strandlake.streaming.readers import epochs

    df = spark.range(40).select((F.col("id") % 2).cast("int").alias("part"), F.col("id").alias("at"))
    got = epochs(df, "part", "at", 2, seed=3, buffer=4, skip=5, cap=50, passes=2).collect()
    for p in (0, 1):
        want = [(e, i * 2 + p) for e in (0, 1) for i in loop(20, 4, 3 + p + e * 2)]
        skip = 3 - p
        rows = sorted((r["place"], r["epoch"], r["at"]) for r in got if r["part"] == p)
        assert [(e, a) for _, e, a in rows] == want[skip : skip + 25]
