"""Sinks: encoded corpora, shards, splits, flattened tables, FASTA."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import sequence as fn


def encoded(records: DataFrame, order: list[str]) -> DataFrame:
    """records with a sequence column -> value, the token text, in order."""
    s = fn.normalize(F.col("sequence"))
    return records.orderBy(*order).select(fn.encode(s, fn.longest_orf(s)).alias("value"))


def write_shards(lines: DataFrame, path: str, shards: int, seed: int, order: list[str] | None = None) -> DataFrame:
    """Lines that aren't blank, dealt to shard=k folders, and path.manifest.json; returns shard, lines, bytes of what is there.

    order: columns that name a line (file and number, say). A line's shard is then drawn from the seed and these, so it is
    uniform a line, and copies part; without, from its text, so copies stay together. A manifest of the same lines, seed and
    shards whose counts hold means that all is there already, and nothing is written.
    """
    spark = lines.sparkSession
    drawn = F.col("value") if order is None else F.concat_ws("\0", *[F.col(c).cast("string") for c in order])
    kept = lines.where(F.length(F.regexp_replace("value", r"\s", "")) > 0).withColumn("shard", hs.bucket(drawn, seed, shards)).select("value", "shard")
    want = kept.agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("b"), F.sum(F.xxhash64("value", "shard").cast("decimal(38,0)")).cast("string").alias("h")).first()
    what = {"shards": shards, "seed": seed, "total_lines": want["n"], "total_bytes": want["b"] or 0, "content": want["h"]}
    counts = lambda: spark.read.option("basePath", path).text(path).groupBy("shard").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    said = f"{path}.manifest.json"
    if exists(spark, said):
        old = json.loads(read_document(spark, said))
        if {k: old.get(k) for k in what} == what and counts().agg(F.sum("lines")).first()[0] == want["n"]:
            return counts()
    kept.write.mode("overwrite").partitionBy("shard").text(path)
    per = {str(r["shard"]): [r["lines"], r["bytes"]] for r in counts().collect()}  # a row a shard
    write_document(spark, said, what | {"lines_and_bytes": per})
    return counts()


def write_split(lines: DataFrame, train: str, valid: str, fraction: float, seed: int) -> None:
    """Two text folders by hash bucket. A line's side depends on the line alone, so copies never part."""
    k = hs.validation_buckets(fraction)
    kept = lines.where(F.length(F.regexp_replace("value", r"\s", "")) > 0)
    b = hs.bucket(F.col("value"), seed)
    kept.where(b >= k).write.text(train)
    kept.where(b < k).write.text(valid)


def split_csv(df: DataFrame, option: str) -> DataFrame:
    """The first two columns become sequence (as tokens) and label; others stay."""
    how = {"utr": lambda c: F.array_join(fn.letters(c), " "), "codon": fn.split_codons, "complete": fn.split_marked}[option]
    first, second, *rest = df.columns
    return df.select(how(fn.normalize(F.col(first))).alias("sequence"), F.col(second).alias("label"), *rest)


def clean_splits(df: DataFrame, priority: list[str]) -> DataFrame:
    """split, sequence, ... -> rows with status: kept, within_split or cross_split; the first split of priority wins."""
    from pyspark.sql import Window

    prio = F.array_position(F.array(*map(F.lit, priority)), F.col("split"))
    w = Window.partitionBy("sequence").orderBy(prio, "pos")
    first = F.first("split").over(w)
    return df.withColumn("status", F.when(F.row_number().over(w) == 1, "kept").when(first == F.col("split"), "within_split").otherwise("cross_split"))


def flattened(df: DataFrame, key: list[str], array: str, fields: list[str]) -> DataFrame:
    """A row for each element of an array of structs, its place (from one) and fields; arrays in fields are joined by |."""
    rows = df.select(*key, F.posexplode(array).alias("_p", "_x"))

    def text(f: str) -> Column:
        c = F.col(f"_x.{f}")
        return (F.array_join(c.cast("array<string>"), "|") if rows.select(c).schema[0].dataType.typeName() == "array" else c).alias(f)

    return rows.select(*key, (F.col("_p") + 1).alias("place"), *map(text, fields))


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_published(df: DataFrame, path: str, checks: DataFrame) -> None:
    """Writes a run beside its place and moves it there only if no check failed. A run that is there goes aside first, and
    only when the new one is in its place is it deleted; a move that fails is an error and puts it back."""
    spark = df.sparkSession
    new, fs = _path(spark, f"{path}.pending")
    df.write.mode("overwrite").parquet(f"{path}.pending")
    bad = checks.where("status = 'fail'").count()
    if bad:
        fs.delete(new, True)
        raise ValueError(f"{bad} checks failed; nothing was published")
    at, aside = _path(spark, path)[0], _path(spark, f"{path}.before")[0]
    fs.delete(aside, True)
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, at):
        fs.rename(aside, at)
        raise OSError(f"{path} can't be put in place")
    fs.delete(aside, True)


def publish(df: DataFrame, folder: str, run: str) -> None:
    """Writes folder/run with its manifest (rows, columns), then points folder/LATEST to it."""
    spark = df.sparkSession
    df.write.parquet(f"{folder}/{run}/rows")
    stored = spark.read.parquet(f"{folder}/{run}/rows")
    write_document(spark, f"{folder}/{run}/manifest.json", {"rows": stored.count(), "columns": df.columns})
    write_document(spark, f"{folder}/LATEST", {"run": run})


def latest(spark: SparkSession, folder: str, run: str | None = None) -> DataFrame:
    """The rows of the named run, or of that which LATEST points to; rows that differ from the manifest are an error."""
    run = run or json.loads(read_document(spark, f"{folder}/LATEST"))["run"]
    stated = json.loads(read_document(spark, f"{folder}/{run}/manifest.json"))
    rows = spark.read.parquet(f"{folder}/{run}/rows")
    if rows.columns != stated["columns"] or rows.count() != stated["rows"]:
        raise ValueError(f"{run} differs from its manifest")
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON document (sorted keys), written and flushed beside its place and put there by one rename that
    replaces what is there: at no time is the document missing or half written."""
    new, fs = _path(spark, f"{path}.pending")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
    out.hsync()
    out.close()
    at, jvm = _path(spark, path)[0], spark._jvm
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    replaces = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replaces[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where.rename(fs.makeQualified(new), fs.makeQualified(at), replaces)


def read_document(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def supersede(spark: SparkSession, path: str, document: dict) -> None:
    """Writes a document; one that is there and differs is kept as path.versions/<SHA-256 of its content>.json."""
    at, fs = _path(spark, path)
    if fs.exists(at):
        old = read_document(spark, path)
        if old != json.dumps(document, sort_keys=True):
            name = hashlib.sha256(old.encode()).hexdigest()
            write_document(spark, f"{path}.versions/{name}.json", json.loads(old))
    write_document(spark, path, document)


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """archive, members (array of name, content) -> folder/<archive>.tar.gz, a row each, written by the row's task with fixed
    times and owners, so the same row gives the same bytes; returns archive, bytes. Members of a row are held at once."""
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def work(batches):
        import gzip
        import io
        import tarfile

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            done = []
            for name, members in pdf[["archive", "members"]].itertuples(index=False):
                held = io.BytesIO()
                with gzip.GzipFile(fileobj=held, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w|") as tar:
                    for m in members:
                        content = m["content"].encode()
                        info = tarfile.TarInfo(m["name"])
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
                with store.open_output_stream(f"{root}/{name}.tar.gz", compression=None) as f:
                    f.write(held.getvalue())
                done.append((name, held.tell()))
            yield pd.DataFrame(done, columns=["archive", "bytes"])

    return df.select("archive", "members").mapInPandas(work, "archive string, bytes long")


def write_documents(df: DataFrame, key: str, root: str, name) -> None:
    """A JSON document for each row, below root under the name that the key gives. For rows that a driver holds, such as runs."""
    spark = df.sparkSession
    for row in df.toLocalIterator():
        fields = row.asDict(recursive=True)
        write_document(spark, f"{root}/{name(fields.pop(key))}", fields)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    """Vectors and a manifest of their number and width; vectors of several widths are an error."""
    spark = df.sparkSession
    df.select(key, vector).write.parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors").agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("width"), F.max(F.size(vector)).alias("widest"))
    ok = F.when(F.col("width") != F.col("widest"), F.raise_error(F.lit("vectors of several widths"))).otherwise(F.col("width"))
    stored.select("rows", ok.alias("width")).write.json(f"{path}/manifest")


def write_clean_splits(df: DataFrame, priority: list[str], path: str) -> DataFrame:
    """clean_splits() as CSV by split, without what isn't kept, and a summary as JSON, which is returned: kept, within_split and
    cross_split of each split."""
    spark = df.sparkSession
    rows = clean_splits(df, priority)
    rows.where("status = 'kept'").drop("status").write.partitionBy("split").option("header", True).csv(f"{path}/rows")
    kinds = ("kept", "within_split", "cross_split")
    rows.groupBy("split").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds]).write.json(f"{path}/summary")
    return spark.read.schema("split string, " + ", ".join(f"{k} long" for k in kinds)).json(f"{path}/summary")
