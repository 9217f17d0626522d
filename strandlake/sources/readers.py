"""Python data sources: three-line records by byte ranges, members of archives as they stream by.

Paths are those that pyarrow's file systems reach (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a task reads, bytes of a read, and bytes of records that leave it together.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 1 << 20, 4 << 20
LABELS = "BbHhS."


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the files at or below a path; names that begin with _ or . don't count."""
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    store, root = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(root)] if uri.endswith(root) else uri.split("://")[0] + "://"
    at = store.get_file_info(root)
    found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True)) if at.type == fs.FileType.Directory else []
    out = sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    if not out:
        raise ValueError(f"no files at {path}")
    return out


def _open(uri: str, random: bool = False):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name) if random else store.open_input_stream(name, compression=None)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class ThreeLineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.labels = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), frozenset(options.get("labels", LABELS))

    def partitions(self) -> list[Range]:
        return [Range(f, i, min(i + self.split, size)) for f, size in _files(self.path) for i in range(0, size, self.split)]

    def _lines(self, part: Range) -> Iterator[tuple[int, str]]:
        """(first byte, line) of lines that aren't blank, from the range's first whole line on, to the file's end."""
        with _open(part.file, random=True) as f:
            at = max(0, part.start - 1)
            f.seek(at)
            held, skip = b"", part.start > 0
            while True:
                more = f.read(READ_BYTES)
                lines = (held + more).split(b"\n")
                held = lines.pop() if more else b""
                for line in lines:
                    if not skip and line.strip():
                        yield at, line.decode().strip()
                    skip = False
                    at += len(line) + 1
                if not more:
                    return

    def records(self, part: Range) -> Iterator[tuple[str, int, str, str, str, str | None]]:
        """The records whose header begins in the range: file, at, record_id, sequence, labels, fault."""
        lines = self._lines(part)
        at, line = next(lines, (part.end, ""))
        while part.start and line and not line.startswith(">"):
            at, line = next(lines, (part.end, ""))  # the end of an earlier range's record
        while line and at < part.end:
            if not line.startswith(">"):
                yield part.file, at, "", line, "", "no_header"
                at, line = next(lines, (part.end, ""))
                continue
            name = line[1:].split(maxsplit=1)[0] if line[1:].strip() else ""
            begin, got = at, []
            for _ in range(2):
                at, line = next(lines, (part.end, ""))
                if not line or line.startswith(">"):
                    break
                got.append(line)
            else:
                at, line = next(lines, (part.end, ""))
            sequence, labels = [*got, "", ""][:2]
            extra = bool(line) and len(got) == 2 and not line.startswith(">")
            fault = "empty_id" if not name else "incomplete" if len(got) < 2 else "length" if len(sequence) != len(labels) else "labels" if set(labels) - self.labels else "no_header" if extra else None
            yield part.file, begin, name, sequence, labels, fault
            while extra and line and not line.startswith(">"):
                at, line = next(lines, (part.end, ""))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("sequence", pa.string()), ("labels", pa.string()), ("fault", pa.string())])
        for r in self.records(partition):
            rows.append(r)
            size += len(r[3]) + len(r[4])
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class ThreeLineSource(DataSource):
    """Files of header, sequence and label lines. A file of any size is read by a task for each split_bytes; a record belongs to the
    range in which its header begins. Options: path, split_bytes, labels."""

    @classmethod
    def name(cls) -> str:
        return "three_line"

    def schema(self) -> str:
        return "file string, at long, record_id string, sequence string, labels string, fault string"

    def reader(self, schema) -> ThreeLineReader:  # noqa: ARG002
        return ThreeLineReader(dict(self.options))


def three_line_rows(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, labels: str = LABELS) -> DataFrame:
    """file, at, record_id, sequence, labels, fault (null, or what is wrong)."""
    spark.dataSource.register(ThreeLineSource)
    return spark.read.format("three_line").options(path=path, split_bytes=split_bytes, labels=labels).load()


def three_line(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, labels: str = LABELS) -> DataFrame:
    """file, record_id, sequence, labels; a malformed record, or an id that repeats, is an error when rows are read."""
    rows = three_line_rows(spark, path, split_bytes, labels)
    twice = rows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.first("record_id").alias("_twice"))
    bad = F.when(F.col("fault").isNotNull(), F.concat(F.lit("malformed three-line record: "), "fault", F.lit(" at "), F.col("at").cast("string"))).when(F.col("_twice").isNotNull(), F.concat(F.lit("repeated record: "), "_twice"))
    return rows.join(F.broadcast(twice)).select("file", "record_id", "sequence", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("labels")).alias("labels"))  # one row


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maximum_bytes", 32 << 20))
        self.expected = set(json.loads(options["expected"])) if options.get("expected") else None

    def partitions(self) -> list[Range]:
        return [Range(f, 0, size) for f, size in _files(self.path)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """A member at a time, as the archive streams by; the set of members is checked at its end."""
        seen: set[str] = set()
        total = 0
        try:
            with _open(partition.file) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                for m in tar:
                    if m.isdir():
                        continue
                    if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/"):
                        raise ValueError(f"{partition.file}: unsafe member {m.name}")
                    if m.name in seen or (self.expected is not None and m.name not in self.expected):
                        raise ValueError(f"{partition.file}: {'repeated' if m.name in seen else 'unexpected'} member {m.name}")
                    seen.add(m.name)
                    total += m.size
                    if total > self.most:
                        raise ValueError(f"{partition.file} holds more than {self.most} bytes")
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([m.name]), pa.array([m.size], pa.int64()), pa.array([tar.extractfile(m).read()], pa.binary())], ["file", "member", "bytes", "content"])
        except (OSError, tarfile.TarError) as e:
            raise ValueError(f"{partition.file} can't be read: {e}") from e
        if self.expected is not None and seen != self.expected:
            raise ValueError(f"{partition.file} lacks {sorted(self.expected - seen)}")


class ArchiveSource(DataSource):
    """Plain files in tar archives (compressed or not), an archive a task. Links, devices, absolute names and names above the
    root are errors, as are members that repeat. Options: path, expected (a JSON list: exactly these members in each archive),
    maximum_bytes (of all members of an archive)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "file string, member string, bytes long, content binary"

    def reader(self, schema) -> ArchiveReader:  # noqa: ARG002
        return ArchiveReader(dict(self.options))


def archive_members(spark: SparkSession, path: str, expected: list[str] | None = None, maximum_bytes: int = 32 << 20) -> DataFrame:
    """Archives at or below a path -> file, member, bytes, content."""
    spark.dataSource.register(ArchiveSource)
    options = {"path": path, "maximum_bytes": maximum_bytes} | ({"expected": json.dumps(sorted(expected))} if expected is not None else {})
    return spark.read.format("tar_members").options(**options).load()
