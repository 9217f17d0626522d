"""Identity by content: canonical JSON, sequence and evidence ids, split buckets."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def canonical_sha256(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; for strings and integers, whose text is the same everywhere."""
    return sha256(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substr(sha256(F.concat_ws("|", *parts)), F.lit(1), F.lit(digits)))


def bucket(line: Column, seed: int, buckets: int = 10_000) -> Column:
    """A line's bucket, from the first 60 bits of SHA-256(seed, NUL, line)."""
    digest = sha256(F.concat(F.lit(f"{seed}\0"), line))
    return F.pmod(F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def blake_bucket(seed: int, buckets: int = 10_000):
    """The same by BLAKE2b with 8 bytes, big-endian, which the JVM lacks: a pandas UDF."""

    @F.pandas_udf("int")
    def of(line: pd.Series) -> pd.Series:
        return line.map(lambda x: int.from_bytes(hashlib.blake2b(f"{seed}\0{x}".encode(), digest_size=8).digest(), "big") % buckets).astype("int32")

    return of


def validation_buckets(fraction: float) -> int:
    """How many of 10,000 buckets are validation: one at least, never all."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    return min(max(round(fraction * 10_000), 1), 9_999)
