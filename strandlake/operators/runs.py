"""Runs that can verify themselves: snapshots of their inputs, results, and an identity that both give."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import delete, exists, read_document, write_document
from .verify import _sums, against_stored, row_faults, store_run, unlike_digests

Tables = dict[str, DataFrame]


def _digest(spark: SparkSession, path: str) -> str:
    """One hash of all rows of a stored table, whatever their order and files."""
    r = _sums(spark.read.parquet(f"{path}/digests")).first()
    return hashlib.sha256(f"{r['n']}|{r['s1']}|{r['s2']}".encode()).hexdigest()


def _identity(context: dict) -> str:
    return hashlib.sha256(json.dumps(context, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def _names(spark: SparkSession, folder: str) -> set[str]:
    """What stands in a folder, but for hidden files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith((".", "_"))} if fs.exists(path) else set()


def publish_run(spark: SparkSession, root: str, inputs: Tables, policy: dict, rebuild: Callable[[Tables, dict], Tables], keys: dict[str, list[str]]) -> str:
    """Stores inputs, the policy and what rebuild(inputs, policy) gives below root/<identity>, and returns the identity: of the
    inputs' contents and the policy. The same run again finds its folder and writes nothing. keys: of each table."""
    pending = f"{root}/pending-{hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()[:8]}"
    for name, df in inputs.items():
        delete(spark, f"{pending}/inputs/{name}")
        store_run(df, f"{pending}/inputs/{name}", keys[name])
    context = {"policy": policy, "inputs": {n: _digest(spark, f"{pending}/inputs/{n}") for n in sorted(inputs)}}
    identity = _identity(context)
    if exists(spark, f"{root}/{identity}/context.json"):
        delete(spark, pending)
        return identity
    held = {n: spark.read.parquet(f"{pending}/inputs/{n}/rows").drop("_bucket") for n in inputs}
    for name, df in rebuild(held, policy).items():
        delete(spark, f"{pending}/results/{name}")
        store_run(df, f"{pending}/results/{name}", keys[name])
    results = {n: _digest(spark, f"{pending}/results/{n}") for n in sorted(_names(spark, f"{pending}/results"))}
    write_document(spark, f"{pending}/context.json", context | {"results": results})
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(pending), path(f"{root}/{identity}")):
        raise OSError(f"{identity} can't be put in place")
    return identity


def verify_run(spark: SparkSession, root: str, identity: str, rebuild: Callable[[Tables, dict], Tables], keys: dict[str, list[str]]) -> DataFrame:
    """check_id, status, detail of a stored run: the set of its tables, each input's rows against its digests and these against the
    context, the identity from the context, and each result's rows against what the stored inputs give now.

    Each table is read once; equal tables cost an aggregate (see verify.against_stored). The list of checks is as short as the
    list of tables.
    """
    at = f"{root}/{identity}"
    context = json.loads(read_document(spark, f"{at}/context.json"))
    checks: list[tuple[str, bool, str]] = []
    for kind in ("inputs", "results"):
        want, got = set(context[kind]), _names(spark, f"{at}/{kind}")
        checks.append((f"{kind}-set", want == got, ",".join(sorted(want ^ got))))
    known = {k: context[k] for k in ("policy", "inputs")}
    checks.append(("identity", _identity(known) == identity, _identity(known)))
    held: Tables = {}
    for name in sorted(set(context["inputs"]) & _names(spark, f"{at}/inputs")):
        held[name] = spark.read.parquet(f"{at}/inputs/{name}/rows").drop("_bucket")
        odd = unlike_digests(spark, f"{at}/inputs/{name}", keys[name]).count()
        checks.append((f"input-{name}", odd == 0 and _digest(spark, f"{at}/inputs/{name}") == context["inputs"][name], str(odd)))
    again = rebuild(held, context["policy"]) if set(held) == set(context["inputs"]) else {}
    for name in sorted(again):
        if name in _names(spark, f"{at}/results"):
            path, mine = f"{at}/results/{name}", again[name]
            if unlike_digests(spark, path, keys[name]).isEmpty():
                odd = against_stored(mine, path, keys[name]).count()
            else:  # rows were changed behind their digests: these tell nothing
                stored = spark.read.parquet(f"{path}/rows").drop("_bucket")
                odd = row_faults(stored, mine, keys[name], [c for c in mine.columns if c not in keys[name]]).count()
            checks.append((f"result-{name}", odd == 0 and _digest(spark, path) == context["results"].get(name), str(odd)))
    rows = [(c, "pass" if ok else "fail", detail if not ok else "") for c, ok, detail in checks]
    return spark.createDataFrame(rows, "check_id string, status string, detail string").select("check_id", "status", F.col("detail"))
