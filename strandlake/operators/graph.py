"""Small graphs and greedy covers: stage DAGs, lineage, lane rescue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder.

    A checkpoint keeps the estimated size of the plan that made it, and a join's is the product of its sides': in a loop its
    digits double each round, until the driver's memory or time ends. An estimate beyond 64 bits says nothing and is dropped.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()
    query = kept._jdf.queryExecution()
    if query.optimizedPlan().stats().sizeInBytes() < 2**63:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(query.toRdd(), kept._jdf.schema(), False), spark)


def depths(edges: DataFrame, root: object, most: int = 1000) -> DataFrame:
    """src -> dst edges: each node that the root reaches with its least depth, breadth first.

    Frontiers are kept in the shared folder, so no lineage grows; a step costs one join with the edges.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["dst"]
    front = checkpointed(spark.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth")))
    seen = front
    for step in range(1, most):
        nxt = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = nxt.withColumn("depth", F.lit(step)).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("deeper than allowed")


def workflow_faults(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults of a stage graph, one row each: unknown dependency, several or no roots, nodes that no root reaches, cycles."""
    nodes = stages.select("stage").distinct()
    unknown = edges.join(nodes, edges["src"] == nodes["stage"], "left_anti").select(F.lit("unknown_dependency").alias("fault"), F.col("src").alias("stage"))
    roots = nodes.join(edges, nodes["stage"] == edges["dst"], "left_anti")
    many = roots.where(F.lit(roots.count() != 1)).select(F.lit("several_roots").alias("fault"), "stage")
    first = roots.agg(F.min("stage")).first()[0]
    reached = depths(edges.select("src", "dst"), first) if first is not None else None
    lost = nodes if reached is None else nodes.join(reached, nodes["stage"] == reached["node"], "left_anti")
    return unknown.unionByName(many).unionByName(lost.select(F.lit("not_reached_or_cycle").alias("fault"), "stage"))


#: Rows that the driver holds while it picks.
HEAP = 1024


def greedy_cover(df: DataFrame, key: str, features: str, order: str, budget: int, covered: list[str] | None = None) -> DataFrame:
    """Rows chosen one after the other for the most features not covered yet, ties by order, until nothing is gained or
    the budget is reached: key, place, gain. covered: features that need no row. order: a struct without nulls that ends with the key.

    Gains only fall, so a row's last known gain bounds it. Of rows with the same features only the first in order can be chosen: they
    are combined once and kept. A scan of these brings the HEAP best by gain to the driver, which picks among them as long as
    one is at least as good as the last of them was at the scan, so as any row that it doesn't hold can be; then the next
    scan begins. Scans are few, and a pick reads at most HEAP rows.
    """
    import heapq

    spark = df.sparkSession
    kinds = dict(df.dtypes)
    rows = df.select(F.array_sort(F.array_distinct(features)).alias("f"), F.struct(F.col(order).alias("o"), F.col(key).alias("k")).alias("r"))
    left = checkpointed(rows.where(F.size("f") > 0).groupBy("f").agg(F.min("r").alias("r")).select("f", "r.o", "r.k"))
    done, chosen, taken = set(covered or ()), [], set()
    plain = lambda o: tuple(plain(x) if isinstance(x, tuple) else x for x in o) if isinstance(o, tuple) else (o,)
    while len(chosen) < budget:
        gain = F.size(F.array_except("f", F.array(*map(F.lit, sorted(done))).cast(kinds[features])))
        best = left.withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "o").limit(HEAP).collect()  # HEAP rows
        if not best:
            break
        limit = (-best[-1]["gain"], plain(best[-1]["o"])) if len(best) == HEAP else (0, ())
        heap = [(-r["gain"], plain(r["o"]), i) for i, r in enumerate(best)]
        heapq.heapify(heap)
        before = len(chosen)
        while heap and len(chosen) < budget:
            known, o, i = heap[0]
            now = len(set(best[i]["f"]) - done)
            if -now != known:  # its gain has fallen since
                heapq.heapreplace(heap, (-now, o, i)) if now else heapq.heappop(heap)
                continue
            if len(best) == HEAP and (known, o) > limit:
                break
            heapq.heappop(heap)
            if best[i]["k"] not in taken:
                chosen.append((best[i]["k"], len(chosen) + 1, now))
                taken.add(best[i]["k"])
                done |= set(best[i]["f"])
        assert len(chosen) > before
    return spark.createDataFrame(chosen, f"{key} {kinds[key]}, place int, gain int")
