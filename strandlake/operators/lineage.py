"""Cycles in lineages of any length: chains are followed by pointer doubling, branchings are trimmed in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def _chains(single: DataFrame) -> DataFrame:
    """(src, dst) with one dst a src -> src, to, ring: where its chain leaves these nodes; ring (to is null), if it never does.

    Pointers double: after k rounds one spans 2**k steps, so rounds grow with the logarithm of the longest chain. Who has not left
    after as many steps as there are nodes goes round in a ring, or leads to one.
    """
    now = checkpointed(single.select("src", F.col("dst").alias("to")))
    n, steps = now.count(), 1
    while steps <= n:
        ahead = now.select(F.col("src").alias("to"), F.col("to").alias("next"))
        moved = checkpointed(now.join(ahead, "to", "left").select("src", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")))
        now, steps = moved.select("src", "to"), steps * 2
        if moved.where("on").isEmpty():
            break
    inside = now.select(F.col("src").alias("to"), F.lit(True).alias("ring")).distinct()
    return now.join(inside, "to", "left").select("src", F.when(F.col("ring").isNull(), F.col("to")).alias("to"), F.col("ring").isNotNull().alias("ring"))


def endless(edges: DataFrame) -> DataFrame:
    """(src, dst) -> node: those from which a walk along the edges never ends, so it leads to a cycle, or the node stands on one.

    Rounds: nodes with one edge are chains, whose ends come by doubling; nodes with several keep the edges that lead to nodes
    which still have some. Where nodes lose edges they become chains or ends. A lineage with one parent each takes one round,
    whatever its length; rounds grow with the number of branchings that hang on each other.
    """
    left = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    rings = left.select(F.col("src").alias("node")).limit(0)
    resolved = left.select("src", F.col("dst").alias("to")).limit(0)  # chains and where they end
    n = left.count()
    while n:
        degree = left.groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("dst"))
        chains = checkpointed(_chains(degree.where("k = 1").select("src", "dst")))
        resolved = resolved.unionByName(chains.where("not ring").select("src", "to"))
        # A branching's edges go on to where chains end. One to a ring decides; those that end nowhere fall away.
        many = left.join(degree.where("k > 1").select("src"), "src", "left_semi").join(chains.withColumnRenamed("src", "dst"), "dst", "left")
        many = many.select("src", F.coalesce("to", "dst").alias("dst"), F.coalesce("ring", F.lit(False)).alias("bad"))
        many = checkpointed(many.groupBy("src", "dst").agg(F.max("bad").alias("bad")))
        bad = checkpointed(many.where("bad").select(F.col("src").alias("node")).distinct())
        rings = checkpointed(rings.unionByName(chains.where("ring").select(F.col("src").alias("node"))).unionByName(bad))
        alive = many.select(F.col("src").alias("dst")).distinct().join(bad.withColumnRenamed("node", "dst"), "dst", "left_anti")
        hit = many.join(bad.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src")
        open_ = many.join(bad.withColumnRenamed("node", "src"), "src", "left_anti")
        while True:
            # Who has an edge to what is endless is endless, too.
            new = checkpointed(hit.distinct().join(rings.withColumnRenamed("node", "src"), "src", "left_anti"))
            if new.isEmpty():
                break
            rings = checkpointed(rings.unionByName(new.withColumnRenamed("src", "node")))
            hit = many.join(new.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src")
        known = rings.withColumnRenamed("node", "src")
        left = checkpointed(open_.join(alive, "dst", "left_semi").join(known, "src", "left_anti").select("src", "dst"))
        m = left.count()
        if m == n:
            # No chain is left, and every node has an edge to another of them.
            rings = rings.unionByName(left.select(F.col("src").alias("node")))
            break
        n = m
    rings, resolved = checkpointed(rings.distinct()), checkpointed(resolved)
    while True:
        # Chains that end at an endless node are endless, too; one may end at a node that a later round resolved.
        new = checkpointed(resolved.join(rings.withColumnRenamed("node", "to"), "to", "left_semi").select(F.col("src").alias("node")).join(rings, "node", "left_anti").distinct())
        if new.isEmpty():
            return rings
        rings = checkpointed(rings.unionByName(new))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): each node's greatest label of all that reach it along (src, dst)."""
    while True:
        came = edges.join(labels.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("came"))
        now = checkpointed(labels.join(came, "node", "left").select("node", F.greatest("label", F.coalesce("came", "label")).alias("label"), (F.coalesce("came", "label") > F.col("label")).alias("new")))
        if now.where("new").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst) -> node: those that stand on a cycle themselves.

    Only nodes from which walks never end forwards nor backwards can. If each has one edge among these both ways they are rings.
    Otherwise a node's greatest ancestor names its colour, and what reaches that ancestor within the colour is its strongly
    connected component; components go, and the rest is coloured anew.
    """
    left = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    found = checkpointed(left.select(F.col("src").alias("node")).limit(0))
    while True:
        for a, b in (("src", "dst"), ("dst", "src")):
            live = endless(left.select(F.col(a).alias("src"), F.col(b).alias("dst")))
            left = checkpointed(left.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if left.isEmpty():
            return found
        nodes = left.select(F.col("src").alias("node")).distinct()
        if left.groupBy("src").count().where("count > 1").isEmpty() and left.groupBy("dst").count().where("count > 1").isEmpty():
            return found.unionByName(nodes)
        colour = _spread(left, checkpointed(nodes.withColumn("label", F.col("node"))))
        of = colour.select(F.col("node").alias("src"), F.col("label").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("label").alias("c2"))
        inner = checkpointed(left.join(of[0], "src").join(of[1], "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seeds = checkpointed(colour.select("node", F.when(F.col("node") == F.col("label"), 1).otherwise(0).alias("label")))
        part = checkpointed(_spread(inner, seeds).where("label = 1").join(colour.withColumnRenamed("label", "c"), "node"))
        rings = part.join(part.groupBy("c").agg(F.count("*").alias("k")).where("k > 1"), "c", "left_semi").select("node")
        found = checkpointed(found.unionByName(rings))
        left = checkpointed(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))


def lineage_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(child, parent) edges over nodes (key, source: whether it has no need of parents) -> key, fault: own_parent,
    unknown_parent, cycle (it stands on one) or built_on_cycle (its parents lead to one)."""
    known = nodes.select(F.col("key").alias("parent"))
    own = edges.where("child = parent").select(F.col("child").alias("key"), F.lit("own_parent").alias("fault"))
    unknown = edges.join(known, "parent", "left_anti").select(F.col("child").alias("key"), F.lit("unknown_parent").alias("fault"))
    real = edges.where("child <> parent").join(known, "parent", "left_semi").join(nodes.where("not source").select(F.col("key").alias("child")), "child", "left_semi")
    real = checkpointed(real.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    lost = endless(real)
    rings = checkpointed(on_cycles(real.join(lost.withColumnRenamed("node", "src"), "src", "left_semi")).distinct())
    built = lost.join(rings, "node", "left_anti").select(F.col("node").alias("key"), F.lit("built_on_cycle").alias("fault"))
    return own.unionByName(unknown).unionByName(rings.select(F.col("node").alias("key"), F.lit("cycle").alias("fault"))).unionByName(built).distinct()
