"""Components, systems and cycles of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.sources.tables import kept, released


def connected_components(edges: DataFrame, loops: bool = True) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reached.

    Without ``loops``, a node whose only edges lead to itself is left out, and ``edges`` is read once, at the call.

    Each round every node hooks onto the neighbour (or itself) with the smallest digest of that
    round, and edges move to the hooks: a constant share of the nodes goes each round, whatever the
    shape of the graph. Rounds are kept as tables, and labels are carried back through them; tables are removed once read.
    """
    spark = edges.sparkSession
    levels, now = [], kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not now.isEmpty():
        digest = F.xxhash64("w", F.lit(len(levels)))
        both = now.select(F.col("a").alias("node"), F.col("b").alias("w")).unionAll(now.select(F.col("b").alias("node"), F.col("a").alias("w")))
        best = both.groupBy("node").agg(F.min(F.struct(digest.alias("h"), "w")).alias("m"))
        own = F.xxhash64("node", F.lit(len(levels)))
        hooks = kept(best.select("node", F.when(own <= F.col("m.h"), F.col("node")).otherwise(F.col("m.w")).alias("to")))
        levels.append(hooks)
        moved = now.join(hooks.withColumnsRenamed({"node": "a", "to": "ta"}), "a").join(hooks.withColumnsRenamed({"node": "b", "to": "tb"}), "b")
        before, now = now, kept(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        released(before)
    released(now)
    if levels:
        labels = levels.pop()
        while levels:
            upper = labels.select(F.col("node").alias("to"), F.col("to").alias("top"))
            lower = levels.pop()
            joined = kept(lower.join(upper, "to", "left").select("node", F.coalesce("top", "to").alias("to")))
            released(lower, labels)
            labels = joined
        names = labels.groupBy("to").agg(F.min("node").alias("component"))
        found = labels.join(names, "to").select("node", "component")
    else:
        found = spark.createDataFrame([], "node long, component long")
    if not loops:
        return found
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)


def on_cycles(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that topological peeling cannot remove: each lies on or between cycles. Peels leaves of both directions."""
    now, n = kept(edges.select("a", "b").distinct()), None
    while True:
        size = now.count()
        if size == 0 or size == n:
            return now
        n = size
        heads = now.select(F.col("a").alias("b")).distinct()
        tails = now.select(F.col("b").alias("a")).distinct()
        now = kept(now.join(heads, "b", "left_semi").join(tails, "a", "left_semi").select("a", "b"))
