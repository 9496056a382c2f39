"""Graph operators over relations (source, type, target, valid_from, valid_to); times in ms, 0 for open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.sources.tables import checkpointed


def valid_at(t: float) -> Column:
    """At time 0 only what has no end; else what lies within both ends."""
    if t == 0:
        return F.col("valid_to") == 0
    return ((F.col("valid_from") == 0) | (F.col("valid_from") <= t)) & ((F.col("valid_to") == 0) | (F.col("valid_to") >= t))


def outgoing(relations: DataFrame, node: str | Column, kind: str | None = None, t: float = 0) -> DataFrame:
    out = relations.where((F.col("source") == node) & valid_at(t))
    return out.where(F.col("type") == kind) if kind else out


def incoming(relations: DataFrame, node: str | Column, kind: str | None = None, t: float = 0) -> DataFrame:
    out = relations.where((F.col("target") == node) & valid_at(t))
    return out.where(F.col("type") == kind) if kind else out


def remove_first(relations: DataFrame, source: str, kind: str, target: str, order: str = "seq") -> DataFrame:
    """relations without the first that matches."""
    hit = (F.col("source") == source) & (F.col("type") == kind) & (F.col("target") == target)
    first = relations.where(hit).agg(F.min(order).alias("_first"))
    return relations.crossJoin(F.broadcast(first)).where(~hit | (F.col(order) != F.col("_first"))).drop("_first")


def traverse(relations: DataFrame, starts: DataFrame, depth: int = 3, kind: str | None = None, t: float = 0, types: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, path, types, score, inferred) of what is reached from ``starts`` (start), breadth first.

    A node is reached once, at its least depth, by the least path. Symmetric types (types: name,
    transitive, symmetric) run both ways. A hop scores the Jaccard of its ends' vectors (id, hv), 0
    if one has none, and 1 without vectors; a path the product. If the type asked for is transitive,
    each path of two hops or more gives a hop from its start to its end, inferred.
    """
    edges = relations.where(valid_at(t)).select("source", "type", "target")
    if kind:
        edges = edges.where(F.col("type") == kind)
    if types is not None:
        both = edges.join(F.broadcast(types.where("symmetric").select(F.col("name").alias("type"))), "type", "left_semi")
        edges = edges.unionByName(both.select(F.col("target").alias("source"), "type", F.col("source").alias("target")))
    edges = edges.distinct()
    if vectors is not None:
        a, b = (vectors.select(F.col("id").alias(x), F.col("hv").alias(f"_{x}")) for x in ("source", "target"))
        both = edges.join(a, "source", "left").join(b, "target", "left")
        common = F.size(F.array_intersect("_source", "_target"))
        size = F.size("_source") + F.size("_target") - common
        edges = both.select("source", "type", "target", F.when(F.col("_source").isNull() | F.col("_target").isNull(), 0.0).when(size == 0, 1.0).otherwise(common / size).alias("hop"))
    else:
        edges = edges.withColumn("hop", F.lit(1.0))
    reached = front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("score"))
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["source"]).select(
            "start", F.col("target").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("target")).alias("path"), F.concat("types", F.array("type")).alias("types"), (F.col("score") * F.col("hop")).alias("score")
        )
        step = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        first = F.row_number().over(W.partitionBy("start", "node").orderBy("path", "types"))
        front = checkpointed(step.withColumn("_n", first).where("_n = 1").drop("_n").select(*reached.columns))
        reached = reached.unionByName(front)
    out = reached.where("depth > 0").withColumn("inferred", F.lit(False))
    if kind and types is not None:
        carries = F.broadcast(types.where(F.col("transitive") & (F.col("name") == kind)).select(F.lit(1).alias("_t")).limit(1))
        far = out.where("depth > 1").crossJoin(carries).drop("_t")
        out = out.unionByName(far.select("start", "node", F.lit(1).alias("depth"), F.array("start", "node").alias("path"), F.array(F.lit(kind)).alias("types"), "score", F.lit(True).alias("inferred")))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for undirected edges (u, v): the least node that each is connected to.

    Stars by turns, each a shuffle of the edges, until nothing changes; the number of rounds grows
    with the logarithm of the longest chain.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    lone = edges.where("u = v").select(F.col("u").alias("node"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(W.partitionBy("u")), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.where("u > v").distinct().withColumn("m", F.min("v").over(W.partitionBy("u")))
        now = checkpointed(least.select("u", F.col("m").alias("v")).unionByName(least.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node")).unionByName(lone).distinct()
    return found.unionByName(roots.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
