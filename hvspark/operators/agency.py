"""Goals, backward plans, questions and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.sources.tables import checkpointed


def utility(goals: DataFrame) -> DataFrame:
    """Active goals (name, relevance, urgency, cost, active) with their utility, best first."""
    worth = F.col("relevance") * F.col("urgency") * (1 - F.least(F.greatest("cost", F.lit(0.0)), F.lit(0.99)))
    return goals.where("active").withColumn("utility", worth).orderBy(F.desc("utility"), "name")


def plan(triples: DataFrame, goals: DataFrame, causal: list[str], depth: int = 5) -> DataFrame:
    """(goal, subject, relation, object, depth, cost): causes from (goal) backwards, each node once, at its least depth.

    A step costs 1 / (1 + the causes that its object has); of several ways to a node at one depth the
    one of least total cost is taken, then the first by name.
    """
    edges = triples.where(F.col("r").isin(causal)).select("s", "r", "o").distinct()
    fan = edges.groupBy("o").agg((1 / (1 + F.count("*"))).alias("cost"))
    edges = checkpointed(edges.join(fan, "o"))
    seen = front = goals.select("goal", F.col("goal").alias("node"), F.lit(0.0).alias("total"))
    out = None
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["o"]).select("goal", "s", "r", "o", (F.col("total") + F.col("cost")).alias("total"), "cost")
        step = step.join(seen.select("goal", F.col("node").alias("s")), ["goal", "s"], "left_anti")
        first = F.row_number().over(W.partitionBy("goal", "s").orderBy("total", "o", "r"))
        step = checkpointed(step.withColumn("_n", first).where("_n = 1").drop("_n"))
        front = step.select("goal", F.col("s").alias("node"), "total")
        seen = seen.unionByName(front)
        rows = step.select("goal", F.col("s").alias("subject"), F.col("r").alias("relation"), F.col("o").alias("object"), F.lit(d).alias("depth"), "cost")
        out = rows if out is None else out.unionByName(rows)
    return out


def complete(steps: DataFrame, triples: DataFrame) -> DataFrame:
    """(goal, complete): whether every cause that nothing leads to is a subject of its own."""
    leaves = steps.join(steps.select("goal", F.col("object").alias("subject")), ["goal", "subject"], "left_anti")
    known = triples.select(F.col("s").alias("subject")).distinct().withColumn("_k", F.lit(True))
    return leaves.join(known, "subject", "left").groupBy("goal").agg(F.bool_and(F.coalesce("_k", F.lit(False))).alias("complete"))


def gap_questions(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("question", F.format_string("What is the %s of %s?", "r", "s"))


def hypothesis_questions(found: DataFrame) -> DataFrame:
    return found.withColumn("question", F.format_string("Is it true that %s %s %s?", "s", "r", "o"))


def proposals(events: DataFrame) -> DataFrame:
    """(id, state): the state after all events (seq, id, op) that were allowed: propose, approve or reject while pending, apply when approved."""
    ops = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("ops"))
    moved = F.aggregate(
        F.col("ops.op"),
        F.lit("none"),
        lambda state, op: F.when((state == "none") & (op == "propose"), "pending").when((state == "pending") & (op == "approve"), "approved").when((state == "pending") & (op == "reject"), "rejected").when((state == "approved") & (op == "apply"), "applied").otherwise(state),
    )
    return ops.select("id", moved.alias("state")).where("state <> 'none'")
