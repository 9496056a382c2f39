"""Other kinds of vectors as Column expressions: ternary, block codes, phases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- ternary: array<struct<idx:int,sign:int>>, by idx


def ternary(indices: Column, negative: Column) -> Column:
    """Entries of the indices, those with ``negative`` (a boolean array beside them) at -1."""
    return F.array_sort(F.zip_with(indices, negative, lambda i, n: F.struct(i.alias("idx"), F.when(n, -1).otherwise(1).alias("sign"))))


def indices_of(t: Column) -> Column:
    return F.transform(t, lambda e: e.idx)


def _sign_at(t: Column, idx: Column) -> Column:
    return F.aggregate(F.filter(t, lambda e: e.idx == idx), F.lit(0), lambda s, e: s + e.sign)


def ternary_bind(a: Column, b: Column) -> Column:
    """What is in one of them, with its sign; what is in both cancels out."""
    in_a, in_b = indices_of(a), indices_of(b)
    return F.array_sort(F.concat(F.filter(a, lambda e: ~F.array_contains(in_b, e.idx)), F.filter(b, lambda e: ~F.array_contains(in_a, e.idx))))


def ternary_permute(t: Column, shift: int, dim: int) -> Column:
    return F.array_sort(F.transform(t, lambda e: F.struct(F.pmod(e.idx + shift, F.lit(dim)).cast("int").alias("idx"), e.sign.alias("sign"))))


def ternary_similarity(a: Column, b: Column) -> Column:
    """The signed overlap over the root of both sizes; 0 if one is empty."""
    dot = F.aggregate(a, F.lit(0), lambda s, e: s + e.sign * _sign_at(b, e.idx))
    size = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))


def ternary_bundle(df: DataFrame, key: str, t: str) -> DataFrame:
    """(key, t): the indices in half of a group's vectors at least, with the sign of their sum, unless that is 0."""
    n = df.groupBy(key).agg(F.count("*").alias("members"))
    entries = df.select(key, F.explode(t).alias("e")).groupBy(key, F.col("e.idx").alias("idx")).agg(F.count("*").alias("n"), F.sum("e.sign").alias("total")).join(n, key)
    keep = entries.where((F.col("n") >= F.ceil(F.col("members") / 2)) & (F.col("total") != 0))
    made = keep.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.signum("total").cast("int").alias("sign")))).alias(t))
    return n.join(made, key, "left").select(key, F.coalesce(t, F.array().cast("array<struct<idx:int,sign:int>>")).alias(t))


# --- block codes: array<int> of each block's winner


def block_bind(a: Column, b: Column, length: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(length)).cast("int"))


def block_unbind(a: Column, b: Column, length: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(length)).cast("int"))


def block_similarity(a: Column, b: Column) -> Column:
    """The share of blocks with the same winner."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def block_indices(a: Column, length: int) -> Column:
    return F.transform(a, lambda w, i: (i * length + w).cast("int"))


def block_bundle(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code): in each block the winner of most vectors, the greatest among equals."""
    votes = df.select(key, F.posexplode(code).alias("block", "slot")).groupBy(key, "block", "slot").agg(F.count("*").alias("n"))
    best = votes.withColumn("_n", F.row_number().over(W.partitionBy(key, "block").orderBy(F.desc("n"), F.desc("slot")))).where("_n = 1")
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda e: e.slot).alias(code))


def block_recover(probes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(query_id, id, similarity): the entry (id, code) that agrees with most blocks, the last by id among equals."""
    q = probes.select("query_id", F.col("code").alias("_q"))
    scored = codebook.crossJoin(q).select("query_id", "id", block_similarity(F.col("_q"), F.col("code")).alias("similarity"))
    return scored.groupBy("query_id").agg(F.max(F.struct("similarity", "id")).alias("b")).select("query_id", "b.id", "b.similarity")


# --- phases: array<int> modulo n


def phase_bind(a: Column, b: Column, n: int) -> Column:
    return block_bind(a, b, n)


def phase_unbind(a: Column, b: Column, n: int) -> Column:
    return block_unbind(a, b, n)


def phase_similarity(a: Column, b: Column, n: int) -> Column:
    """The mean cosine of the differences; 1 for no phases."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.cos((x - y) * (2 * math.pi / n))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == 0, 1.0).otherwise(total / F.size(a))


def phase_bundle(df: DataFrame, key: str, phases: str, n: int) -> DataFrame:
    """(key, phases): each place's mean direction, from cosines and sines in units of 1 / 16384, rounded to a phase."""
    turn = 2 * math.pi / n
    unit = lambda f: F.sum(F.round(f(F.col("p") * turn) * 16384).cast("bigint"))
    sums = df.select(key, F.posexplode(phases).alias("d", "p")).groupBy(key, "d").agg(unit(F.cos).alias("x"), unit(F.sin).alias("y"))
    at = F.pmod(F.round(F.atan2("y", "x") / turn).cast("int"), F.lit(n)).cast("int")
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", at.alias("p")))), lambda e: e.p).alias(phases))


def phase_trace(triples: DataFrame, phases: DataFrame, n: int) -> DataFrame:
    """(d, phase, cnt): the store of facts: how often each place holds each phase of subject + relation + object.

    Counts only add up, so a stream of facts is one aggregation.
    """
    rows = triples
    for name in "sro":
        rows = rows.join(phases.select(F.col("id").alias(name), F.col("phases").alias(f"_{name}")), name)
    bound = phase_bind(phase_bind(F.col("_s"), F.col("_r"), n), F.col("_o"), n)
    return rows.select(F.posexplode(bound).alias("d", "phase")).groupBy("d", "phase").agg(F.count("*").alias("cnt"))


def phase_score(queries: DataFrame, trace: DataFrame, n: int, dim: int) -> DataFrame:
    """(query_id, score): what the store holds at a bound fact's phases above the average."""
    total = trace.agg(F.sum("cnt").alias("total"))
    q = queries.select("query_id", F.posexplode("phases").alias("d", "phase"))
    raw = q.join(trace, ["d", "phase"], "left").groupBy("query_id").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("raw"))
    return raw.crossJoin(F.broadcast(total)).select("query_id", ((F.col("raw") - F.coalesce("total", F.lit(0)) / n) / dim).alias("score"))
