"""Bundles and counts over groups of vectors. A frame of vectors has ``hv array<int>`` and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.functions.vectors import active


def index_counts(df: DataFrame, keys: list[str], hv: str = "hv", times: str | None = None) -> DataFrame:
    """(keys, idx, n): in how many of a group's vectors each index is; a row counts ``times`` times."""
    return df.select(*keys, *[times] * bool(times), F.explode(hv).alias("idx")).groupBy(*keys, "idx").agg((F.sum(times) if times else F.count("*")).alias("n"))


def _collected(df: DataFrame, keys: list[str], groups: DataFrame) -> DataFrame:
    """hv by keys from (keys, idx); the empty vector for groups without any index."""
    hv = df.groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("hv"))
    if not keys:
        return hv
    return groups.join(hv, keys, "left").select(*groups.columns, F.coalesce("hv", F.array().cast("array<int>")).alias("hv"))


def bundle(df: DataFrame, keys: list[str], dim: int, hv: str = "hv", noise: float = 0.0, seed: int = 0, times: str | None = None) -> DataFrame:
    """(keys, members, hv): the indices in at least half of a group's vectors, active(dim) of them at most.

    The most frequent stay, the lesser index first among equals. noise > 0 adds Laplace noise of
    scale 1 / noise to the counts and asks for half of the members; it is drawn by a hash of the
    index and the seed, so that a run repeats. A row counts ``times`` times, a column of numbers.
    """
    groups = df.groupBy(*keys).agg((F.sum(times) if times else F.count(hv)).alias("members"))
    counts = index_counts(df, keys, hv, times)
    counts = counts.join(groups, keys) if keys else counts.crossJoin(groups)
    if noise > 0:
        u = (F.xxhash64(F.lit(seed), *keys, "idx").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52) - 0.5
        counts = counts.withColumn("n", F.col("n") - F.signum(u) * F.log1p(-2 * F.abs(u)) / noise).where(F.col("n") >= F.col("members") / 2)
    else:
        counts = counts.where(F.col("n") >= F.ceil(F.col("members") / 2))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "idx"))
    return _collected(counts.withColumn("_r", rank).where(F.col("_r") <= active(dim)), keys, groups)


def union(df: DataFrame, keys: list[str], hv: str = "hv") -> DataFrame:
    """(keys, members, hv): all indices of a group."""
    groups = df.groupBy(*keys).agg(F.count(hv).alias("members"))
    return _collected(df.select(*keys, F.explode(hv).alias("idx")).distinct(), keys, groups)


def prototype(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """The bundle of ten members or more; of fewer, the most frequent indices without a threshold."""
    groups = df.groupBy(*keys).agg(F.count("hv").alias("members"))
    counts = index_counts(df, keys).join(groups, keys).where((F.col("members") < 10) | (F.col("n") >= F.ceil(F.col("members") / 2)))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "idx"))
    return _collected(counts.withColumn("_r", rank).where(F.col("_r") <= active(dim)), keys, groups)


def weighted_bundle(df: DataFrame, keys: list[str], dim: int, weight: str = "weight", k: int | None = None) -> DataFrame:
    """(keys, hv): the k indices of greatest total weight, active(dim) of them if k isn't given; the lesser first among equals."""
    sums = df.select(*keys, weight, F.explode("hv").alias("idx")).groupBy(*keys, "idx").agg(F.sum(weight).alias("w"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("w"), "idx"))
    return sums.withColumn("_r", rank).where(F.col("_r") <= (k or active(dim))).groupBy(*keys).agg(F.array_sort(F.collect_list("idx")).alias("hv"))


def idf(vectors: DataFrame, dim: int, clip: float = 3.0) -> DataFrame:
    """(idx, df, w) of every index: ln(1 + N / (1 + df)), at most clip times the upper median."""
    counts = vectors.select(F.explode("hv").alias("idx")).groupBy("idx").agg(F.count("*").alias("df"))
    total = vectors.agg(F.count("hv").alias("total"))
    every = vectors.sparkSession.range(dim).select(F.col("id").cast("int").alias("idx"))
    w = every.join(counts, "idx", "left").crossJoin(F.broadcast(total)).select("idx", F.coalesce("df", F.lit(0)).alias("df"), F.log1p(F.col("total") / (1 + F.coalesce("df", F.lit(0)))).alias("w"))
    # by frequency of df, the upper median of the weights without sorting all of them in one place
    steps = w.groupBy("df").agg(F.count("*").alias("n"), F.max("w").alias("w"))
    upto = F.sum("n").over(W.orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    median = steps.withColumn("upto", upto).where(F.col("upto") > dim // 2).agg(F.min("w").alias("median"))
    return w.crossJoin(F.broadcast(median)).select("idx", "df", F.when(F.col("median") > 0, F.least("w", F.col("median") * clip)).otherwise(F.col("w")).alias("w"))


def postings(vectors: DataFrame) -> DataFrame:
    """(idx, df, ids) of every index that is in use."""
    return vectors.select("id", F.explode("hv").alias("idx")).groupBy("idx").agg(F.count("*").alias("df"), F.array_sort(F.collect_set("id")).alias("ids"))


def membership(stored: DataFrame, probes: DataFrame, dim: int) -> DataFrame:
    """(id, z, present): how far the counts at a probe's indices lie above their mean, in deviations; present from 3 on.

    Over an empty store, or for a probe without indices, z is null and present false.
    """
    counts = stored.select(F.explode("hv").alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    mean = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / dim).alias("mean"))
    hits = probes.select("id", F.explode("hv").alias("idx")).join(counts, "idx", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("hits"), F.count("*").alias("k"))
    z = F.when(F.col("mean") > 0, (F.col("hits") - F.col("k") * F.col("mean")) / F.sqrt(F.col("k") * F.col("mean")))
    scored = probes.select("id").distinct().join(hits, "id", "left").crossJoin(F.broadcast(mean)).select("id", z.alias("z"))
    return scored.withColumn("present", F.coalesce(F.col("z") >= 3.0, F.lit(False)))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties counting half."""
    by = df.groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("below", below).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """df with ``rank``, the first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
