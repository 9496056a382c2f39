"""Product quantisation of sparse vectors, and a walk over a neighbour graph."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hvspark.operators.aggregate import top_per
from hvspark.operators.factor import subcodes
from hvspark.operators.retrieve import top_k


def train_codes(vectors: DataFrame, dim: int, parts: int = 16, codes: int = 16, rounds: int = 10) -> dict[int, list[list[int]]]:
    """For each range of the dimension, centres of the vectors' indices in it.

    Binary k-means: a vector goes to the centre of least symmetric difference, a centre keeps the
    indices of at least half of its vectors. Equal parts are counted as one before they are
    gathered by range, so a group has as many rows as there are distinct parts.
    """
    rows = vectors.select(F.posexplode(subcodes(F.col("hv"), dim, parts)).alias("part", "sub")).groupBy("part", "sub").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.assign(key=[tuple(x) for x in pdf["sub"]]).sort_values(["n", "key"], ascending=[False, True])
        size = dim // parts
        x = np.zeros((len(pdf), size), np.float32)
        for i, sub in enumerate(pdf["key"]):
            x[i, list(sub)] = 1
        n = pdf["n"].to_numpy(np.float64)
        centres = x[: min(codes, len(x))].copy()
        for _ in range(rounds):
            near = (x.sum(1)[:, None] + centres.sum(1)[None] - 2 * x @ centres.T).argmin(1)
            new = centres.copy()
            for c in range(len(centres)):
                own = near == c
                if own.any():
                    new[c] = (n[own] @ x[own]) * 2 >= n[own].sum()
            if (new == centres).all():
                break
            centres = new
        return pd.DataFrame({"part": part, "code": range(len(centres)), "centre": [np.flatnonzero(c).tolist() for c in centres]})

    book: dict[int, list[list[int]]] = {}
    for r in rows.groupBy("part").applyInPandas(fit, "part int, code int, centre array<int>").orderBy("part", "code").collect():
        book.setdefault(r["part"], []).append(list(r["centre"]))
    return book


def encode_codes(vectors: DataFrame, book: dict[int, list[list[int]]], dim: int) -> DataFrame:
    """(id, codes): in each range the centre of least symmetric difference, the first among equals."""

    def run(batches):
        for pdf in batches:
            codes = [[min(range(len(book[p])), key=lambda c, s=set(s), p=p: (len(s ^ set(book[p][c])), c)) for p, s in enumerate(subs)] for subs in pdf["subs"]]
            yield pd.DataFrame({"id": pdf["id"], "codes": codes})

    rows = vectors.select("id", subcodes(F.col("hv"), dim, len(book)).alias("subs"))
    return rows.mapInPandas(run, f"id {dict(vectors.dtypes)['id']}, codes array<int>")


def search_codes(queries: DataFrame, encoded: DataFrame, book: dict[int, list[list[int]]], dim: int, k: int) -> DataFrame:
    """(query_id, rank, id, similarity): by the distances of each query's ranges to the codes, summed by a join on (range, code); similarity 1 - d / 2m."""
    parts, m = len(book), max(dim // 256, 1)
    schema = "part int, code int, centre array<int>"
    table = queries.sparkSession.createDataFrame([(p, c, x) for p, cs in book.items() for c, x in enumerate(cs)], schema)
    q = queries.select("query_id", F.posexplode(subcodes(F.col("hv"), dim, parts)).alias("part", "sub"))
    far = F.size(F.array_except("sub", "centre")) + F.size(F.array_except("centre", "sub"))
    costs = q.join(F.broadcast(table), "part").select("query_id", "part", "code", far.alias("d"))
    items = encoded.select("id", F.posexplode("codes").alias("part", "code"))
    scored = items.join(costs, ["part", "code"]).groupBy("query_id", "id").agg((1 - F.sum("d") / (2 * m)).alias("similarity"))
    return top_per(scored, ["query_id"], k, F.desc("similarity"), F.col("id")).select("query_id", "rank", "id", "similarity")


def neighbour_graph(vectors: DataFrame, degree: int = 32) -> DataFrame:
    """(id, hv, near): the exact nearest neighbours of each vector, by the overlap join."""
    near = top_k(vectors.withColumnRenamed("id", "query_id"), vectors, degree + 1).where("query_id <> id")
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("near"))
    kind = dict(vectors.dtypes)["id"]
    return vectors.join(lists, "id", "left").select("id", "hv", F.coalesce("near", F.array().cast(f"array<{kind}>")).alias("near"))


def walk(queries: DataFrame, graph: DataFrame, k: int, beam: int = 64, shards: int = 1) -> DataFrame:
    """(query_id, rank, id, similarity): best-first walks with a beam over the part of the graph in each shard, merged.

    A shard's graph has to fit into one task; its walk starts at several nodes, so that parts
    without a way between them are reached.
    """
    placed = graph.toDF("g_id", "g_hv", "g_near").withColumn("g_shard", F.pmod(F.xxhash64("g_id"), F.lit(shards)))
    asked = queries.crossJoin(queries.sparkSession.range(shards).select(F.col("id").alias("shard")))
    kind, ask = dict(graph.dtypes)["id"], dict(queries.dtypes)["query_id"]

    def go(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("g_id")
        sets = {i: frozenset(h) for i, h in zip(g["g_id"], g["g_hv"])}
        near = dict(zip(g["g_id"], g["g_near"]))
        ids = list(sets)
        rows = []
        for qid, hv in zip(q["query_id"], q["hv"]):
            x = frozenset(hv)
            sim = lambda i, x=x: len(x & sets[i]) / max(1, len(x | sets[i]))
            seen = set(ids[:: max(1, len(ids) // beam)])
            found = [(sim(i), i) for i in seen]
            front = [(-s, i) for s, i in found]
            heapq.heapify(front)
            while front:
                s, i = heapq.heappop(front)
                best = sorted(found, key=lambda t: (-t[0], t[1]))[:beam]
                if len(best) == beam and -s < best[-1][0]:
                    break
                for j in near[i]:
                    if j in sets and j not in seen:
                        seen.add(j)
                        t = sim(j)
                        found.append((t, j))
                        heapq.heappush(front, (-t, j))
            rows += [(qid, i, s) for s, i in sorted(found, key=lambda t: (-t[0], t[1]))[:k]]
        return pd.DataFrame(rows, columns=["query_id", "id", "similarity"])

    found = asked.groupBy("shard").cogroup(placed.groupBy("g_shard")).applyInPandas(go, f"query_id {ask}, id {kind}, similarity double")
    return top_per(found, ["query_id"], k, F.desc("similarity"), F.col("id")).select("query_id", "rank", "id", "similarity")
