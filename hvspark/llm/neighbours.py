"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a sample of FIT_ROWS vectors, about, chosen by a hash (all of them where there are
fewer): each node is split into BRANCHES by k-means until it has at most LEAF of the sample. Then every
vector is indexed: it goes to the leaf that the nearest children lead to. A search keeps the branches not
yet taken in a priority queue, by distance to their centres, and opens the nearest one
again and again, until it has visited as many leaves as it may. How many that are is calibrated: for a sample of
vectors the exact neighbours among all are computed, and visits are widened until their recall
reaches RECALL.

A query is sent to the leaves it visits, meets the vectors there, and its best of all leaves are merged.
The tree's size is bounded by the sample, so leaves grow with the data: the vectors of a leaf, and the
queries that visit it, are cut into blocks of BLOCK_ROWS, and each two of these meet in a task of their own.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import checkpointed, load

NEIGHBOURS = 10
BRANCHES = 8
LEAF = 256  #: vectors of the sample
FIT_ROWS = 1 << 16
BLOCK_ROWS = 1 << 14
ROUNDS = 8  #: of k-means a level
RECALL = 0.95
SAMPLE = 256  #: vectors for calibration, about
CHUNK = 1 << 20  #: distances computed at a time
EACH = 100  #: the query's vectors are those whose id this divides


@dataclass
class Tree:
    centres: np.ndarray  #: of each node; the root is node 0
    children: list[list[int]]  #: none for a leaf
    dim: int

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x, always by the nearest child, the first among equals."""
        node = np.zeros(len(x), np.int64)
        active = np.arange(len(x))
        while len(active):
            for n in np.unique(node[active]).tolist():
                if self.children[n]:
                    own = active[node[active] == n]
                    node[own] = np.array(self.children[n])[nearest(x[own], self.centres[self.children[n]])]
            active = active[[bool(self.children[n]) for n in node[active].tolist()]]
        return node

    def visits(self, x: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first search for one vector, in its order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            while self.children[n]:
                kids = self.children[n]
                d = ((self.centres[kids] - x) ** 2).sum(1)
                best = int(np.argmin(d))
                for i, (far, kid) in enumerate(zip(d.tolist(), kids)):
                    if i != best:
                        heapq.heappush(queue, (far, kid))
                n = kids[best]
            out.append(n)
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the usable rows, and their length: that of most rows, the greater among equals.

    Rows are left out whose id or vector is null, whose vector is empty, of another length or has
    a null, NaN or infinite member; of rows with one id the least vector stays.
    """
    kind = "float" if dict(table.dtypes)[column] == "array<float>" else "double"
    v = F.col(column).cast(f"array<{kind}>")
    fine = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(key).isNotNull() & v.isNotNull() & fine).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(v).alias("v"))
    rows = checkpointed(rows)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = top["n"] if top else 0
    return rows.where(F.size("v") == dim), dim


def sampled(rows: DataFrame, n: int, total: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about n of the rows (id, v), of which there are ``total``, by a hash; all of them where there are no more."""
    share = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n / max(1, total)))
    t = rows.where(share).select("id", "v").toArrow()
    if not t.num_rows:
        return np.empty(0, np.int64), np.empty((0, 0))
    ids = t["id"].to_numpy()
    x = np.asarray(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], x[order]


def grow(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over the rows of x. A node whose vectors k-means doesn't part, as where all are equal, stays a leaf."""
    dim = x.shape[1] if len(x) else 0
    centres, children, todo = [np.zeros(dim)], [[]], [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) <= leaf:
            continue
        seeds = np.unique(x[own[:: max(1, len(own) // (4 * BRANCHES))]], axis=0)
        chosen = [0]  # spread, by always taking the one farthest from those taken
        far = ((seeds - seeds[0]) ** 2).sum(1)
        while len(chosen) < min(BRANCHES, len(seeds)) and far.max() > 0:
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, ((seeds - seeds[chosen[-1]]) ** 2).sum(1))
        middle = seeds[chosen]
        for _ in range(ROUNDS):
            of = nearest(x[own], middle)
            n = np.bincount(of, minlength=len(middle))
            sums = np.zeros_like(middle)
            np.add.at(sums, of, x[own])
            middle = sums[n > 0] / n[n > 0, None]
        of = nearest(x[own], middle)
        parts = [own[of == i] for i in range(len(middle))]
        if max(map(len, parts)) == len(own):
            continue
        children[node] = list(range(len(centres), len(centres) + len(parts)))
        todo += list(zip(children[node], parts))
        centres += list(middle)
        children += [[] for _ in parts]
    return Tree(np.stack(centres), children, dim)


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in x, squared distance) of the k nearest others of each q, ties by id.

    A matrix product ranks them; all that may be among the k for its rounding are then measured by
    their differences, so that equal vectors are at 0 and ties are ties.
    """
    d = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    slack = 1e-9 * (np.abs(q).max(initial=0) + np.abs(x).max(initial=0)) ** 2 * x.shape[1]
    d[q_ids[:, None] == ids[None, :]] = np.inf
    edge = np.partition(d, k - 1, 1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    i, j = np.nonzero((d <= edge[:, None] + slack) & (d < np.inf))
    far = ((q[i] - x[j]) ** 2).sum(1)
    order = np.lexsort((ids[j], far, i))
    i, j, far = i[order], j[order], far[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], far[keep]


def _exact(shared, dim: int, k: int):
    def run(batches):
        ids, q = shared.value
        for b in batches:
            if b.num_rows:
                own, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                for lo in range(0, len(own), step := max(k + 1, CHUNK // max(1, len(q)))):
                    i, j, far = best_of(q, ids, x[lo : lo + step], own[lo : lo + step], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[lo : lo + step][j]), pa.array(far)], ["id", "neighbour", "d"])

    return run


def _top(k: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["neighbour"].to_numpy(), t["d"].to_numpy()))[:k]
        return t.take(pa.array(order))

    return run


def calibrate(rows: DataFrame, tree: Tree, k: int, total: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """Leaves to visit, so that the sample's neighbours among all rows are found with the given recall.

    A neighbour counts as found if its leaf is visited.
    """
    spark = rows.sparkSession
    ids, q = sampled(rows, sample, total, 2)
    if not len(ids):
        return 1
    shared = spark.sparkContext.broadcast((ids, q))
    schema = "id bigint, neighbour bigint, d double"
    truth = rows.mapInArrow(_exact(shared, tree.dim, k), schema).groupBy("id").applyInArrow(_top(k), schema)
    found = truth.join(rows.withColumnRenamed("id", "neighbour"), "neighbour").select("id", "v").collect()
    leaf = tree.descend(np.array([r["v"] for r in found], np.float64)) if found else []
    wanted: dict[int, list[int]] = {}
    for r, x in zip(found, leaf):
        wanted.setdefault(r["id"], []).append(int(x))
    leaves = sum(not c for c in tree.children)
    order = {i: {n: at for at, n in enumerate(tree.visits(x, leaves))} for i, x in zip(ids.tolist(), q)}
    ranks = np.sort([order[i][n] for i, ns in wanted.items() for n in ns])
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1 if len(ranks) else 1


def _leaves(shared, dim: int, visits: int | None):
    """(leaf, id, v): the leaf of each vector, or the first ``visits`` leaves of a search for it."""

    def run(batches):
        tree = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                where = [[n] for n in tree.descend(x).tolist()] if visits is None else [tree.visits(r, visits) for r in x]
                at = pa.array(np.repeat(np.arange(len(x)), [len(w) for w in where]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where).astype(np.int64)), b.column(0).take(at), b.column(1).take(at)], ["leaf", "id", "v"])

    return run


def _meet(dim: int, k: int):
    def run(asked: pa.Table, t: pa.Table) -> pa.Table:
        a, b, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if asked.num_rows and t.num_rows:
            q_ids, q, ids, x = asked["id"].to_numpy(), _matrix(asked["v"].combine_chunks(), dim), t["id"].to_numpy(), _matrix(t["v"].combine_chunks(), dim)
            out = []
            for lo in range(0, len(q_ids), step := max(1, CHUNK // len(ids))):
                i, j, far = best_of(q[lo : lo + step], q_ids[lo : lo + step], x, ids, k)
                out.append((q_ids[lo : lo + step][i], ids[j], far))
            a, b, d = (np.concatenate(z) for z in zip(*out))  # of one query side by side
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        ends = pa.array(np.append(first, len(a)).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(d), pa.array(b)], ["d", "neighbour"])
        return pa.table({"id": a[first], "best": pa.ListArray.from_arrays(ends, pairs)})

    return run


def _blocks(rows: DataFrame, other: DataFrame, mine: str, theirs: str, each: int) -> DataFrame:
    """rows (leaf, id, v) with a block by a hash of the id, once for each block of the other side; the leaves, which are bounded, are counted."""
    count = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / each).cast("int").alias(name))
    n = F.broadcast(count(rows, "_n").join(count(other, "_m"), "leaf"))
    return rows.join(n, "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias(theirs), "id", "v")


def neighbours(table: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", column: str = "embedding", recall: float = RECALL, leaf: int = LEAF, each: int = 1, block_rows: int = BLOCK_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest others among all vectors, by Euclidean distance, of each vector whose id ``each`` divides.

    Ties go to the lesser id, also where vectors are equal, at distance 0. With fewer than k other
    vectors there are fewer neighbours. Rows without a usable vector (see ``vectors``) have none
    and are nobody's. Other columns don't matter.
    """
    rows, dim = vectors(table, key, column)
    rows = rows.select("id", "v")
    total = rows.count()
    tree = grow(sampled(rows, fit_rows, total, 1)[1], leaf)
    tree.dim = dim
    visits = calibrate(rows, tree, k, total, recall) if dim else 1
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    kind = f"leaf bigint, id bigint, v {dict(rows.dtypes)['v']}"
    index = checkpointed(rows.mapInArrow(_leaves(shared, dim, None), kind))
    asked = checkpointed(rows.where(F.pmod("id", F.lit(each)) == 0).repartition(F.col("id")).mapInArrow(_leaves(shared, dim, visits), kind))
    meeting = ["leaf", "p", "q"]
    met = _blocks(asked, index, "p", "q", block_rows).groupBy(*meeting).cogroup(_blocks(index, asked, "q", "p", block_rows).groupBy(*meeting))
    found = met.applyInArrow(_meet(dim, k), "id bigint, best array<struct<d:double,neighbour:bigint>>")
    ranked = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return ranked.select("id", F.posexplode("best").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), "x.neighbour", F.sqrt("x.d").alias("distance"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id EACH divides, against all vectors."""
    return neighbours(load(spark, sf_dir, "embeddings"), each=EACH).withColumnRenamed("id", "vec_id")


QUERIES = {"op8_nearest_neighbours": op8_nearest_neighbours}
ORACLES: dict[str, str] = {}
