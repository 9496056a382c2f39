"""Factorisation of bound vectors over codebooks, and clusters of vectors with centres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.functions.vectors import active, jaccard
from hvspark.operators.aggregate import bundle
from hvspark.operators.graph import components
from hvspark.operators.retrieve import similar_pairs


def _hamming(x: set, y: set) -> int:
    return len(x ^ y)


def denoise(x: np.ndarray, book: np.ndarray, steps: int = 10, start: float = 0.5, end: float = 0.01, step: float = 0.1, langevin: int = 5, rng=None) -> np.ndarray:
    """A real vector drawn towards the codebook's rows by annealed Langevin steps, its noise falling from start to end."""
    rng = rng or np.random.default_rng(0)
    for sigma in np.geomspace(start, end, steps):
        for _ in range(langevin):
            d = ((book - x) ** 2).sum(1) / (2 * sigma**2 * max(1, book.shape[1]) / 64)
            w = np.exp(d.min() - d)
            pull = (w / w.sum()) @ book - x
            x = x + step * pull + np.sqrt(2 * step) * sigma * 0.01 * rng.standard_normal(len(x))
    return x


def factorise(products: DataFrame, books: list[list[tuple[str, list[int]]]], dim: int, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(id, factors array<string>, distance): one entry of each codebook whose binding comes nearest to hv.

    Estimates start from all entries; in turn each factor is what remains of the product when the
    others are bound out, drawn towards its codebook, and set to the nearest entry. It ends when
    nothing changes; distance is that of the product to what was found. The codebooks go to every task.
    """
    names = [[n for n, _ in b] for b in books]
    dense = []
    for b in books:
        m = np.zeros((len(b), dim))
        for i, (_, hv) in enumerate(b):
            m[i, hv] = 1
        dense.append(m)
    sets = [[set(hv) for _, hv in b] for b in books]

    def solve(hv: list[int]) -> tuple[list[str], int]:
        product, best = set(hv), None
        rng = np.random.default_rng(seed)
        for attempt in range(4):
            now = [int(rng.integers(len(b))) for b in books] if attempt else [0] * len(books)
            for _ in range(rounds):
                before = list(now)
                for k in range(len(books)):
                    rest = set(product)
                    for j in range(len(books)):
                        if j != k:
                            rest ^= sets[j][now[j]]
                    x = np.zeros(dim)
                    x[[i for i in rest if i < dim]] = 1
                    x = denoise(x, dense[k], rng=rng)
                    now[k] = int(np.argmin(((dense[k] - x) ** 2).sum(1)))
                if now == before:
                    break
            made: set = set()
            for k, i in enumerate(now):
                made ^= sets[k][i]
            far = _hamming(made, product)
            if best is None or far < best[1]:
                best = ([names[k][i] for k, i in enumerate(now)], far)
            if far == 0:
                break
        return best

    def run(batches):
        for pdf in batches:
            found = [solve(list(x)) for x in pdf["hv"]]
            yield pd.DataFrame({"id": pdf["id"], "factors": [f for f, _ in found], "distance": [d for _, d in found]})

    return products.select("id", "hv").mapInPandas(run, f"id {dict(products.dtypes)['id']}, factors array<string>, distance int")


def resonate(products: DataFrame, books: list[np.ndarray], n: int, rounds: int = 50) -> DataFrame:
    """(id, factors array<int>, steps): the rows of phase codebooks whose sum modulo n is nearest to phases.

    Each factor's estimate is a superposition of its codebook's rows, weighed by how well they agree
    with the product without the others; it ends once the best rows are the same three times.
    """
    turn = 2j * np.pi / n
    waves = [np.exp(turn * b) for b in books]

    def solve(phases) -> tuple[list[int], int]:
        z = np.exp(turn * np.asarray(phases))
        now = [w.mean(0) for w in waves]
        same, last, best = 0, None, [0] * len(waves)
        for step in range(1, rounds + 1):
            for k, w in enumerate(waves):
                rest = z.copy()
                for j, e in enumerate(now):
                    if j != k:
                        rest = rest * np.conj(e)
                agree = (w.conj() @ rest).real
                best[k] = int(np.argmax(agree))
                e = np.maximum(agree, 0) @ w
                now[k] = e / np.maximum(np.abs(e), 1e-12)
            same = same + 1 if best == last else 0
            last = list(best)
            if same >= 3:
                break
        return last, step

    def run(batches):
        for pdf in batches:
            found = [solve(x) for x in pdf["phases"]]
            yield pd.DataFrame({"id": pdf["id"], "factors": [f for f, _ in found], "steps": [s for _, s in found]})

    return products.select("id", "phases").mapInPandas(run, f"id {dict(products.dtypes)['id']}, factors array<int>, steps int")


def concepts(vectors: DataFrame, dim: int, threshold: float = 0.3, least: int = 3, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members (centre, id), candidates (centre, members, coherence, stable)): clusters around leaders.

    In the order of ids, a vector that is in no cluster yet leads one with all that are in none and
    are similar enough, if they are enough. Then, up to three times, members move to a strictly nearer centre and
    centres are bundled anew; a cluster is stable if none of its members moved in the last pass.
    The greedy step runs over connected parts of the similar pairs, each on its own. Equal vectors
    are one row that counts for all of them, by its least id: whatever takes one takes them all.
    """
    from hvspark.sources.tables import checkpointed

    every = vectors.select("id", "hv")
    vectors = checkpointed(every.where(F.size("hv") > 0).groupBy("hv").agg(F.min("id").alias("id"), F.count("*").alias("times")))
    alone = vectors.where(F.col("times") >= 2).select(F.col("id").alias("a"), F.col("id").alias("b")) if threshold < 1 else None
    pairs = similar_pairs(vectors, threshold).select("a", "b")
    pairs = checkpointed(pairs.unionByName(alone) if alone is not None else pairs).join(vectors.select(F.col("id").alias("a"), F.col("times").alias("na")), "a").join(vectors.select(F.col("id").alias("b"), F.col("times").alias("nb")), "b")
    pairs = checkpointed(pairs)
    comp = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    part = pairs.join(comp, pairs["a"] == comp["node"]).groupBy("root").agg(F.collect_list(F.struct("a", "b", "na", "nb")).alias("pairs"))
    kind = dict(vectors.dtypes)["id"]

    def lead(batches):
        for pdf in batches:
            rows = []
            for ps in pdf["pairs"]:
                near: dict = {}
                times: dict = {}
                for p in ps:
                    times |= {p["a"]: p["na"], p["b"]: p["nb"]}
                    near.setdefault(p["a"], set()).add(p["b"])
                    near.setdefault(p["b"], set()).add(p["a"])
                used: set = set()
                for x in sorted(near):
                    if x not in used:
                        group = [x, *(y for y in sorted(near[x] - {x}) if y not in used)]
                        if sum(times[y] for y in group) >= least:
                            used.update(group)
                            rows += [(x, y) for y in group]
            yield pd.DataFrame(rows, columns=["centre", "id"])

    members = checkpointed(part.select("pairs").mapInPandas(lead, f"centre {kind}, id {kind}"))
    moved = None
    for _ in range(passes):
        centres = checkpointed(bundle(members.join(vectors, "id"), ["centre"], dim, times="times").where(F.size("hv") > 0).select("centre", F.col("hv").alias("c")))
        own = members.join(vectors, "id").withColumnRenamed("centre", "old")
        idx = own.select("id", "old", "hv", F.explode("hv").alias("i")).join(centres.select("centre", "c", F.explode("c").alias("i")), "i").select("id", "old", "hv", "centre", "c").distinct()
        scored = idx.withColumn("s", jaccard(F.col("hv"), F.col("c")))
        rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("s"), (F.col("centre") != F.col("old")).cast("int"), "centre"))
        best = scored.withColumn("_n", rank).where("_n = 1").select("id", F.col("centre").alias("new"), "s")
        both = checkpointed(members.join(best, "id", "left").select(F.coalesce("new", "centre").alias("centre"), "id", F.coalesce(F.col("new") != F.col("centre"), F.lit(False)).alias("moved"), F.coalesce("s", F.lit(0.0)).alias("s")))
        moved = both
        members = both.select("centre", "id")
    total = F.sum("times")
    report = moved.join(vectors.select("id", "times"), "id").groupBy("centre").agg(total.alias("members"), (F.sum(F.col("s") * F.col("times")) / total).alias("coherence"), (~F.bool_or("moved")).alias("stable"))
    whole = members.join(vectors.select("id", "hv"), "id").select("centre", "hv").join(every, "hv").select("centre", "id")
    return whole, report


def train_lists(vectors: DataFrame, dim: int, landmarks: int = 64, clusters: int = 16, rounds: int = 10, seed: int = 42):
    """An inverted-file index: landmarks' similarities projected by their kernel, k-means over them.

    Returns (assign, centres): assign(df) adds ``cluster`` and is a Column of one Arrow pass.
    Landmarks are those of least hash; the k-means runs over all vectors, sums taken where they are.
    """
    chosen = vectors.orderBy(F.xxhash64(F.lit(seed), "id")).limit(landmarks).select("hv").collect()
    base = [set(r["hv"]) for r in chosen]
    sim = lambda x: np.array([len(x & b) / max(1, len(x | b)) for b in base])
    kernel = np.exp(-(1 - np.array([sim(b) for b in base])))
    values, axes = np.linalg.eigh(kernel)
    keep = values > 1e-9
    project = axes[:, keep] / np.sqrt(values[keep])

    def point(hv) -> np.ndarray:
        return np.exp(-(1 - sim(set(hv)))) @ project

    rng = np.random.default_rng(seed)
    points = np.array([point(b) for b in base])
    centres = points[rng.permutation(len(points))[: min(clusters, len(points))]]

    def sums(centres):
        def run(batches):
            for pdf in batches:
                x = np.array([point(h) for h in pdf["hv"]])
                if len(x):
                    at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                    yield pd.DataFrame([(int(c), int((at == c).sum()), x[at == c].sum(0).tolist()) for c in np.unique(at)], columns=["c", "n", "s"])

        return run

    for _ in range(rounds):
        part = vectors.select("hv").mapInPandas(sums(centres), "c int, n bigint, s array<double>")
        new = centres.copy()
        for r in part.select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c").agg(F.sum(F.when(F.col("d") == 0, F.col("n"))).alias("n"), F.collect_list(F.struct("d", "x")).alias("xs")).collect():
            total = np.zeros(centres.shape[1])
            for e in r["xs"]:
                total[e["d"]] += e["x"]
            new[r["c"]] = total / r["n"]
        if np.abs(new - centres).max() < 1e-4:
            break
        centres = new

    def clusters_of(probes: int):
        @F.pandas_udf("array<int>")
        def run(hv: pd.Series) -> pd.Series:
            return pd.Series([((point(h) - centres) ** 2).sum(1).argsort(kind="stable")[:probes].tolist() for h in hv])

        return run

    return clusters_of


def search_lists(queries: DataFrame, vectors: DataFrame, clusters_of, k: int, probes: int = 8) -> DataFrame:
    """The k most similar of the vectors in the nearest clusters, ranked exactly."""
    from hvspark.operators.aggregate import top_per

    lists = vectors.select("id", "hv", F.element_at(clusters_of(1)(F.col("hv")), 1).alias("cluster"))
    q = queries.select("query_id", F.col("hv").alias("_q"), F.explode(clusters_of(probes)(F.col("hv"))).alias("cluster"))
    scored = q.join(lists, "cluster").select("query_id", "id", jaccard(F.col("_q"), F.col("hv")).alias("similarity"))
    return top_per(scored, ["query_id"], k, F.desc("similarity"), F.col("id")).select("query_id", "rank", "id", "similarity")


def subcodes(hv, dim: int, parts: int = 16):
    """A vector's indices by equal ranges of the dimension, for codes of each."""
    size = dim // parts
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.transform(F.filter(hv, lambda x: F.floor(x / size) == p), lambda x: x - p * size))


def density(dim: int) -> float:
    return active(dim) / dim
