"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its runs of N words (a document of fewer words is one run of them all).
Pairs of documents whose sets have a Jaccard similarity of at least THRESHOLD are found in steps:

1. Documents with equal sets form a class, which its first document stands for from here on.
2. BANDS bands of ROWS MinHash values each are hashed; classes that share a band's hash form a
   bucket, of which the least member is the leader. A class is sent to each of its leaders, once:
   this costs as much as there are classes, where sending the pairs would cost their square.
   A leader's group that is larger than GROUP_BYTES or GROUP_ROWS is cut into blocks, and each two
   of its blocks meet in a task of their own, so that no task has to hold a large group.
3. Any two classes of a bucket meet at its leader. They are compared only at the least leader that
   they have in common, MinHash values a few at a time: with m of n values equal and a uniform
   prior, the posterior probability that the similarity reaches the threshold is that of at most m
   successes in n + 1 trials at THRESHOLD; a pair is dropped once that is below TOLERANCE.
4. What remains is verified by the exact sets. Pairs are counted where they are found, and what
   leaves a task is, for each member, a number of links and one pair that connects it. Where only the
   connected groups are asked for, what is connected already isn't compared.

A pair of similarity s is a candidate with a probability of 1 - (1 - s ** ROWS) ** BANDS, 0.984 at
0.5 and 0.998 at 0.55.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import BROADCAST_BYTES, HOT, KEY, broadcast_if_small, checkpointed, keyed, load, row_key, spread_join
from hvspark.llm.tokens import BASE, Tokens, blocks, mix, tokenize, window_hashes

N = 3
THRESHOLD = 0.5
BANDS, ROWS = 64, 4
TOLERANCE = 1e-3
STEP = 32  #: MinHash values compared at a time
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
CELLS = 1 << 20  #: pairs of a group that are compared at once
GROUP_BYTES, GROUP_ROWS = 16 << 20, 4096  #: of a leader's group, beyond which it is cut into blocks
ROWS_OUT = 2048  #: rows handed on at a time
_SIGNED = ["doc_id", "key", "s1", "s2", "size", "bands"]
_SENT = ["leader", "p", "q", "own", "s1", "s2", "members", "leaders", "values", "set"]


def grams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words; of all words where a row has fewer."""
    words = np.diff(t.first)
    if len(t.hash) >= n:
        at = np.flatnonzero(t.row[: len(t.row) - n + 1] == t.row[n - 1 :])
        h, row = window_hashes(t.hash, n)[at], t.row[at]
    else:
        h, row = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = np.array([window_hashes(t.hash[t.first[r] : t.first[r + 1]], words[r])[0] for r in short.tolist()], np.uint64)
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def gram_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of rows: rows that have words, their sets one after the other, offsets, MinHash values (a column a row)."""
    for lo, hi, data, offsets in blocks(column):
        h, row = grams(tokenize(data, offsets), n)
        rows, first = np.unique(row, return_index=True)
        if not len(rows):
            continue
        sets = [np.unique(x) for x in np.split(h, first[1:])]
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flat = np.concatenate(sets)
        low = (flat >> np.uint64(32)).astype(np.uint32)
        mins = np.empty((BANDS * ROWS, len(rows)), np.uint32)
        for k in range(BANDS * ROWS):
            mins[k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], at[:-1])
        yield rows + lo, flat, at, mins


def band_hashes(mins: np.ndarray) -> np.ndarray:
    """Hash of each band, a row a document."""
    out = np.empty((mins.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(mins.shape[1], b, np.uint64)
        for r in range(ROWS):
            h = mix(h * BASE + mins[b * ROWS + r])
        out[:, b] = h
    return out


def _list(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, width, dtype=np.int32)), pa.array(values, kind))


def _signatures(n: int):
    def run(batches):
        for b in batches:
            wordless = np.ones(b.num_rows, np.bool_)
            for rows, flat, at, mins in gram_sets(b.column(2), n):
                wordless[rows] = False
                mixed = mix(flat)
                s1 = np.add.reduceat(mixed, at[:-1])
                s2 = np.bitwise_xor.reduceat(mixed * BASE, at[:-1]) + np.diff(at).astype(np.uint64)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(np.diff(at)), _list(band_hashes(mins).view(np.int64).ravel(), BANDS, pa.int64())],
                    _SIGNED,
                )
            take = pa.array(np.flatnonzero(wordless))
            none = pa.nulls(len(take), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), none, none, none, pa.nulls(len(take), pa.list_(pa.int64()))], _SIGNED)

    return run


def _sets(n: int):
    """(s1, s2, members, leaders, text) to one row of _SENT for each group that the class is sent to."""

    def run(batches):
        for b in batches:
            for rows, flat, at, mins in gram_sets(b.column(4), n):
                values = np.ascontiguousarray((mins.T >> 16).astype(np.uint16))
                groups, nth = [], []
                s1 = b.column(0).take(pa.array(rows)).to_numpy().view(np.uint64)
                for i, led in enumerate(b.column(3).take(pa.array(rows)).to_pylist()):
                    for x in led:
                        own = int(s1[i] % np.uint64(x["blocks"]))
                        for other in range(x["blocks"]):
                            groups.append((x["leader"], min(own, other), max(own, other), own))
                            nth.append(i)
                for lo in range(0, len(nth), ROWS_OUT):
                    some = nth[lo : lo + ROWS_OUT]
                    leader, p, q, own = zip(*groups[lo : lo + ROWS_OUT])
                    rep = pa.array(rows[some])
                    lists = b.column(3).take(rep)
                    leaders = pa.ListArray.from_arrays(lists.offsets, lists.values.field("leader"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leader, pa.int64()), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(own, pa.int32()), b.column(0).take(rep), b.column(1).take(rep), b.column(2).take(rep), leaders, pa.array([values[i].tobytes() for i in some], pa.binary()), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())],
                        _SENT,
                    )

    return run


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Of n values compared, the matches below which a pair is dropped."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


class Group:
    """The classes that meet at a leader, or those of two blocks of them, p and q."""

    def __init__(self, leader: int, sides: np.ndarray, leaders: list[np.ndarray], values: np.ndarray, sets: list[np.ndarray], threshold: float, tolerance: float):
        self.values, self.threshold, self.needed = values, threshold, least_matches(threshold, tolerance)
        self.sides = sides if len(np.unique(sides)) > 1 else None
        self.sizes = np.array([len(s) for s in sets])
        grams, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mark = np.zeros(len(grams), np.bool_)
        lower = [x[x < leader] for x in leaders]
        self.names, code = np.unique(np.concatenate(lower), return_inverse=True)
        self.first = np.cumsum([0, *(len(x) + 1 for x in lower)])[:-1]  # of each, in code, after a place that stands for no leader
        self.code = np.insert(code, np.cumsum([0, *(len(x) for x in lower)])[:-1], len(self.names))

    def likely(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that stay as MinHash values are compared, STEP at a time."""
        matches = np.zeros(len(i), np.int32)
        for n in range(STEP, BANDS * ROWS + 1, STEP):
            if not len(i):
                break
            matches += (self.values[i, n - STEP : n] == self.values[j, n - STEP : n]).sum(1, dtype=np.int32)
            stay = matches >= self.needed[n]
            i, j, matches = i[stay], j[stay], matches[stay]
        return i, j

    def verified(self, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(j, similarity) of those of js whose exact similarity with i reaches the threshold."""
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        if 2 * len(js) < len(self.sizes):
            size = self.sizes[js]
            ends = np.cumsum(size)
            where = np.repeat(self.at[js] - ends + size, size) + np.arange(ends[-1])
            common = np.add.reduceat(self.mark[self.ids[where]], ends - size, dtype=np.int64)
        else:
            common = np.add.reduceat(self.mark[self.ids], self.at[:-1], dtype=np.int64)[js]
        self.mark[own] = False
        share = common / (self.sizes[i] + self.sizes[js] - common)
        good = share >= self.threshold
        return js[good], share[good]

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, j, similarity), j an array, of all similar pairs for which no lesser leader has both."""
        k = len(self.sizes)
        step = max(1, CELLS // max(k, len(self.code)))
        ends = np.append(self.first[1:], len(self.code))
        for lo in range(0, k, step):
            own = np.arange(lo, min(k, lo + step))
            here = own[:, None] < np.arange(k)[None, :]
            if self.sides is not None:
                here &= self.sides[own, None] != self.sides[None, :]
            if len(self.names):
                mark = np.zeros((len(own), len(self.names) + 1), np.bool_)
                mark[np.repeat(own - lo, (ends - self.first)[own]), self.code[self.first[lo] : ends[own[-1]]]] = True
                mark[:, -1] = False
                here &= ~np.logical_or.reduceat(mark[:, self.code], self.first, axis=1)
            i, j = np.nonzero(here)
            i, j = self.likely(own[i], j)
            cut = np.flatnonzero(np.diff(i)) + 1
            for js, one in zip(np.split(j, cut), i[np.concatenate([[0], cut])].tolist() if len(i) else []):
                js, share = self.verified(one, js)
                if len(js):
                    yield one, js, share

    def tree(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As many of the similar pairs, in the same form, as connect what all of them connect.

        What was found to be connected isn't compared with each other, only with the rest.
        """
        free = np.ones(len(self.sizes), np.bool_)
        for start in range(len(free)):
            queue = [start] if free[start] else []
            free[start] = False
            while queue:
                i = queue.pop()
                js = np.flatnonzero(free)
                if self.sides is not None:
                    js = js[self.sides[js] != self.sides[i]]
                js = self.likely(np.full(len(js), i), js)[1]
                if len(js):
                    js, share = self.verified(i, js)
                    free[js] = False
                    queue.extend(js.tolist())
                    yield i, js, share


def _joined(label: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Those of js that i connects with what wasn't connected before; label: of each one's group so far, changed in place."""
    names, first = np.unique(np.append(label[i], label[js]), return_index=True)
    if len(names) < 2:
        return js[:0]
    out = js[first[first > 0] - 1]
    if len(names) == 2:
        label[label == names[1]] = names[0]
    else:
        label[np.isin(label, names)] = names[0]
    return out


def _verify(threshold: float, tolerance: float, mode: str):
    def group(t: pa.Table) -> pa.RecordBatch | None:
        ids = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], 1)
        once = np.unique(ids, axis=0, return_index=True)[1]  # a row that repeats comes as often
        if len(once) < 2:
            return None
        t, ids = t.take(pa.array(once)), ids[once]
        values = np.stack([np.frombuffer(x, np.uint16) for x in t["values"].to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        leaders = [np.array(x, np.int64) for x in t["leaders"].to_pylist()]
        members = t["members"].to_numpy()
        g = Group(t["leader"][0].as_py(), t["own"].to_numpy(), leaders, values, sets, threshold, tolerance)
        a, b, shares = [], [], []
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, js, share in g.tree() if mode == "tree" else g.pairs():
            if mode == "links":
                links[i] += members[js].sum()
                links[js] += members[i]
                js = _joined(label, i, js)
            a.append(np.full(len(js), i))
            b.append(js)
            if mode == "pairs":
                shares.append(share)
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        linked = np.flatnonzero(links)
        rest = pa.nulls(len(linked), pa.int64())
        column = lambda x, more: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(more, pa.int64())])
        jaccard = np.concatenate(shares) if mode == "pairs" else np.full(len(a), np.nan)
        return pa.RecordBatch.from_arrays(
            [column(ids[a, 0], ids[linked, 0]), column(ids[a, 1], ids[linked, 1]), column(ids[b, 0], rest), column(ids[b, 1], rest), column(np.zeros(len(a)), links[linked]), pa.concat_arrays([pa.array(jaccard), pa.nulls(len(linked), pa.float64())])],
            ["a1", "a2", "b1", "b2", "links", "jaccard"],
        )

    def run(batches):
        held: list[pa.Table] = []
        last = None
        for b in batches:  # sorted by leader and blocks; a group may go on in the next batch
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cut, cut[1:]):
                if held and last != tuple(at[lo]):
                    if (out := group(pa.concat_tables(held))) is not None:
                        yield out
                    held = []
                last = tuple(at[lo])
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        if held and (out := group(pa.concat_tables(held))) is not None:
            yield out

    return run


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, s1, s2, size, bands) of all rows; s1 and s2 hash the set, null where there are no words."""
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key("doc_id", "text").alias("key"), "text")
    return checkpointed(rows.mapInArrow(_signatures(n), f"doc_id bigint, key {KEY}, s1 bigint, s2 bigint, size bigint, bands array<bigint>"))


def classes_of(signed: DataFrame) -> DataFrame:
    """(s1, s2, members, first): classes of equal sets, and of each the first document, by doc_id and key."""
    worded = signed.where("s1 is not null")
    return checkpointed(worded.groupBy("s1", "s2").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "key")).alias("first")))


def meetings(signed: DataFrame, hot: int = HOT) -> DataFrame:
    """(s1, leaders): the leaders of each class's buckets, each with the number of blocks that its group is cut into."""
    bands = signed.where("s1 is not null").select("s1", "size", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("s1").alias("leader"), F.max("s1").alias("most"), F.count("*").alias("n")).where("leader < most").drop("most")
    led = checkpointed(spread_join(bands, checkpointed(buckets), "band", "n", hot, 32).groupBy("s1").agg(F.max("size").alias("size"), F.collect_set("leader").alias("leaders")))
    each = led.select("s1", "size", F.explode("leaders").alias("leader"))
    blocks = F.ceil(F.greatest(F.sum("size") * 8 / GROUP_BYTES, F.count("*") / GROUP_ROWS)).cast("int")
    large = checkpointed(each.groupBy("leader").agg(blocks.alias("blocks"), F.count("*").alias("n")).where("blocks > 1"))
    plain = F.transform("leaders", lambda x: F.struct(x.alias("leader"), F.lit(1).alias("blocks")))
    if large.isEmpty():
        return led.select("s1", plain.alias("leaders"))
    cut = spread_join(each, large, "leader", "n", hot, 32).groupBy("s1").agg(F.collect_list(F.struct("leader", "blocks")).alias("cut"))
    rest = F.filter(plain, lambda x: ~F.exists("cut", lambda y: y.leader == x.leader))
    return led.join(cut, "s1", "left").select("s1", F.when(F.col("cut").isNull(), plain).otherwise(F.concat(rest, "cut")).alias("leaders"))


def similar(docs: DataFrame, classes: DataFrame, signed: DataFrame, n: int, threshold: float, tolerance: float, mode: str) -> DataFrame:
    """(a1, a2, b1, b2, links, jaccard) of classes, named by s1 and s2.

    mode ``pairs``: all similar pairs. ``tree``: pairs that connect what all of them connect.
    ``links``: such pairs, and rows without b that hold parts of a's number of similar documents.
    """
    met = meetings(signed)
    wanted = classes.join(met, "s1").select(F.col("first.key").alias("_key"), "s1", "s2", "members", "leaders")
    wanted = checkpointed(wanted)
    size = wanted.agg(F.sum(F.size("leaders") * 24 + 80)).first()[0] or 0
    texts = docs.select(row_key("doc_id", "text").alias("_key"), "text")
    found = texts.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "_key").select("s1", "s2", "members", "leaders", "text")
    kinds = "leader bigint, p int, q int, own int, s1 bigint, s2 bigint, members bigint, leaders array<bigint>, values binary, set binary"
    sent = found.mapInArrow(_sets(n), kinds).repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q", "s1")
    return sent.mapInArrow(_verify(threshold, tolerance, mode), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, links bigint, jaccard double")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_a, doc_b, jaccard): similar pairs of the first documents of classes of equal sets; doc_a the lesser one.

    What holds for these holds for all members of their classes. Otherwise as ``jaccard_join``.
    """
    signed = signatures(docs, n)
    classes = classes_of(signed)
    first = classes.select("s1", "s2", "first.doc_id")
    of = lambda x: first.withColumnsRenamed({"s1": f"{x}1", "s2": f"{x}2", "doc_id": f"doc_{x}"})
    pairs = similar(docs, classes, signed, n, threshold, tolerance, "pairs").join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"])
    a, b = F.col("doc_a"), F.col("doc_b")
    swap = b.isNull() | (a > b)
    return pairs.select(F.when(swap, b).otherwise(a).alias("doc_a"), F.when(swap, a).otherwise(b).alias("doc_b"), "jaccard")


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, root) of the nodes of edges (u, v): the least node that each is connected to.

    Large and small stars by turns, until nothing changes; a number of rounds that grows with the
    logarithm of the longest chain. The least neighbour of a node is a sum taken before the shuffle,
    and nodes of many edges are joined with it by broadcast, so that no task has to take them all.
    """

    def least(rows: DataFrame) -> DataFrame:
        table = checkpointed(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        return spread_join(rows, table, "u", "n", hot, 80).drop("n")

    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        down = least(checkpointed(large.where("u > v").distinct()))
        now = checkpointed(down.select("u", F.col("m").alias("v")).unionByName(down.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(state)


def _headed(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s1, s2, head): of each class that edges connect with others, the first document of them all."""
    name = lambda x: F.struct(F.col(f"{x}1").alias("a"), F.col(f"{x}2").alias("b"))
    found = components(edges.select(name("a").alias("u"), name("b").alias("v")))
    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    whole = found.unionByName(roots).select(F.col("node.a").alias("s1"), F.col("node.b").alias("s2"), "root")
    whole = checkpointed(whole.join(classes, ["s1", "s2"]).select("s1", "s2", "root", "first"))
    heads = checkpointed(whole.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n")))
    return spread_join(whole.select("s1", "s2", "root"), heads, "root", "n").select("s1", "s2", "head")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, links): a row for each row of docs.

    links: how many other rows are similar to it, equal ones among them. class_id: the least doc_id
    of all that chains of similar pairs connect it with. So the result grows with the documents, and
    no link is left out; ``jaccard_pairs`` lists the pairs themselves.

    Null and empty texts, and texts without words, are like nothing: a class of their own, without
    links. A null doc_id counts as the least. Rows that repeat are rows of their own, with links
    between them. Other columns don't matter. Very long texts, and groups of any size, are compared whole.
    """
    signed = signatures(docs, n)
    classes = classes_of(signed)
    found = checkpointed(similar(docs, classes, signed, n, threshold, tolerance, "links"))
    sums = found.where("b1 is null").groupBy(F.col("a1").alias("s1"), F.col("a2").alias("s2")).agg(F.sum("links").alias("links"))
    heads = _headed(classes, found.where("b1 is not null"))
    head = F.when(F.col("head").isNull(), F.col("first")).otherwise(F.col("head"))
    known = classes.join(sums, ["s1", "s2"], "left").join(heads, ["s1", "s2"], "left")
    known = checkpointed(known.select(F.struct("s1", "s2").alias("c"), "members", head.getField("doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links")))
    worded = signed.where("s1 is not null").select("doc_id", F.struct("s1", "s2").alias("c"))
    wordless = signed.where("s1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return spread_join(worded, known, "c", "members").select("doc_id", "class_id", "links").unionByName(wordless)


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs without all but the first, by doc_id, of each group that chains of similar pairs connect.

    Rows that repeat id and text become one. Null, empty and wordless texts all stay. A null doc_id
    counts as the least. Other columns stay as they are, whatever their names.
    """
    signed = signatures(docs, n)
    classes = classes_of(signed)
    edges = checkpointed(similar(docs, classes, signed, n, threshold, tolerance, "tree"))
    later = _headed(classes, edges).join(classes, ["s1", "s2"]).where("not (first <=> head)").select("s1", "s2", F.lit(True).alias("later"))
    known = checkpointed(classes.join(later, ["s1", "s2"], "left").where("later or members > 1").select(F.struct("s1", "s2").alias("c"), "members", "first", "later"))
    worded = signed.where("s1 is not null").select("doc_id", "key", F.struct("s1", "s2").alias("c"))
    copies = checkpointed(spread_join(worded, known, "c", "members"))
    gone = copies.where("later or not (first.key = key)").select("key").distinct()
    repeated = checkpointed(copies.where("first.key = key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = keyed(docs).join(broadcast_if_small(gone, 32), "key", "left_anti")
    if repeated.isEmpty():
        return rows.select("row.*")
    again = broadcast_if_small(repeated, 32)
    one = rows.join(again, "key").groupBy("key").agg(F.first("row").alias("row"))
    return rows.join(again, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES = {
    "op4_jaccard_join": f"""
with recursive words as (
  select doc_id, {WORDS_SQL} as w from documents where text is not null
), sets as (
  select doc_id, case when len(w) >= 3
      then list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
      else [array_to_string(w, ' ')] end as g
  from words where len(w) > 0
), firsts as (
  select g, min(doc_id) as first, count(*) as members from sets group by g
), items as (
  select first, members, len(g) as size, unnest(g) as gram from firsts
), common as (
  select a.first as a, b.first as b, b.members, a.size + b.size as total, count(*) as n
  from items a join items b on a.gram = b.gram and a.first <> b.first
  group by all
), edges as (
  select a, b, members from common where n / (total - n) >= 0.5
), reach(first, seen) as (
  select first, first from firsts union select r.first, e.b from reach r join edges e on r.seen = e.a
), classes as (
  select f.g, f.members - 1 + coalesce((select sum(e.members) from edges e where e.a = f.first), 0) as links, (select min(r.seen) from reach r where r.first = f.first) as class_id
  from firsts f
)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, cast(coalesce(links, 0) as bigint) as links
from documents d left join sets using (doc_id) left join classes using (g)
"""
}
