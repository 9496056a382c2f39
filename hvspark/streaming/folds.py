"""Stateful operators over ordered events, as batch folds and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from hvspark.functions.hashing import _U, mixed, seeded

STORE, STRENGTHEN = 1, 2
EVERY, NUM, DEN = 16, 7, 8  #: of the decay: after so many strengthening reads, by NUM / DEN


def name_seed(name: str) -> int:
    h, mask = 0xCBF29CE484222325, (1 << 64) - 1
    data = name.encode()
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & mask
    return int(mixed(h, len(data)))


class PlasticField:
    """A field of integers that facts add to; a read of a fact that is present strengthens it, and now and then all decays."""

    def __init__(self, dim: int, rate: int = 256):
        self.dim, self.rate, self.field, self.reads = dim, rate, np.zeros(dim, np.int64), 0
        self.edges: dict[tuple[str, str, str], np.ndarray] = {}

    def edge(self, s: str, r: str, o: str) -> np.ndarray:
        """A fact's indices; those of the last 1024 facts are remembered."""
        if (s, r, o) not in self.edges:
            if len(self.edges) >= 1024:
                self.edges.clear()
            self.edges[s, r, o] = self._edge(s, r, o)
        return self.edges[s, r, o]

    def _edge(self, s: str, r: str, o: str) -> np.ndarray:
        seed = name_seed(r)
        masks = [int(mixed(seed, x)) % self.dim | 1 for x in (0x5B1EC7, 0x0B1EC7)]
        ends = seeded(np.array([name_seed(s), name_seed(o)], _U), self.dim, self.rate)
        return np.unique(np.concatenate([e[e >= 0] ^ m for e, m in zip(ends, masks)])) % self.dim

    def score(self, at: np.ndarray) -> float:
        return float(self.field[at].mean() - self.field.mean()) if len(at) else 0.0

    def present(self, at: np.ndarray) -> bool:
        """Exactly: the mean on the edge exceeds the field's by half of a store at least."""
        if not len(at):
            return False
        return 2 * (int(self.field[at].sum()) * self.dim - int(self.field.sum()) * len(at)) >= STORE * len(at) * self.dim

    def apply(self, op: str, s: str, r: str, o: str) -> float:
        """The score that the event finds."""
        at = self.edge(s, r, o)
        found = self.score(at)
        if op == "store":
            self.field[at] += STORE
        elif op == "query" and self.present(at):
            self.field[at] += STRENGTHEN
            self.reads += 1
            if self.reads == EVERY:
                self.reads = 0
                v = self.field * NUM
                self.field = np.sign(v) * (np.abs(v) // DEN)
        return found


def plastic_fold(events: DataFrame, key: str, dim: int = 4096) -> DataFrame:
    """(key, seq, score) of each event (key, seq, op, s, r, o), each key's events in the order of seq on a field of its own."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        field = PlasticField(dim)
        pdf = pdf.sort_values("seq", kind="stable")
        return pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "score": [field.apply(e.op, e.s, e.r, e.o) for e in pdf.itertuples()]})

    return events.groupBy(key).applyInPandas(fold, f"{key} {dict(events.dtypes)[key]}, seq bigint, score double")


def plastic_stream(events: DataFrame, key: str, dim: int = 4096) -> DataFrame:
    """The same over a stream, the field kept as state; within a micro-batch events are ordered by seq."""

    def update(k, frames: Iterator[pd.DataFrame], state):
        field = PlasticField(dim)
        if state.exists:
            data, field.reads = state.get
            field.field = np.frombuffer(data, np.int64).copy()
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        scores = [field.apply(e.op, e.s, e.r, e.o) for e in pdf.itertuples()]
        state.update((field.field.tobytes(), field.reads))
        yield pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "score": scores})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, seq bigint, score double", "field binary, reads int", "append", GroupStateTimeout.NoTimeout)


class TwoStores:
    """A fast store that is consolidated into a slow one every so many additions."""

    def __init__(self, dim: int, every: int = 50, resonance: float = 0.3, reinforce: float = 0.5, capacity: int = 200):
        self.dim, self.every, self.resonance, self.reinforce, self.capacity = dim, every, resonance, reinforce, capacity
        self.fast: list[list[int]] = []
        self.slow: list[list[int]] = []
        self.slow_whole: set[int] | None = None  #: what is in any of the slow store's items
        self.added = 0

    def _held(self, item: list[int], whole: set[int] | None) -> float | None:
        if whole is None:
            return None
        rho = len(whole) / self.dim
        share = len(whole.intersection(item)) / len(item) if item else 1.0
        return 0.0 if rho >= 1 else max(0.0, (share - rho) / (1 - rho))

    def add(self, item: list[int]) -> None:
        self.fast.append(item)
        self.added += 1
        if self.added % self.every == 0:
            fast, stay, move = self.fast, [], []
            fresh = set().union(*fast)
            for x in fast:
                old, new = self._held(x, self.slow_whole), self._held(x, fresh)
                (move if old is None or old > self.resonance or (new or 0.0) > self.reinforce else stay).append(x)
            self.slow += move
            if move:
                self.slow_whole = (self.slow_whole or set()).union(*move)
            self.fast = stay[max(0, len(stay) - self.capacity) :]

    def query(self, item: list[int]) -> float:
        return max(self._held(item, set().union(*self.fast) if self.fast else None) or 0.0, self._held(item, self.slow_whole) or 0.0)


def consolidate(items: DataFrame, key: str, dim: int, **options) -> DataFrame:
    """(key, fast, slow): how many of a key's items (key, seq, hv) each store holds in the end."""

    columns = [key, "fast", "slow"]

    def fold(batches):
        now = memory = None
        for pdf in batches:
            rows = []
            for k, hv in zip(pdf[key], pdf["hv"]):
                if memory is None or k != now and not (k != k and now != now):
                    if memory is not None:
                        rows.append((now, len(memory.fast), len(memory.slow)))
                    now, memory = k, TwoStores(dim, **options)
                memory.add(hv.tolist())
            yield pd.DataFrame(rows, columns=columns)
        if memory is not None:
            yield pd.DataFrame([(now, len(memory.fast), len(memory.slow))], columns=columns)

    # in one pass over sorted rows, as a frame for each key costs more than its fold
    ordered = items.select(key, "seq", "hv").repartition(key).sortWithinPartitions(key, "seq").select(key, "hv")
    return ordered.mapInPandas(fold, f"{key} {dict(items.dtypes)[key]}, fast int, slow int")


def sliding_union(items: DataFrame, key: str, size: int) -> DataFrame:
    """items (key, seq, hv) with ``window``: what is in any of the last ``size``."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(1 - size, 0)
    return items.withColumn("window", F.array_sort(F.array_distinct(F.flatten(F.collect_list("hv").over(w)))))


def decayed_counts(items: DataFrame, key: str, factor: float, interval: int) -> DataFrame:
    """(key, idx, weight): counts of indices, each a factor less for every interval since."""
    last = items.groupBy(key).agg(F.max("seq").alias("last"))
    age = F.floor((F.col("last") - F.col("seq")) / interval)
    return items.join(last, key).select(key, F.pow(F.lit(factor), age).alias("w"), F.explode("hv").alias("idx")).groupBy(key, "idx").agg(F.sum("w").alias("weight"))


def spread(items: DataFrame, key: str, bundles: int) -> DataFrame:
    """(key, bundle, members, hv): items dealt to several unions by turns."""
    from hvspark.operators.aggregate import union

    nth = F.row_number().over(W.partitionBy(key).orderBy("seq")) - 1
    return union(items.withColumn("bundle", F.pmod(nth, F.lit(bundles))), [key, "bundle"])


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window of event time, for batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).start.alias("start"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reservoir(items: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of so many items of each key, by the order of a seeded hash, so that a run repeats."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), key, "seq"), "seq"))
    return items.withColumn("_n", rank).where(F.col("_n") <= size).drop("_n")


def tiered(items: DataFrame, key: str, recent: int) -> DataFrame:
    """(key, tier, hv): the union of a key's last items, tier 1, and of those before, tier 2, whose score counts half."""
    from hvspark.operators.aggregate import union

    age = F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))
    return union(items.withColumn("tier", F.when(age <= recent, 1).otherwise(2)), [key, "tier"]).drop("members")


def cascade(items: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, bundle, members, hv): a new union after every so many items."""
    from hvspark.operators.aggregate import union

    nth = F.row_number().over(W.partitionBy(key).orderBy("seq")) - 1
    return union(items.withColumn("bundle", F.floor(nth / capacity).cast("int")), [key, "bundle"])


def read_outs(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, total, logged, cosine, rare): other ways to read counts at a probe's indices.

    Their sum, the sum of ln(1 + n), the cosine between the probe and the counts, and the sum of
    ln(1 + N / n) with N vectors stored.
    """
    counts = stored.select(F.explode("hv").alias("idx")).groupBy("idx").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")).crossJoin(stored.agg(F.count("*").alias("stored")))
    hits = probes.select("id", F.size("hv").alias("k"), F.explode("hv").alias("idx")).join(counts, "idx").crossJoin(F.broadcast(whole))
    return hits.groupBy("id").agg(
        F.sum("n").alias("total"),
        F.sum(F.log1p("n")).alias("logged"),
        (F.sum("n") / (F.sqrt(F.max("k")) * F.max("norm"))).alias("cosine"),
        F.sum(F.log1p(F.col("stored") / F.col("n"))).alias("rare"),
    )
