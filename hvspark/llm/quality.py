"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are UTF-8 bytes, ORDER of them at most, a text preceded by zeros: so a model needs no word
list, holds for every language, and the distinct n-grams, unlike those of words, don't outgrow the
text. Trusted are all documents that ``labels`` gives quality 1, toxic or not: quality
is what the labels say of it.

Training counts the n-grams of all trusted documents, sums the counts by n-gram across the cluster,
and joins each order's table with those of its contexts and of the next lower order.
Documents are dealt to blocks by a hash. The distinct n-grams of each block are joined, n-gram by
n-gram, with the model, whose shards thus never have to be in one place, and what was found goes
back to the block, where its documents are scored.

A text is likelier under a model that has seen it, so one in HOLD_OUT of the trusted documents, by
a hash, sets the thresholds only. A document is kept if its perplexity is at most the QUANTILE of
these in its language; in a language without any, of all of them. The few bytes of a
short text say little, so LEEWAY bytes at the average of these are counted with each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import checkpointed, load, parts_of
from hvspark.llm.tokens import blocks

ORDER = 5  #: bytes; at most 7, so that an n-gram fits into 64 bits
QUANTILE = 0.99
HOLD_OUT = 5
LEEWAY = 64
BLOCK_BYTES = 24 << 20  #: of documents, as stored, a block
BROADCAST_BYTES = 32 << 20  #: of the ids of trusted documents, up to which these are broadcast
_GRAMS = "ord int, gram bigint"


def ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte, zeros standing before the first of each row."""
    n = len(data)
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint64)
    for k in range(1, ORDER):
        before = np.zeros(n, np.uint64)
        before[k:] = data[: max(0, n - k)]
        before[inside < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def _counts(batches):
    for b in batches:
        parts = [np.unique(ngrams(data, offsets), return_counts=True) for _, _, data, offsets in blocks(b.column(0)) if len(data)]
        if parts:
            grams, of = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(of, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents of quality 1; marked for broadcast only if their number allows it."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint")).distinct()
    return F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Those of counts 1, 2, and 3 or more; halves where the counts of counts give none."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(texts: DataFrame) -> DataFrame:
    """(ord, gram, p, back): probability of each n-gram's last byte after the others, and weight that is left to shorter contexts after the n-gram as a context.

    texts: a column ``text``. Probabilities are null for n-grams that are only contexts.
    """
    counts = {ORDER: checkpointed(texts.select("text").mapInArrow(_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):  # continuations: how many bytes it follows
        counts[k] = checkpointed(counts[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    exact = lambda i: F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}")
    tables = [counts[k].withColumn("ord", F.lit(k)) for k in counts]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    seen = {r["ord"]: tuple(r[f"n{i}"] for i in (1, 2, 3, 4)) for r in every.groupBy("ord").agg(*map(exact, (1, 2, 3, 4))).collect()}
    lower: DataFrame | None = None
    out: DataFrame | None = None
    for k in range(1, ORDER + 1):
        d = discounts(*seen.get(k, (0, 0, 0, 0)))
        n = F.col("n")
        cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        t = counts[k].withColumns({"context": F.shiftright("gram", 8), "suffix": F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1), "cut": cut})
        contexts = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spent")).select("context", "total", (F.col("spent") / F.col("total")).alias("back"))
        t = t.join(contexts, "context")
        below = F.lit(1 / 256) if lower is None else F.col("below")
        if lower is not None:
            t = t.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = checkpointed(t.select("gram", ((n - F.col("cut")) / F.col("total") + F.col("back") * below).alias("p")))
        rows = lower.select(F.lit(k).alias("ord"), "gram", "p", F.lit(None).cast("double").alias("back"))
        rows = rows.unionByName(contexts.select(F.lit(k - 1).alias("ord"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "back"))
        out = rows if out is None else out.unionByName(rows)
    return checkpointed(out.groupBy("ord", "gram").agg(F.max("p").alias("p"), F.max("back").alias("back")))


def _wanted(batches):
    """The distinct n-grams of each block, of all orders."""
    found: dict[int, list[np.ndarray]] = {}
    for b in batches:
        at = b.column(0).to_numpy()
        for block in np.unique(at).tolist():
            for _, _, data, offsets in blocks(b.column(1).filter(pa.array(at == block))):
                if len(data):
                    parts = found.setdefault(block, [])
                    parts.append(np.unique(ngrams(data, offsets)))
                    if len(parts) > 16:
                        found[block] = [np.unique(np.concatenate(parts))]
    for block, parts in found.items():
        grams = np.unique(np.concatenate(parts))
        for k in range(ORDER, -1, -1):
            own = np.unique(grams & np.uint64((1 << 8 * k) - 1))
            if 0 < k < ORDER:
                own = np.unique(np.concatenate([own, np.unique(grams >> np.uint64(8 * (ORDER - k)))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int32)), pa.array(np.full(len(own), k, np.int32)), pa.array(own.view(np.int64))], ["block", "ord", "gram"])


class Answers:
    """What the model says on a block's n-grams."""

    def __init__(self, order: np.ndarray, gram: np.ndarray, p: np.ndarray, back: np.ndarray):
        self.by_order = []
        for k in range(ORDER + 1):
            own = np.flatnonzero(order == k)
            own = own[np.argsort(gram[own])]
            self.by_order.append((gram[own].view(np.uint64), p[own], back[own]))

    def _find(self, k: int, grams: np.ndarray, which: int) -> np.ndarray:
        known = self.by_order[k][0]
        if not len(known):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[at] == grams, self.by_order[k][which][at], np.nan)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each ORDER-gram."""
        out = np.empty(len(grams))
        left, weight = np.arange(len(grams)), np.ones(len(grams))
        for k in range(ORDER, -1, -1):
            g = grams[left] & np.uint64((1 << 8 * k) - 1)
            p = self._find(k, g, 1) if k else np.full(len(g), 1 / 256)
            hit = ~np.isnan(p)
            out[left[hit]] = weight[hit] * p[hit]
            left, weight, g = left[~hit], weight[~hit], g[~hit]
            if not len(left):
                break
            back = self._find(k - 1, g >> np.uint64(8), 2)
            weight = weight * np.where(np.isnan(back), 1.0, back)
        return out


def _score(docs: pa.Table, said: pa.Table) -> pa.Table:
    known = Answers(*(said[c].to_numpy() for c in ("ord", "gram", "p", "back")))
    bits, size = [], []
    for _, _, data, offsets in blocks(docs["text"]):
        grams, of = np.unique(ngrams(data, offsets), return_inverse=True)
        each = -np.log2(known.probability(grams))[of] if len(grams) else np.empty(0)
        total = np.concatenate([[0.0], np.cumsum(each)])
        bits.append(total[offsets[1:]] - total[offsets[:-1]])
        size.append(np.diff(offsets))
    none = np.empty(0)
    return pa.table({"doc_id": docs["doc_id"], "lang": docs["lang"], "bytes": pa.array(np.concatenate([*size, none]).astype(np.int64)), "bits": pa.array(np.concatenate([*bits, none]))})


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, bytes, bits) for each row of docs; null and empty texts have 0 of both."""
    n = parts_of(docs, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    dealt = docs.select(block.alias("block"), "text", F.col("doc_id").cast("bigint").alias("doc_id"), "lang").repartitionById(n, "block")
    wanted = dealt.mapInArrow(_wanted_of, f"block int, {_GRAMS}")
    said = wanted.join(model, ["ord", "gram"]).select("block", "ord", "gram", "p", "back").repartitionById(n, "block")
    return dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_score, "doc_id bigint, lang string, bytes bigint, bits double")


def _wanted_of(batches):
    return _wanted(b.select(["block", "text"]) for b in batches)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, bytes, perplexity, threshold, keep) for each row of docs.

    perplexity is per byte, LEEWAY included. Null and empty texts have none and aren't kept. If no
    document is trusted there are no thresholds, and all others are kept. A null doc_id is never
    trusted; a null language is a language of its own; rows that repeat give rows that repeat.
    A document of which labels hold several rows is trusted if one of them says so.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", "lang")
    ids = trusted_ids(labels)
    held = F.pmod(F.xxhash64(F.lit(HOLD_OUT), "doc_id"), F.lit(HOLD_OUT)) == 0
    model = train(docs.join(ids, "doc_id", "left_semi").where(~held))
    scored = checkpointed(score(docs, model))
    trusted = checkpointed(scored.where(held & (F.col("bytes") > 0)).join(ids, "doc_id", "left_semi"))
    mean = trusted.agg(F.sum("bits") / F.sum("bytes")).first()[0]
    own = (F.col("bits") + LEEWAY * (mean or 0.0)) / (F.col("bytes") + LEEWAY)
    at = F.percentile_approx(own, quantile, 10_000)
    overall = trusted.agg(at).first()[0]
    limits = trusted.groupBy("lang").agg(at.alias("limit")).withColumnRenamed("lang", "_lang")
    rows = scored.join(limits, scored["lang"].eqNullSafe(limits["_lang"]), "left")
    limit = F.coalesce(F.col("limit"), F.lit(overall).cast("double"))
    return rows.select(
        "doc_id",
        "lang",
        "bytes",
        F.when(F.col("bytes") > 0, F.pow(F.lit(2.0), own)).alias("perplexity"),
        F.pow(F.lit(2.0), limit).alias("threshold"),
        ((F.col("bytes") > 0) & F.coalesce(own <= limit, F.lit(True))).alias("keep"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
