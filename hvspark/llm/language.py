"""Language ID by cross-parsing entropy.

One suffix automaton per language is built over labelled text. A document is parsed against
each of them from left to right into the longest phrases that occur somewhere in that
language's text; the language that needs the fewest phrases, normalised to bits per byte as
``phrases * log2(size of the labelled text) / bytes``, wins.

Text is normalised first: ASCII and Latin-1 capitals become small, every run of bytes that are
no letters becomes one blank (bytes of non-ASCII characters count as letters).

A greedy parse is a walk through the automaton that goes on from the root where no edge leads
on, so all of it is one table of next states. Documents are cut into segments which advance in
lock-step, one array step for a byte of each; a segment's entry state is guessed from the bytes
before it and checked against its predecessor's exit, and run again if the guess was wrong, so
the counts are exactly those of the sequential parse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.llm.frames import broadcast_if_small, load
from hvspark.llm.tokens import blocks, fold, utf8

SAMPLE_BYTES = 24_000  #: bound on the labelled text per language, in normalised bytes
MAX_BITS = 4.5  #: a document that needs more bits than these for each byte in every language is in none of them
LEEWAY = 32  #: bytes that are added to each document's size for that, as short ones say little
SEGMENT, WARM_UP = 2048, 128
BLOCK = 4 << 20  #: bytes parsed at a time
STARTS = np.uint32(1 << 31)
_LETTER = np.zeros(256, np.bool_)
_LETTER[128:] = True
_LETTER[97:123] = True


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of each row, and their offsets; a row without letters has none."""
    low = fold(data)
    low[~_LETTER[low]] = 32
    blank = low == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a letter
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads] = ~blank[heads]
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """The transitions of the suffix automaton, -1 where there is none; symbols are 1 .. width - 1."""
    edges: list[list[int]] = [[-1] * width]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(edges)
        edges.append([-1] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and edges[p][c] < 0:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(edges[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and edges[p][c] == q:
                    edges[p][c] = twin
                    p = link[p]
        last = new
    return np.array(edges, np.int32)


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  #: of each byte; 0 for bytes that occur in no labelled text
    width: int
    table: np.ndarray  #: next state times width, with STARTS where a new phrase starts
    root: np.ndarray  #: root of each language
    bits: np.ndarray  #: log2 of the size of each language's text


def fit(texts: dict[str, list[str]]) -> Model:
    """The model of the given texts by language; a language without letters is left out."""
    sets = {}
    for lang in sorted(texts):
        data, at = utf8(pa.array(texts[lang], pa.large_string()))
        data, at = normalise(data[at[0] : at[-1]], at - at[0])
        if len(data):
            sets[lang] = np.concatenate([np.append(data[a:b], 32) for a, b in zip(at, at[1:])]).astype(np.uint8)
    symbol = np.zeros(256, np.uint8)
    used = np.unique(np.concatenate([*sets.values(), np.empty(0, np.uint8)]).astype(np.uint8))
    symbol[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    tables, roots, base = [], [], 0
    for data in sets.values():
        edges = suffix_automaton(symbol[data], width)
        start = np.where(edges[0] >= 0, edges[0], 0)
        step = np.where(edges >= 0, edges, start[None, :]).astype(np.uint32)
        fresh = edges < 0
        fresh[0] = True
        tables.append(((step + np.uint32(base)) * np.uint32(width)) | np.where(fresh, STARTS, np.uint32(0)))
        roots.append(base * width)
        base += len(edges)
    table = np.concatenate(tables).ravel() if tables else np.empty(0, np.uint32)
    return Model(list(sets), symbol, width, table, np.array(roots, np.uint32), np.log2([max(2, len(x)) for x in sets.values()]))


def _walk(model: Model, sym: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that start in each lane, and the state after it; state: one per lane, as given."""
    order = np.argsort(-length, kind="stable")
    at, left, now = start[order], length[order], state[order]
    count = np.zeros(len(order), np.int32)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for n in active.tolist():
        x = model.table[now[:n] + sym[at[:n]]]
        count[:n] += (x >> np.uint32(31)).astype(np.int32)
        now[:n] = x & ~STARTS
        at[:n] += 1
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return count[back], now[back]


def phrases(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each row in each language, over normalised bytes."""
    rows, k = len(offsets) - 1, len(model.languages)
    sym = model.symbol[data]
    pieces = -(-np.diff(offsets) // SEGMENT)
    row = np.repeat(np.arange(rows), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[row] + nth * SEGMENT
    length = np.minimum(start + SEGMENT, offsets[row + 1]) - start
    out = np.zeros((rows, k), np.int64)
    if not len(row) or not k:
        return out
    lane_start, lane_length, lane_nth = np.tile(start, k), np.tile(length, k), np.tile(nth, k)
    entry = np.repeat(model.root, len(row))
    warm = np.flatnonzero(lane_nth > 0)
    if len(warm):
        entry[warm] = _walk(model, sym, lane_start[warm] - WARM_UP, np.full(len(warm), WARM_UP), entry[warm])[1]
    count, leave = _walk(model, sym, lane_start, lane_length, entry)
    while len(wrong := warm[leave[warm - 1] != entry[warm]]):
        entry[wrong] = leave[wrong - 1]
        count[wrong], leave[wrong] = _walk(model, sym, lane_start[wrong], lane_length[wrong], entry[wrong])
    for j in range(k):
        out[:, j] = np.bincount(row, count[j * len(row) : (j + 1) * len(row)], rows)
    return out


def labelled_texts(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Per language, labelled texts in the order of a hash until they fill the bound.

    Texts of at most an eighth of the bound come first, and whole; of longer ones a stretch of that
    size from the first letter on follows, so that no single one dominates.
    """
    most = max(1, sample_bytes // 8)
    letter = "[A-Za-z\\x{80}-\\x{10ffff}]"
    rows = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size")).where(F.col("lang").isNotNull() & F.col("text").rlike(letter))
    order = W.partitionBy("lang").orderBy("long", "h")
    wanted = (  # each has a byte at least, so no more rows than bytes are needed; the texts stay where they are
        rows.select("lang", "h", (F.col("size") > most).alias("long"), F.least("size", F.lit(most)).alias("size"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= sample_bytes)
        .withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
        .where(F.col("before") < sample_bytes)
        .groupBy("lang", "h", "long")
        .agg(F.min("nth").alias("nth"))
    )
    short = F.when(F.col("long"), F.substring(F.regexp_replace("text", "^[^A-Za-z\\x{80}-\\x{10ffff}]+", ""), 1, most)).otherwise(F.col("text"))
    rows = (
        rows.join(broadcast_if_small(wanted, 40), ["lang", "h"])
        .where((F.col("size") > most) == F.col("long"))
        .dropDuplicates(["lang", "h", "long"])
        .orderBy("lang", "nth")
        .select("lang", short.alias("text"))
        .toLocalIterator()
    )
    out: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for lang, text in rows:
        if size.get(lang, 0) < sample_bytes:
            text = text.encode()[:most].decode(errors="ignore")
            out.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text.encode())
    return out


def scores(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, bits per byte or NaN, phrases) of each text."""
    parts = [_scores(model, data, at) for _, _, data, at in blocks(column, BLOCK)]
    none = np.empty(0)
    return [x for p in parts for x in p[0]], np.concatenate([*(p[1] for p in parts), none]), np.concatenate([*(p[2] for p in parts), none.astype(np.int64)])


def _scores(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    data, at = normalise(data, at)
    n = phrases(model, data, at)
    size = np.diff(at)
    if not model.languages:
        return ["und"] * len(size), np.full(len(size), np.nan), np.zeros(len(size), np.int64)
    bits = n * model.bits / np.maximum(size, 1)[:, None]
    best = np.argmin(bits, 1)
    rows = np.arange(len(size))
    low = np.where(size > 0, bits[rows, best], np.nan)
    known = (size > 0) & (bits[rows, best] * size <= MAX_BITS * (size + LEEWAY))
    return [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], low, n[rows, best]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, bits, phrases, keep) for each row of docs.

    ``und`` and keep = false: a null or empty text, a text without letters, one that needs more
    than ``MAX_BITS * (bytes + LEEWAY)`` bits in every language, or no labelled text at all. A tie goes to the first
    language by name. Rows that repeat give rows that repeat; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, bits, n = scores(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(bits, from_pandas=True), pa.array(n), pa.array([x != "und" for x in lang])], ["doc_id", "language", "bits", "phrases", "keep"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, language string, bits double, phrases bigint, keep boolean")


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is one of the model's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([x != "und" for x in scores(shared.value, b.column(at))[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(labelled_texts(docs)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return known_language(docs, fit(labelled_texts(docs)))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
