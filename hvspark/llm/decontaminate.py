"""Benchmark decontamination by template canonicalisation.

Words are put into a template: numbers, units after a number and names become typed
placeholders. Windows of WINDOW template words of every document are hash-joined with those of
the benchmark's items; matches on one diagonal (position in the document less position in the
item) make up an alignment, and so do chains of matches whose diagonals differ by up to DRIFT from
one to the next, with at most MAX_GAP words between them: words may be inserted or dropped. What
stands in the placeholders must fit: an item's number or name has to stand for the same thing
wherever it recurs, and two names may not become one. Windows that are equal word for word need no
fit, and count without the others where these don't fit. So a copied question is found, and one
with other numbers and names, too.

All this is done twice: with words as units, and with each run of equal placeholders as one unit, so
that a name or number may be longer in the document.

* number: digits, with . or , between digits, and the cardinals of NUMBER_WORDS
* unit: one of UNITS right after a number
* name: a word with a capital first and a small letter in it, where it doesn't start a sentence,
  or which is found so elsewhere in the text

Each window is hashed twice: as this template, where at least half of it are words proper, and with
names as words, case folded, which finds copies whose case was changed. An item is leaked to a
document if an alignment with consistent slots covers MIN_TOKENS of its words or MIN_COVERAGE of
them, or of its units. An item of fewer than WINDOW words is one window. One of fewer than LEAST words has
no template to speak of: it is leaked where its very words, numbers and all, stand side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.llm.frames import KEY, broadcast_if_small, checkpointed, keyed, load, row_key
from hvspark.llm.tokens import BASE, Tokens, blocks, hash_words, mix, powers, tokenize, window_hashes

WINDOW = 8
LEAST = 5
MIN_TOKENS, MIN_COVERAGE = 13, 0.5
DRIFT, MAX_GAP = 8, 16  #: words, from one match of a chain to the next
BROADCAST_BYTES = 64 << 20  #: of window hashes; with more of them, all windows go into the join
WORD, NUMBER, UNIT, NAME = range(4)
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs ton tons tonne tonnes ml l liter liters litre litres gallon gallons second seconds sec s minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees volt volts watt watts kw kwh joule joules newton newtons hz khz mhz ghz kb mb gb tb mph kmh".split()
_PLACE = hash_words(["xslotnumber", "xslotunit", "xslotname"])
_NUMBERS, _UNITS = (np.sort(hash_words(x)) for x in (NUMBER_WORDS, UNITS))
_DIGIT, _BREAK, _UPPER, _LOWER = (np.zeros(256, np.bool_) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_BREAK[[10, 33, 46, 63]] = True


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h if len(known) else np.zeros(len(h), np.bool_)


@dataclass
class Template:
    tokens: Tokens
    kind: np.ndarray
    full: np.ndarray  #: hash of each word, or of its placeholder
    plain: np.ndarray  #: the same with names as words


def template(data: np.ndarray, offsets: np.ndarray) -> Template:
    digit = _DIGIT[data]
    glued = data
    if len(data) > 2:
        point = np.flatnonzero(((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]) + 1
        if len(point):
            glued = data.copy()
            glued[point] = np.where(data[point] == 46, 0xFE, 0xFF)
            digit[point] = True
    t = tokenize(glued, offsets)
    kind = np.zeros(len(t.hash), np.uint8)
    if len(kind):
        run = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, breaks, smalls = run(digit), run(_BREAK[glued]), run(_LOWER[data])
        follows = np.concatenate([[False], t.row[1:] == t.row[:-1]])
        before = np.concatenate([[0], t.end[:-1]])
        number = (digits[t.end] - digits[t.start] == t.end - t.start) | _among(t.hash, _NUMBERS)
        unit = np.concatenate([[False], number[:-1]]) & follows
        at = np.flatnonzero(unit)
        unit[at] = _among(t.hash[at], _UNITS)
        second = data[np.minimum(t.start + 1, len(data) - 1)]
        capital = _UPPER[data[t.start]] | ((data[t.start] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        capital &= smalls[t.end] > smalls[t.start]
        name = capital & follows & (breaks[t.start] == breaks[before])
        here = mix(t.hash + t.row.astype(np.uint64) * BASE)  # the word in its row
        first = np.flatnonzero(capital & ~name)
        name[first] = _among(here[first], np.unique(here[name]))
        kind[name] = NAME
        kind[unit] = UNIT
        kind[number] = NUMBER
    plain = np.where(kind == NUMBER, _PLACE[0], np.where(kind == UNIT, _PLACE[1], t.hash))
    return Template(t, kind, np.where(kind == NAME, _PLACE[2], plain), plain)


def collapsed(x: Template) -> Template:
    """x with each run of equal placeholders in a row as one unit, whose word is all of the run."""
    t = x.tokens
    if not len(t.hash):
        return x
    head = np.ones(len(t.hash), np.bool_)
    head[1:] = (x.kind[1:] == WORD) | (x.kind[1:] != x.kind[:-1]) | (t.row[1:] != t.row[:-1])
    at = np.flatnonzero(head)
    if len(at) == len(head):
        return x
    last = np.append(at[1:], len(head)) - 1
    up, down = powers(len(head) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t.hash * up[: len(head)])])
    h = np.where(last > at, mix((sums[last + 1] - sums[at]) * down[at]), t.hash[at])
    names = x.kind[at] == NAME
    tokens = Tokens(t.row[at], t.start[at], t.end[last], h, np.searchsorted(at, t.first))
    return Template(tokens, x.kind[at], x.full[at], np.where(names, h, x.plain[at]))


def windows_of(x: Template, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash as a template, hash with names as words) of each window of n words in one row."""
    t = x.tokens
    if len(t.hash) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.flatnonzero(t.row[: len(t.row) - n + 1] == t.row[n - 1 :])
    if n < LEAST:
        exact = window_hashes(t.hash, n)[at] + np.uint64(n)
        return at, exact, exact
    plain = window_hashes(x.plain, n)[at] + np.uint64(n)
    words = np.concatenate([[0], np.cumsum(x.kind == WORD)])
    proper = 2 * (words[at + n] - words[at]) >= n
    return at, np.where(proper, window_hashes(x.full, n)[at] + np.uint64(n), plain), plain


def _raw(t: Tokens, at: np.ndarray, n: int) -> pa.Array:
    flat = t.hash[(at[:, None] + np.arange(n)).ravel()].view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))


def _items(batches):
    for b in batches:
        for lo, _, data, offsets in blocks(b.column(1)):
            words = template(data, offsets)
            for unit, x in enumerate((words, collapsed(words))):
                size = np.diff(x.tokens.first)
                for n in sorted({min(WINDOW, s) for s in size.tolist() if s >= (LEAST if unit else 1)}):
                    at, full, plain = windows_of(x, n)
                    row = x.tokens.row[at]
                    mine = np.flatnonzero(np.minimum(size[row], WINDOW) == n)
                    at, full, plain, row = at[mine], full[mine], plain[mine], row[mine]
                    kinds = x.kind[(at[:, None] + np.arange(n)).ravel()].astype(np.int32)
                    kinds = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kinds) + 1, n, dtype=np.int32)), pa.array(kinds))
                    for h in (full, plain):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), unit, np.int32)), pa.array(h.view(np.int64)), b.column(0).take(pa.array(row + lo)), pa.array((at - x.tokens.first[row]).astype(np.int32)), pa.array(size[row].astype(np.int32)), _raw(x.tokens, at, n), kinds],
                            ["unit", "window", "item_id", "item_pos", "item_size", "item_raw", "kinds"],
                        )


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("bigint"), "text").distinct()
    return rows.mapInArrow(_items, "unit int, window bigint, item_id bigint, item_pos int, item_size int, item_raw array<bigint>, kinds array<int>").dropDuplicates(["unit", "window", "item_id", "item_pos"])


class _Known:
    """Membership of window hashes: a bitmap for most of the answers, the sorted hashes for the rest."""

    def __init__(self, h: np.ndarray):
        self.h = np.sort(h)
        self.bits = np.zeros(1 << 22, np.bool_)
        self.bits[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[(h >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = _among(h[at], self.h)
        return out


def _documents(lengths: list[int], known):
    """known: the broadcast hashes that matter, or None for all of them."""

    def run(batches):
        for b in batches:
            for lo, _, data, offsets in blocks(b.column(2)):
                words = template(data, offsets)
                for unit, x in enumerate((words, collapsed(words))):
                    for n in lengths:
                        if unit and n < LEAST:
                            continue
                        at, full, plain = windows_of(x, n)
                        if n < LEAST:  # one place a text is enough
                            once = np.unique(np.stack([x.tokens.row[at].astype(np.uint64), full]), axis=1, return_index=True)[1] if len(at) else at
                            at, full, plain = at[once], full[once], plain[once]
                        for h, some in ((full, np.ones(len(at), np.bool_)), (plain, plain != full)):
                            hit = np.flatnonzero(some & known.value.of(h) if known else some)
                            if len(hit):
                                row = x.tokens.row[at[hit]]
                                take = pa.array(row + lo)
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(hit), unit, np.int32)), pa.array(h[hit].view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array((at[hit] - x.tokens.first[row]).astype(np.int64)), _raw(x.tokens, at[hit], n)],
                                    ["unit", "window", "doc_id", "key", "pos", "raw"],
                                )

    return run


def chained(places: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains over several diagonals, of (pos, item_pos, n), the one that covers most first.

    Windows that meet on a diagonal are one stretch, and each stretch is in one chain at most.
    """
    stretches: list[list] = []  # pos, item_pos, n, windows
    for pos, item_pos, n in sorted(places, key=lambda x: (x[0] - x[1], x[0])):
        s = stretches[-1] if stretches else None
        if s and s[0] - s[1] == pos - item_pos and pos <= s[0] + s[2]:
            s[2] = max(s[2], pos + n - s[0])
            s[3].append((pos, item_pos, n))
        else:
            stretches.append([pos, item_pos, n, [(pos, item_pos, n)]])
    stretches.sort(key=lambda s: s[:3])
    longest = max(s[2] for s in stretches)
    score, before = [], []
    for i, (pos, item_pos, n, _) in enumerate(stretches):
        top, link = n, -1
        for j in range(i - 1, -1, -1):
            p, q, m, _ = stretches[j]
            if pos - p > longest + MAX_GAP:
                break
            gain = n - max(0, p + m - pos, q + m - item_pos)
            if p < pos and q < item_pos and gain > 0 and max(pos - p - m, item_pos - q - m) <= MAX_GAP and abs(pos - item_pos - p + q) <= DRIFT and score[j] + gain > top:
                top, link = score[j] + gain, j
        score.append(top)
        before.append(link)
    used: set[int] = set()
    out = []
    for i in sorted(range(len(stretches)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain = stretches[i][3] + chain
            i = before[i]
        if len({p - q for p, q, _ in chain}) > 1:
            out.append(chain)
    return out


def best_alignment(item_size: int, hits: list[dict]) -> tuple[int, int, int] | None:
    """(tokens, slots, changed) of the best of a document's alignments with an item that suffice, from its matches in one unit."""
    at: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    for h in hits:
        at[h["pos"], h["item_pos"], len(h["raw"])] = [(k, a, b) for k, a, b in zip(h["kinds"], h["item_raw"], h["raw"]) if k != WORD] if h["item_raw"] != h["raw"] else []
    same = {(h["pos"], h["item_pos"], len(h["raw"])): [(k, a, b) for k, a, b in zip(h["kinds"], h["item_raw"], h["raw"]) if k != WORD] for h in hits if h["item_raw"] == h["raw"]}
    found = []
    for places in (at, same):
        if not places:
            continue
        by_diagonal: dict[int, list[tuple[int, int, int]]] = {}
        for x in places:
            by_diagonal.setdefault(x[0] - x[1], []).append(x)
        for chain in [*by_diagonal.values(), *chained(list(places))]:
            tokens = len({i for _, q, n in chain for i in range(q, q + n)})
            if tokens < MIN_TOKENS and tokens < MIN_COVERAGE * item_size:
                continue
            slots = {x for c in chain for x in (same.get(c) or at[c])}
            names = [x for x in slots if x[0] == NAME]
            if places is at and (len(slots) > len({x[:2] for x in slots}) or len(names) > len({x[2] for x in names})):
                continue
            found.append((-tokens, sum(a != b for _, a, b in slots), min(p - q for p, q, _ in chain), len({x[:2] for x in slots})))
    if not found:
        return None
    tokens, changed, _, slots = min(found)
    return -tokens, slots, changed


def _align(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            best = best_alignment(r["item_size"], r["hits"])
            if best:
                out.append((r["doc_id"], r["key"], r["item_id"], best[0], best[0] / r["item_size"], best[1], best[2], r["unit"]))
        if out:
            kinds = (pa.int64(), pa.struct([("a", pa.int64()), ("b", pa.int64())]), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "key", "item_id", "tokens", "coverage", "slots", "changed", "unit"])


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key, item_id, tokens, coverage, slots, changed) of items leaked to documents.

    tokens and coverage: of the item's words in the best alignment; slots: distinct placeholders
    in it; changed: how many of them stand for something else in the document.

    Null and empty texts, on either side, leak nothing. Rows that repeat give one result; the same
    text under several ids gives one for each. A null doc_id or item_id is kept as an id.
    """
    spark = docs.sparkSession
    items = checkpointed(benchmark_windows(benchmark))
    lengths = sorted(r[0] for r in items.select(F.size("item_raw")).distinct().collect())
    distinct = items.select("window").distinct()
    known = None
    if distinct.count() * 8 <= broadcast_bytes:
        known = spark.sparkContext.broadcast(_Known(distinct.toArrow()["window"].to_numpy().view(np.uint64)))
    rows = docs.select(F.col("doc_id").cast("bigint"), row_key("doc_id", "text").alias("key"), "text")
    hits = rows.mapInArrow(_documents(lengths, known), f"unit int, window bigint, doc_id bigint, key {KEY}, pos bigint, raw array<bigint>")
    aligned = hits.join(items, ["unit", "window"]).groupBy("doc_id", "key", "item_id", "item_size", "unit").agg(F.collect_set(F.struct("pos", "item_pos", "kinds", "item_raw", "raw")).alias("hits"))
    found = aligned.select("doc_id", "key", "item_id", "item_size", "unit", "hits").mapInArrow(_align, f"doc_id bigint, key {KEY}, item_id bigint, tokens int, coverage double, slots int, changed int, unit int")
    best = W.partitionBy("doc_id", "key", "item_id").orderBy(F.desc("tokens"), F.desc("coverage"), "changed", "unit")
    return found.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth", "unit")


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whatever their names, to which no item is leaked.

    Null and empty texts stay, and all rows where the benchmark is empty; rows that repeat stay or go together.
    """
    bad = leaks(docs, benchmark).select("key").distinct()
    return keyed(docs).join(broadcast_if_small(bad, 32), "key", "left_anti").select("row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return uncontaminated(docs, load(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES: dict[str, str] = {}
