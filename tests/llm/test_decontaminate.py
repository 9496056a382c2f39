"""Decontamination against a plain version, on re-parameterised questions, and on odd rows."""

import re

import pytest

from hvspark.llm import decontaminate as D
from tests.llm.conftest import SCHEMA

ITEM = "John has 5 apples and buys 3 more apples from Tom. How many apples does John have now?"


def plain_template(text):
    """(kind, word) of each word, by the definitions in the module's docstring."""
    out, breaks = [], True
    for m in re.finditer(r"\d+(?:[.,]\d+)+|[0-9A-Za-z\x80-\U0010ffff]+|[.!?\n]", text or ""):
        w = m.group()
        if w in ".!?\n":
            breaks = True
            continue
        low = w.lower()
        capital = w[0].isupper() and re.search("[a-z]", w)
        kind = D.WORD
        if w[0].isdigit() and re.fullmatch(r"[\d.,]+", w) or low in D.NUMBER_WORDS:
            kind = D.NUMBER
        elif low in D.UNITS and out and out[-1][0] == D.NUMBER:
            kind = D.UNIT
        elif capital and not breaks:
            kind = D.NAME
        out.append((kind, low, bool(capital)))
        breaks = False
    names = {w for k, w, _ in out if k == D.NAME}
    return [(D.NAME if k == D.WORD and c and w in names else k, w) for k, w, c in out]


def plain_leaks(docs, items):
    out = set()
    for i, text in docs:
        d = plain_template(text)
        for j, item in items:
            t = plain_template(item)
            if len(t) < D.LEAST:
                said, wanted = [w for _, w in d], [w for _, w in t]
                if t and any(said[p : p + len(t)] == wanted for p in range(len(d))):
                    out.add((i, j))
                continue
            n = min(D.WINDOW, len(t))
            for diagonal in range(-len(t) + n, len(d) - n + 1):
                cover, slots = set(), set()
                for p in range(max(0, -diagonal), min(len(t), len(d) - diagonal) - n + 1):
                    a, b = d[p + diagonal : p + diagonal + n], t[p : p + n]
                    full = [x if x[0] == D.WORD else x[0] for x in a] == [x if x[0] == D.WORD else x[0] for x in b]
                    full &= 2 * sum(k == D.WORD for k, _ in b) >= n
                    words = lambda x: [w if k in (D.WORD, D.NAME) else k for k, w in x]
                    if full or words(a) == words(b):
                        cover |= set(range(p, p + n))
                        slots |= {(k, s, e) for (k, s), (_, e) in zip(b, a) if k != D.WORD}
                fits = len(slots) == len({x[:2] for x in slots})
                names = [x for x in slots if x[0] == D.NAME]
                if fits and len(names) == len({x[2] for x in names}) and cover and (len(cover) >= D.MIN_TOKENS or len(cover) / len(t) >= D.MIN_COVERAGE):
                    out.add((i, j))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    import duckdb

    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 900 order by doc_id limit 10").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet' order by item_id limit 8").fetchall()
    items += [(100, ITEM), (101, "What is two plus"), (102, "7 apples"), (103, "zebra")]
    docs += [
        (900, "We asked: Mary has 7 apples and buys 12 more apples from Peter. How many apples does Mary have now? Yes."),
        (901, "so Mary has 7 apples and buys 12 more apples from Peter. How many apples does Anna have now?"),  # John became two people
        (902, "so Ann has 7 apples and buys 3 more apples from Ann. How many apples does Ann have now?"),  # two became one
        (903, ITEM.upper()),
        (904, "five apples, three pears"),
        (906, "Now: what is two plus three? What is TWO plus two"),
        (907, "what is three plus"),
        (905, f"{items[3][1]} and {items[7][1]}"),
    ]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_the_plain_version(spark, frames, limit):
    docs, items = frames
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    own = {r.doc_id: r for r in got if r.item_id == 100}
    assert set(own) == {900, 903}
    assert (own[900].slots, own[900].changed, own[900].coverage) == (4, 4, 1.0)


def test_clean_documents_stay(spark, frames):
    docs, items = frames
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, _ in plain_leaks(docs, items)}
    assert {r.doc_id for r in D.uncontaminated(d, b).collect()} == {i for i, _ in docs} - bad


def test_short_items_are_one_window(spark):
    d = spark.createDataFrame([(1, "he said that water boils at 90 degrees here"), (2, "water boils")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Water boils at 100 degrees"), (2, "water boils at"), (3, None), (4, ""), (None, "said that water boils at")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.changed) for r in D.leaks(d, b).collect()} == {(1, 1, 1), (1, 2, 0), (1, None, 0)}
    d = spark.createDataFrame([(3, "the water boils at once"), (3, "water boils")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in D.leaks(d, b).collect()} == {(3, 2, 1.0)}


def _found(spark, doc, item):
    d = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    return [(r.tokens, r.changed) for r in D.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]


def test_inserted_and_dropped_words_are_chained(spark):
    w = [f"{chr(97 + i // 10)}w{chr(97 + i % 10)}" for i in range(40)]
    assert _found(spark, " ".join([*w[:10], "so", *w[10:20], "well", *w[20:30], "now", *w[30:]]), " ".join(w)) == [(40, 0)]
    assert _found(spark, " ".join([*w[:10], *w[11:21], *w[22:32]]), " ".join(w)) == [(30, 0)]
    assert _found(spark, " ".join([*w[30:], *w[20:30], *w[10:20], *w[:10]]), " ".join(w)) == []  # in another order


def test_slots_of_another_length_are_one_unit(spark):
    w = [f"{chr(97 + i // 10)}w{chr(97 + i % 10)}" for i in range(40)]
    text = lambda numbers: " ".join(numbers[i // 8] if i % 8 == 7 else x for i, x in enumerate(w))
    item, more = text(["3", "4", "5", "3", "6"]), ["thirty seven", "forty two", "fifty three", "thirty seven", "sixty four"]
    assert _found(spark, text(more), item) == [(40, 4)]
    assert _found(spark, text([*more[:3], "ninety nine", more[4]]), item) == []


def test_verbatim_words_need_no_fit(spark):
    w = [f"{chr(97 + i // 10)}w{chr(97 + i % 10)}" for i in range(60)]
    w[20] = w[40] = "7"
    assert _found(spark, " ".join([*w[:40], "9", *w[41:]]), " ".join(w)) == [(59, 0)]


def test_odd_rows(odd, none, spark):
    b = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and"), (1, "quick brown fox jumps over the lazy dog and")], "item_id long, text string")
    assert {r.doc_id for r in D.leaks(odd, b).collect()} == {1, 7, 4, None}
    left = D.uncontaminated(odd, b)
    assert left.schema == SCHEMA and left.count() == odd.count() - 5
    assert D.leaks(none, b).count() == 0 and D.leaks(odd, b.limit(0)).count() == 0
    assert D.uncontaminated(odd, b.limit(0)).count() == odd.count() and D.uncontaminated(none, b).count() == 0
