"""The n-gram Jaccard join against all pairs, and groups against plain union-find."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hvspark.llm import jaccard as J
from hvspark.llm.frames import spread_join
from hvspark.llm.tokens import words
from tests.llm.conftest import SCHEMA


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = {}
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 150))]
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.08, 0.2]) else rng.choice(vocabulary) for w in base]
            out[len(out)] = " ".join(copy)
    return out


def brute(texts):
    """(class_id, links) of each document, and the pairs of the first ones of equal sets."""
    sets = {i: grams(t) for i, t in texts.items()}
    pairs = {(a, b): similarity(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= 0.5}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    links = {i: sum(i in p for p in pairs) for i in texts}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    firsts = set(first.values())
    return {i: (find(i), links[i]) for i in texts}, {p: s for p, s in pairs.items() if set(p) <= firsts}


def same(got, want):
    """All classes, and nearly all links: a pair at the threshold is found with a chance of 98 %."""
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(n <= want[i][1] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())


def test_join_has_all_classes_and_links(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same({r.doc_id: (r.class_id, r.links) for r in J.jaccard_join(docs).collect()}, brute(texts)[0])


def test_pairs_of_classes(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.jaccard_pairs(docs).collect()}
    want = brute(texts)[1]
    assert set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.03 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_one_document_of_each_group_stays(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in J.one_of_each(docs).collect()) == sorted({c for c, _ in brute(texts)[0].values()})


@pytest.mark.parametrize("rows", [4096, 40])
def test_a_large_group_is_complete_whole_and_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(J, "GROUP_ROWS", rows)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[: i % 100] + [f"x{i}"] + base[i % 100 :]) for i in range(300)}
    texts |= {300 + i: texts[i] for i in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    same({r.doc_id: (r.class_id, r.links) for r in J.jaccard_join(docs).collect()}, brute(texts)[0])
    assert [r.doc_id for r in J.one_of_each(docs).collect()] == [0]


def test_connecting_a_group_of_near_copies_doesnt_compare_all_of_it():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, 20).astype(np.uint64))) for _ in range(J.GROUP_ROWS * 2)]
    values = np.tile(rng.integers(0, 1 << 16, J.BANDS * J.ROWS).astype(np.uint16), (len(sets), 1))
    g = J.Group(0, np.zeros(len(sets), np.int64), [np.zeros(1, np.int64)] * len(sets), values, sets, 0.5, 1e-3)
    likely, compared = g.likely, []
    g.likely = lambda i, j: compared.append(len(i)) or likely(i, j)
    assert sum(len(js) for _, js, _ in g.tree()) == len(sets) - 1
    assert sum(compared) < 2 * len(sets)


@pytest.mark.parametrize("hot", [2, 1 << 16])
def test_components(spark, hot):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 220)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = J.components(spark.createDataFrame(edges, "u long, v long"), hot).collect()
    assert {r.node: r.root for r in got} == {x: r for x, r in want.items() if x != r}


@pytest.mark.parametrize("hot", [2, 1 << 16])
def test_hot_keys_are_joined_all_the_same(spark, hot):
    rows = spark.createDataFrame([(i % 5 if i % 3 else 9, i) for i in range(90)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = spread_join(rows, table, "k", "n", hot).collect()
    assert len(got) == 90 and all(r.most >= r.v for r in got)


def test_pruning_keeps_pairs_at_the_threshold():
    least = J.least_matches(0.5, 1e-3)
    assert all(0 < least[n] < n / 2 for n in list(least)[1:])
    assert J.least_matches(0.5, 1e-12)[256] < least[256]


def test_odd_rows(odd, none):
    got = sorted(tuple(r) for r in J.jaccard_join(odd).collect() if r.doc_id is not None)
    ids = {r.doc_id: r.class_id for r in J.jaccard_join(odd).collect() if r.doc_id in (2, 3, 5, 6)}
    assert ids == {i: i for i in ids} and len(ids) == 4
    assert [r for r in got if r[0] in (1, 7)] == [(1, None, 3), (1, None, 3), (7, None, 3)]
    nulls = [tuple(r) for r in J.jaccard_join(odd).collect() if r.doc_id is None]
    assert sorted(nulls, key=str) == [(None, None, 0), (None, None, 3)]
    left = J.one_of_each(odd)
    assert left.schema == SCHEMA
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [2, 3, 4, 5, 6]
    assert ids.count(None) == 2
    assert J.jaccard_join(none).count() == 0 and J.one_of_each(none).count() == 0 and J.jaccard_pairs(none).count() == 0


def test_short_texts_are_one_gram(spark):
    docs = spark.createDataFrame([(1, "Of."), (2, "of"), (3, "of the"), (4, "Ab cd")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_join(docs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
