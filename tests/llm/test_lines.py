"""Line dedup: the cuckoo filter, and insertions and deletions against a plain model."""

import random

import numpy as np
import pytest

from hvspark.llm import lines as L
from hvspark.llm.cuckoo import CuckooFilter
from tests.llm.conftest import SCHEMA


def test_cuckoo_filter_holds_what_was_inserted_and_not_removed():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    f = CuckooFilter.build(h)
    assert f.contains(h).all()
    other = rng.integers(1 << 63, (1 << 64) - 1, 50_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.001
    f.remove(h[:10_000])
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.001
    assert not CuckooFilter.build(h[:0]).contains(h).any()


def plain(docs):
    """(doc_id, text) in the order of insertion: each line where it first comes."""
    seen, out = set(), {}
    for i, text in docs:
        keep, n = [], 0
        for line in text.split("\n"):
            if line.strip(" ") == "":
                keep.append(line)
            elif line.strip(" ") not in seen:
                seen.add(line.strip(" "))
                keep.append(line)
                n += 1
        if n or not text.replace("\n", "").strip(" "):
            out[i] = "\n".join(keep)
    return out


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(4)
    make = lambda i: (i, "\n".join(rng.choice([*"acd", "b ", f"own {rng.randrange(9)}", "", "x y z"]) for _ in range(rng.randrange(1, 7))))
    return [make(i) for i in range(30)], [make(i) for i in range(30, 60)]


def test_insertions_and_deletions_are_reversible(spark, batches):
    first, second = batches
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda s, rows: {r.doc_id: r.text for r in s.deduplicated(frame(rows)).collect()}
    store = L.LineStore.scratch(frame(first), 4)
    store.insert(frame(first))
    assert texts(store, first) == plain(first)
    before = sorted(map(str, store.refs.collect()))
    store.insert(frame(second))
    both = {x.strip(" ") for _, t in first for x in t.split("\n")} & {x.strip(" ") for _, t in second for x in t.split("\n")} - {""}
    assert len(both) <= store.looked_up <= len(both) + 1  # new lines aren't looked up
    store = L.LineStore.open(spark, store.folder)
    assert texts(store, first + second) == plain(first + second)
    store.insert(frame(second))  # again: nothing changes
    assert texts(store, first + second) == plain(first + second)
    store.delete(frame(second))
    assert sorted(map(str, store.refs.collect())) == before
    store = L.LineStore.open(spark, store.folder)
    store.delete(frame(first[:15]))  # their lines come back in others
    assert texts(store, first[15:]) == plain(first[15:])
    held = {r.shard: CuckooFilter.from_bytes(bytes(r.filter)) for r in store.filters.collect()}
    for r in store.refs.collect():
        assert held[r.shard].contains(np.array([r.h1], np.int64).view(np.uint64)).all()
    counts = {}
    for _, t in first[15:]:
        for x in t.split("\n"):
            counts[x.strip(" ")] = counts.get(x.strip(" "), 0) + 1
    counts.pop("", None)
    assert sorted(r.refs for r in store.refs.collect()) == sorted(counts.values())
    store.delete(frame(first[15:]))
    assert store.refs.count() == store.lines.count() == 0


def test_batches_dont_change_the_result(spark, batches):
    rows = [*batches[0], *batches[1], (None, "a\nown text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(str, L.dedup(docs, 4, n).collect())) for n in (1, 3))
    assert a == b
    store = L.LineStore.scratch(docs, 4)
    store.insert(docs)
    (spark.createDataFrame([(1,)], "x int").write.parquet(f"{store.folder}/refs/9-died"))  # a change that died before it counted
    assert L.LineStore.open(spark, store.folder).refs.count() == store.refs.count()


def test_odd_rows(odd, none):
    got = L.dedup(odd).collect()
    assert [r.doc_id for r in got].count(1) == 1 and 7 not in {r.doc_id for r in got}
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].text is None and by[3].text == "" and by[5].text == " \n\n " and by[6].text == "..."
    assert by[4]._lines == by[4]._kept == 1 and by[4].window == "w"
    assert sum(r.doc_id is None for r in got) == 2
    assert L.stage(odd.sparkSession, odd, "").schema == SCHEMA
    assert L.dedup(none).count() == 0 and L.dedup(none, batches=2).count() == 0


def test_passages_go_where_they_repeat(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}\nlast {i}") for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup(docs).collect()}
    assert got[0].count("word59") == 1 and all(got[i] == f"own {i}\nlast {i}" for i in range(1, 5))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_rows_that_repeat_count_once(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([(1, "hot\na"), (1, "hot\na"), (2, "hot\nb"), (1, "hot\nc")], "doc_id long, text string")
    store = L.LineStore.scratch(docs, 2)
    store.insert(docs)
    assert sorted(r.refs for r in store.refs.collect()) == [1, 1, 1, 3]
    store.delete(docs.where("doc_id = 1"))
    assert sorted((r.refs, r.owner.doc_id) for r in store.refs.collect()) == [(1, 2), (1, 2)]
