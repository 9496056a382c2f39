"""BPE against the library that the vocabulary was made for, and exact round trips."""

import random

import numpy as np
import pytest
import tiktoken

from hvspark.llm import bpe as B
from tests.llm.conftest import SCHEMA


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def coder(request):
    return B.Coder(B.read_ranks(f"/opt/tokenizers/{request.param}"))


def texts():
    import duckdb

    rng = random.Random(7)
    letters = [*map(chr, range(32, 127)), *map(chr, range(160, 0x250)), "日", "😀", "\x1c", "\n", "\t", "　", "１"]
    yield from (t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    yield from ("", " ", "a", "\n\n  x ", "aaaa" * 300, "I'm we'll they've", "x" * 5000, "\x1c\x1f b")
    yield from ("".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(400))
    yield from ("".join(rng.choice("abtheion ") for _ in range(200)) for _ in range(200))


def test_ids_equal_the_library_and_texts_come_back(coder):
    library = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in texts():
        ids = np.frombuffer(coder.encode(t), np.uint32).tolist()
        assert ids == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_merges_by_rank_give_the_same(coder):
    def merged(data: bytes) -> list[int]:
        parts = [bytes([x]) for x in data]
        while True:
            best = min(((coder.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [coder.ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(500):
        data = bytes(rng.choice(b"abcdeinorst ") for _ in range(rng.randrange(1, 40)))
        assert coder.encode_piece(data) == merged(data)


def test_small_memories_change_nothing(coder, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 3)
    monkeypatch.setattr(B, "FITS", 5)
    small = B.Coder(coder.ranks)
    assert [small.encode(t) for t in list(texts())[:30]] == [coder.encode(t) for t in list(texts())[:30]]


def test_odd_rows(odd, none):
    rows = B.decode(B.encode(odd, verify=True)).collect()
    assert len(rows) == odd.count()
    assert all(r._text == r.text for r in rows)
    assert all(r._exact == (None if r.text is None else True) for r in rows)
    assert {r.doc_id: r._ids for r in rows if r.doc_id in (2, 3)} == {2: None, 3: []}
    assert B.encode(none).count() == 0
    out = B.stage(odd.sparkSession, odd.withColumnRenamed("row", "ids"), "")
    assert set(out.columns) >= set(SCHEMA.names) - {"row"} and out.count() == odd.count()


def test_lone_ids_of_broken_characters(spark):
    ids = np.frombuffer(B.Coder(B.read_ranks()).encode("é"), np.uint32).tolist()
    row = spark.createDataFrame([(1, [B.read_ranks()[b"\xc3"]]), (2, None), (3, ids)], "doc_id long, _ids array<int>")
    assert [r._text for r in B.decode(row).orderBy("doc_id").collect()] == ["�", None, "é"]
