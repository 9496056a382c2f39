"""Language ID against a plain cross-parse, on held-out texts, and on odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from hvspark.llm import language as L
from tests.llm.conftest import SCHEMA


def plain_phrases(train: str, text: str) -> int:
    """Phrases of a greedy parse, each the longest that is in the training text; one byte where none is."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in train:
            end += 1
        n, at = n + 1, end
    return n


@pytest.fixture(scope="module")
def docs():
    import duckdb

    return duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()


def test_counts_equal_a_plain_parse(docs, monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 64)
    monkeypatch.setattr(L, "WARM_UP", 8)
    texts = {lang: [t for t, x in docs if x == lang][:3] for lang in ("en", "de")}
    model = L.fit(texts)
    data, at = L.utf8(pa.array(["The then, erble! 12 xyz", "", "ö Q zz", *[t[:900] for t, _ in docs[:12]]], pa.large_string()))
    data, at = L.normalise(data, at)
    got = L.phrases(model, data, at)
    for k, lang in enumerate(model.languages):
        train, spans = L.normalise(*L.utf8(pa.array(texts[lang], pa.large_string())))
        whole = b"".join(train[a:b].tobytes() + b" " for a, b in zip(spans, spans[1:])).decode("latin-1")
        for r in range(len(at) - 1):
            assert got[r, k] == plain_phrases(whole, data[at[r] : at[r + 1]].tobytes().decode("latin-1"))


def test_held_out_accuracy(docs):
    texts = {lang: [t for t, x in docs[:500] if x == lang and len(t) < 3000][:20] for lang in ("en", "de", "fr", "es")}
    got, _, _ = L.scores(L.fit(texts), pa.array([t for t, _ in docs[500:]]))
    assert np.mean([a == b for a, (_, b) in zip(got, docs[500:])]) > 0.97


def test_texts_in_no_language_are_rejected(docs):
    model = L.fit({"en": [t for t, x in docs if x == "en" and len(t) < 3000][:20]})
    got, bits, _ = L.scores(model, pa.array(["это совсем другой язык и другие буквы в нём", "12 34 !!", None, "", "A.", "the that of"]))
    assert got == ["und", "und", "und", "und", "en", "en"]
    assert np.isnan(bits[1:4]).all()


def test_odd_rows(odd, none):
    model = L.fit({"en": ["the quick brown fox jumps over the lazy dog and runs into the dark wood"], "xx": ["zz qq"]})
    rows = L.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.keep} == {1, None, 4, 7}
    assert L.known_language(odd, model).schema == SCHEMA
    assert L.known_language(odd, model).count() == 5
    assert L.identify(none, model).count() == 0 and L.known_language(none, model).count() == 0
    empty = L.fit(L.labelled_texts(none))
    assert [r.language for r in L.identify(odd, empty).collect()] == ["und"] * odd.count()


def test_a_tie_goes_to_the_first_name():
    model = L.fit({"b": ["same words"], "a": ["same words"]})
    assert L.scores(model, pa.array(["same words"]))[0] == ["a"]


def test_labelled_texts_are_whole_and_bounded(odd):
    got = L.labelled_texts(odd, 4000)
    assert set(got) == {"en"} and all(len(t) <= 500 for t in got["en"])


def test_a_language_of_long_texts_is_kept_and_short_texts_fill_the_bound(spark):
    short = [(i, f"a title of number {i}", "en") for i in range(300)]
    docs = spark.createDataFrame([*short, (900, "12 " + "это другой язык " * 900, "ru"), (901, "1", "xx")], "doc_id long, text string, lang string")
    got = L.labelled_texts(docs, 4000)
    assert set(got) == {"en", "ru"} and got["ru"][0].startswith("это") and len(got["ru"][0].encode()) <= 500
    size = sum(len(t.encode()) for t in got["en"])
    assert 4000 <= size < 4500
    assert L.scores(L.fit(got), pa.array(["другой язык это"]))[0] == ["ru"]
