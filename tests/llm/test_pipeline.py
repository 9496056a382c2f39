"""The pipeline against brute-force stages, and on odd rows."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from hvspark.llm import bpe, language
from tests.llm.conftest import SCHEMA
from tests.llm.test_decontaminate import plain_leaks
from tests.llm.test_jaccard import grams, similarity
from tests.llm.test_lines import plain


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    import duckdb

    at = str(tmp_path_factory.mktemp("small"))
    docs = [list(r) for r in duckdb.sql("select doc_id, text, lang, source, n_chars from '/root/testdata/sf0.001/documents.parquet' where length(text) between 60 and 700 order by doc_id limit 40").fetchall()]
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet' order by item_id limit 6").fetchall()
    docs += [[900, docs[0][1], "en", "s", 1], [901, "new line\n" + docs[1][1].replace("\n", " other "), "en", "s", 1], [902, f"so {items[0][1]} well", "en", "s", 1], [903, "это не тот язык, и в нём другие буквы " * 5, "en", "s", 1]]
    docs += [[910 + i, " ".join(f"w{j}" if j != i else f"other{i}" for j in range(60)), "en", "s", 1] for i in range(0, 20, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def test_run_equals_brute_force(spark, small):
    at, docs, items = small
    frame = spark.read.parquet(f"{at}/documents.parquet")
    known, _, _ = language.scores(language.fit(language.labelled_texts(frame)), pa.array([d[1] for d in docs]))
    left = {d[0]: d[1] for d, lang in zip(docs, known) if lang != "und"}
    assert 903 not in left and len(left) >= len(docs) - 3
    left = plain(sorted(left.items()))
    assert 900 not in left
    sets = {i: grams(t) for i, t in left.items()}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and similarity(sets[a], sets[b]) >= 0.5:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    assert not {915, 920, 925} & set(left) and 910 in left
    bad = {i for i, _ in plain_leaks(list(left.items()), items)}
    assert 902 in bad
    left = {i: t for i, t in left.items() if i not in bad}
    coder = bpe.Coder(bpe.read_ranks())
    got = {r.doc_id: r for r in P.run(spark, at).collect()}
    assert {i: r.text for i, r in got.items()} == left
    for i, r in got.items():
        assert r.ids == np.frombuffer(coder.encode(left[i]), np.uint32).tolist() and r.n_tokens == len(r.ids)


def test_stages_take_odd_rows(spark, small, odd, none):
    at, _, _ = small
    for name, stage in P.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, at)
            rows = out.count()
            assert rows <= docs.count()
            if name != P.STAGES[-1][0]:
                assert out.schema == SCHEMA, name
