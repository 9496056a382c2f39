"""The Kneser-Ney model against a plain one, held-out separation, and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hvspark.llm import quality as Q


def plain_model(texts):
    """p(last byte | bytes before it) of interpolated modified Kneser-Ney, by its formulas."""
    grams = Counter()
    for t in texts:
        b = bytes(Q.ORDER - 1) + t.encode()
        grams.update(b[i : i + Q.ORDER] for i in range(len(b) - Q.ORDER + 1))
    counts = {Q.ORDER: dict(grams)}
    for k in range(Q.ORDER - 1, 0, -1):
        c = defaultdict(int)
        for g in counts[k + 1]:
            c[g[1:]] += 1
        counts[k] = dict(c)
    d = {k: Q.discounts(*(sum(n == i for n in c.values()) for i in (1, 2, 3, 4))) for k, c in counts.items()}
    cut = lambda k, n: d[k][min(n, 3) - 1]
    total, spent = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            spent[k, g[:-1]] += cut(k, n)

    def p(g, k=Q.ORDER):
        if k == 0:
            return 1 / 256
        g = g[-k:]
        lower = p(g, k - 1)
        if (k, g[:-1]) not in total:
            return lower
        n = counts[k].get(g, 0)
        return ((n - cut(k, n)) if n else 0) / total[k, g[:-1]] + spent[k, g[:-1]] / total[k, g[:-1]] * lower

    return p


def bits(p, text):
    b = bytes(Q.ORDER - 1) + text.encode()
    return -sum(math.log2(p(b[i : i + Q.ORDER])) for i in range(len(text.encode())))


@pytest.fixture(scope="module")
def prose():
    import duckdb

    return [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 1500 order by doc_id limit 30").fetchall()]


def test_scores_equal_the_plain_model(spark, prose):
    p = plain_model(prose[:20])
    model = Q.train(spark.createDataFrame([(t,) for t in prose[:20]], "text string"))
    texts = [*prose[15:25], "Zq#9 never seen", "", None, "é", "a" * 3000]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i].bits == pytest.approx(bits(p, t or ""), rel=1e-9, abs=1e-9)
        assert got[i].bytes == len((t or "").encode())


def test_probabilities_add_up(prose):
    p = plain_model(prose[:5])
    for context in (b"\0\0\0\0", b" the", b"zzzz"):
        assert sum(p(context + bytes([x])) for x in range(256)) == pytest.approx(1)


def test_junk_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.2


def test_junk_beyond_the_quantile_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.classify(docs, labels).join(labels, "doc_id").where("quality = 0").agg(F.avg(F.col("keep").cast("int"))).first()
    assert rows[0] < 0.05


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (4, 1, "x"), (None, 1, "x"), (5, 0, "x")], "doc_id long, quality int, text string")
    got = Q.classify(odd, labels).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.perplexity is None) == (r.bytes == 0)
        assert r.bytes > 0 or not r.keep
    nobody = Q.classify(odd, labels.limit(0)).collect()
    assert all(r.keep == (r.bytes > 0) and r.threshold is None for r in nobody)
    assert Q.classify(none, labels).count() == 0


def test_discounts_where_counts_are_missing():
    assert Q.discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    assert np.all(np.diff(Q.discounts(100, 40, 20, 10)) > 0)
