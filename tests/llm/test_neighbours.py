"""Nearest neighbours against brute force: recall, order, ties and odd rows."""

import numpy as np
import pytest

from hvspark.llm import neighbours as N


def brute(ids, x, k):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        out[ids[i]] = [ids[j] for j in np.lexsort((ids, d))[: min(k, len(x) - 1)]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(12, size=600)] + rng.normal(size=(600, 16))).astype(np.float32)
    x[10] = x[20] = x[30]
    return np.arange(600) * 3, x


@pytest.mark.parametrize("block_rows, fit_rows", [(1 << 14, 1 << 16), (25, 300)])
def test_recall_and_order(spark, data, block_rows, fit_rows):
    ids, x = data
    table = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in N.neighbours(table, 10, leaf=40, block_rows=block_rows, fit_rows=fit_rows).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, r.distance))
    want = brute(ids, x.astype(np.float64), 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({n for n, _ in got[i]} & set(want[i])) / 10 for i in want]) >= 0.9
    for i, v in got.items():
        assert v == sorted(v, key=lambda t: (t[1], t[0]))
    assert got[30][:2] == [(60, 0.0), (90, 0.0)] and got[60][:2] == [(30, 0.0), (90, 0.0)]


def test_best_bin_first_visits_every_leaf_once(data):
    ids, x = data
    x = x.astype(float)
    tree = N.grow(x, 40)
    leaves = [n for n, c in enumerate(tree.children) if not c]
    assert np.bincount(tree.descend(x)).max() <= 40
    order = tree.visits(x[0], len(leaves))
    assert sorted(order) == leaves and order[0] == tree.descend(x[:1])[0]
    assert tree.visits(x[0], 3) == order[:3]


def test_query_has_the_recall_it_asks_for(spark):
    """The query itself, over the whole table, against brute force for all its queries."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    t = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchnumpy()
    ids, x = t["vec_id"], np.stack(t["embedding"]).astype(np.float64)
    got = {}
    for r in N.op8_nearest_neighbours(spark, sf).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, r.distance))
    assert sorted(got) == [i for i in ids.tolist() if i % N.EACH == 0]
    hits = 0
    for i, found in got.items():
        d = np.sqrt(((x - x[ids == i]) ** 2).sum(1))
        d[ids == i] = np.inf
        assert np.allclose([far for _, far in found], [d[ids == n][0] for n, _ in found])
        hits += len({n for n, _ in found} & set(ids[np.lexsort((ids, d))[: N.NEIGHBOURS]].tolist()))
    assert hits >= 0.9 * N.NEIGHBOURS * len(got)


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0], "a"), (2, [0.0, 1.0], "a"), (2, [5.0, 5.0], "a"), (3, None, "a"), (4, [], "a"), (5, [1.0], "a"), (None, [0.0, 0.0], "a"), (6, [float("nan"), 0.0], "a"), (7, [None, 0.0], "a"), (8, [3.0, 1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = [tuple(r) for r in N.neighbours(table, 5).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 2, 0.0), (1, 2, 8, 3.0), (2, 1, 1, 0.0), (2, 2, 8, 3.0), (8, 1, 1, 3.0), (8, 2, 2, 3.0)]
    assert N.neighbours(table.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    tied = {(r.id, r.rank): r.neighbour for r in N.neighbours(same, 3, leaf=10).collect()}
    assert len(tied) == 150 and tied[0, 1] == 1 and tied[9, 1] == 0
