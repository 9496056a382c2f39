"""Searches and joins that list no more than they need, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from hvspark.functions import vectors as V
from hvspark.operators import retrieve as R


def similarity(a, b):
    return len(a & b) / len(a | b)


def best(queries, vectors, k):
    out = {}
    for q, x in queries:
        found = sorted((-similarity(set(x), set(y)), i) for i, y in vectors if set(x) & set(y))[:k]
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(found)}
    return out


def frames(spark, queries, vectors):
    return spark.createDataFrame(queries, "query_id long, hv array<int>"), spark.createDataFrame(vectors, "id long, hv array<int>")


def rows(df):
    return {(r.query_id, r.rank): (r.id, r.similarity) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_each_search_gives_the_plain_rows(spark, seed):
    rng = random.Random(seed)
    vectors = [(i, sorted(rng.sample(range(25), rng.randint(0, 6)))) for i in range(150)]
    queries = [(i + 100, sorted(rng.sample(range(27), rng.randint(0, 6)))) for i in range(80)] + vectors[:40]
    q, d = frames(spark, queries, vectors)
    want = best(queries, vectors, 4)
    for search in (R.top_k, R._top_k_small, R._top_k_of_kinds, R._top_k_joined):
        assert rows(search(q, d, 4)) == want, search


def test_the_search_for_small_vectors_doesnt_list_all_overlaps(spark):
    q, d = frames(spark, [(i, [0, i + 1]) for i in range(400)], [(i, [0, i + 1]) for i in range(400)])
    plan = R.top_k(q, d, 3)
    assert rows(plan)[7, 1] == (7, 1.0) and rows(plan)[7, 2] == (0, 1 / 3)
    assert "pair" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_entmax_reads_its_scores_once(spark):
    s = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.5), (1, "c", 0.0)], "query_id int, id string, score double").where("score >= 0")
    plan = R.entmax(s)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {(r.query_id, r.id) for r in plan.where("weight > 0").collect()} == {(0, "a"), (0, "b"), (1, "c")}


def test_stores_that_share_ids_are_searched_at_once(spark):
    rng = random.Random(3)
    stores = [[(i, sorted(rng.sample(range(30), 4))) for i in range(n, n + 40)] for n in (0, 20, 30)]
    queries = [(i, sorted(rng.sample(range(30), 4))) for i in range(20)]
    want = {}
    for q, x in queries:
        at = {}
        for i, y in sum(stores, []):
            if set(x) & set(y):
                at[i] = max(at.get(i, 0), similarity(set(x), set(y)))
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in at.items())[:5])}
    got = R.federated(frames(spark, queries, [])[0], [frames(spark, [], s)[1] for s in stores], 5)
    assert rows(got) == want


def test_indices_beyond_the_dimension(spark):
    a, b = [3, 40, 99], [8, 35, 67]
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    ordered = V.bind_ordered(F.col("a"), F.col("b"), 32)
    made = V.compose([("subject", F.col("a")), ("object", F.col("b"))], 32)
    r = df.select(ordered.alias("ordered"), V.within(V.unbind_left(ordered, F.col("b"), 32), 32).alias("left"), made.alias("made"), V.within(V.unbind(made, [("subject", F.col("a"))], "object", 32), 32).alias("other")).first()
    assert (r.ordered, r.left) == ([4, 4, 8, 9, 35, 67], [3, 8])
    assert (r.made, r.other) == ([3, 6, 6, 11, 40, 99], [3, 8])


def test_deltas_of_parts_beyond_the_dimension(spark):
    from hvspark.queries.vectors import WHOLE

    df = spark.createDataFrame([([5, 40_000, 1_200_000],)], "hv array<int>")
    assert df.select(V.from_deltas(V.to_deltas(F.col("hv")), WHOLE)).first()[0] == [5, 40_000, 1_200_000]


def test_equal_vectors_cluster_as_before(spark):
    from hvspark.operators import factor

    rng = random.Random(5)
    kinds = [sorted(rng.sample(range(40), 6)) for _ in range(12)] + [[]]
    data = [(i, kinds[rng.randrange(13)]) for i in range(60)]
    near = {i: {j for j, y in data if j != i and set(x) & set(y) and similarity(set(x), set(y)) > 0.3} for i, x in data}
    used, want = set(), {}
    for i in sorted(near):
        if i not in used and len(group := [i, *sorted(near[i] - used)]) >= 3:
            used |= set(group)
            want |= {j: i for j in group}
    members, report = factor.concepts(frames(spark, [], data)[1], 1024, passes=1)
    assert {r.id for r in members.collect()} == set(want)
    pairs = R.similar_pairs(frames(spark, [], data)[1], 0.3).count()
    assert pairs > 60 and sum(r.members for r in report.collect()) == len(want)
    assert {r.centre for r in report.collect()} <= set(want.values())


def test_a_worker_encodes_a_text_once(monkeypatch):
    import pandas as pd

    from hvspark.functions import hashing as H

    calls = []
    plain = H.TextEncoder.encode
    monkeypatch.setattr(H.TextEncoder, "encode", lambda self, text: calls.append(text) or plain(self, text))
    for _ in range(2):
        got = H.encoded(pd.Series(["hot ring", None, "red bolt", "hot ring"]), 1024)
    assert calls == ["hot ring", "red bolt"] and got == [plain(H.TextEncoder(1024), t) if t else None for t in ("hot ring", None, "red bolt", "hot ring")]


def test_closest_are_those_of_the_whole_join(spark, monkeypatch):
    from hvspark.operators import aggregate as A
    from hvspark.operators import closest as C

    rng = random.Random(7)
    vectors = [(i, sorted({0, *rng.sample(range(1, 60), 8)})) for i in range(120)]
    q, d = frames(spark, [(i, h[: rng.randint(1, 9)]) for i, h in vectors[:50]] + [(900, []), (901, [999])], vectors)
    weights = A.idf(d, 64)
    scores = {}
    for r in R.weighted_overlap(q, d, weights).collect():
        scores.setdefault(r.query_id, {})[r.id] = r.score
    monkeypatch.setattr(C, "BLOCK", 10)
    monkeypatch.setattr(C, "STEPS", 500)
    for how, keep in (({"margin": 1.5}, lambda s, t: s >= t - 1.5), ({"share": 0.6, "common": 20}, lambda s, t: s > 0.6 * t)):
        want = {(a, b): s for a, of in scores.items() for b, s in of.items() if keep(s, max(of.values()))}
        got = {(r.query_id, r.id): r.score for r in C.closest(q, d, weights, **how).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_similar_pairs_of_small_vectors(spark):
    rng = random.Random(9)
    data = [(i, sorted(rng.sample(range(20), rng.randint(0, 6)))) for i in range(90)]
    for least in (0.2, 0.3, 0.9):
        want = {(i, j): similarity(set(x), set(y)) for i, x in data for j, y in data if i < j and set(x) & set(y) and similarity(set(x), set(y)) > least}
        plan = R.similar_pairs(frames(spark, [], data)[1], least)
        assert {(r.a, r.b): r.similarity for r in plan.collect()} == want
    assert "pair" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_makes_the_edge_of_a_fact_once(monkeypatch):
    from hvspark.streaming import folds

    calls = []
    plain = folds.PlasticField._edge
    monkeypatch.setattr(folds.PlasticField, "_edge", lambda self, *x: calls.append(x) or plain(self, *x))
    f = folds.PlasticField(1024)
    for _ in range(3):
        assert f.edge("a", "r", "b").tolist() == plain(f, "a", "r", "b").tolist()
    assert calls == [("a", "r", "b")]


def test_two_stores_unite_the_slow_one_once():
    from hvspark.streaming import folds

    rng, m = random.Random(4), folds.TwoStores(64, every=5)
    for _ in range(60):
        m.add(sorted(rng.sample(range(64), 3)))
        assert (m.slow_whole or set()) == set().union(*m.slow)


def test_embeddings_are_asked_by_every_hundredth(spark):
    from hvspark.queries.encoding import similar_embeddings

    got = {r.query_id for r in similar_embeddings(spark, "/root/testdata/sf0.01").select("query_id").collect()}
    assert got and all(i % 100 == 0 for i in got)


def test_two_stores_fold_in_one_pass(spark):
    from hvspark.streaming import folds

    rng = random.Random(6)
    rows = [(i % 4, i, sorted(rng.sample(range(64), 3))) for i in range(80)]
    want = set()
    for k in range(4):
        m = folds.TwoStores(64, every=5)
        for r in rows:
            if r[0] == k:
                m.add(r[2])
        want.add((k, len(m.fast), len(m.slow)))
    plan = folds.consolidate(spark.createDataFrame(rows, "k int, seq long, hv array<int>").repartition(3), "k", 64, every=5)
    assert {tuple(r) for r in plan.collect()} == want
    assert "MapInPandas" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_stale_composites_of_a_union_are_joined_once(spark, monkeypatch):
    from hvspark.operators import cognition as C

    monkeypatch.setattr(C, "ROWS", 50)
    parts = [spark.range(n, n + 40).select(F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("id")) for n in (0, 30, 60)]
    composites = parts[0].unionByName(parts[1]).unionByName(parts[2])
    live = spark.range(0, 400).select((F.col("id") % 50).cast("string").alias("id")).unionByName(spark.createDataFrame([(None,)], "id string"))
    plan = C.stale(composites, live)
    ids = [i for n in (0, 30, 60) for i in range(n, n + 40)]
    want = sorted("" if i % 7 == 0 else str(i) for i in ids if i % 7 == 0 or i >= 50)
    assert sorted(r.id or "" for r in plan.collect()) == want
    assert plan.columns == ["id"] and plan.rdd.getNumPartitions() == 11
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("few", [100_000, 0])
def test_hypotheses_read_subjects_once(spark, monkeypatch, few):
    from collections import Counter

    from hvspark.functions import hashing as H
    from hvspark.operators import aggregate as A
    from hvspark.operators import cognition as C
    from hvspark.sources import tables

    monkeypatch.setattr(tables, "FEW", few, raising=False)
    rng, dim = random.Random(8), 1024
    facts = [(f"s{i}", r, rng.choice(objects)) for i in range(60) for r, objects in {"a": "xy", "b": "uvw", "c": "pq", "d": "zzzt"}.items() if rng.random() < 0.7]
    facts += [(None, "a", "x"), (None, "b", "u"), ("s1", "e", None), ("s2", "a", "y")]
    of = {}
    for s, r, o in facts:
        of.setdefault(s, set()).add(r)
    pools = {}
    for mine in {frozenset(x) for x in of.values()}:
        peers = [s for s, x in of.items() if len(x & mine) >= 2]
        peers = peers[:-1] if len(mine) >= 2 else peers  # a subject is no peer of itself; which one doesn't matter for the counts
        for r in set().union(*of.values()) - mine:
            # of the peers one has the relations of mine, and so not r
            if peers and sum(r in of[s] for s, x in of.items() if len(x & mine) >= 2) / len(peers) >= 0.3:
                pools[mine, r] = Counter(o for s, q, o in facts if q == r and s is not None and len(of[s] & mine) >= 2)
    atoms = spark.createDataFrame([(x,) for x in sorted({x for f in facts for x in f if x})], "id string").select("id", H.atom_udf(dim)(F.col("id")).alias("hv")).localCheckpoint()
    hv = {r.id: r.hv for r in atoms.collect()}
    probes, names = [], list(pools)
    for n, key in enumerate(names):
        pool = pools[key]
        counts = Counter()
        for o, m in pool.items():
            for i in hv.get(o, []):
                counts[i] += m
        half = sorted((-c, i) for i, c in counts.items() if c >= -(-sum(pool.values()) // 2))[: V.active(dim)]
        probes.append((n, sorted(i for _, i in half) or hv[min(filter(None, pool))]))
    best = R.cleanup(spark.createDataFrame(probes, "query_id int, hv array<int>"), atoms, A.idf(atoms, dim), dim).where("weight >= 0.3").collect()
    want = {(s, names[b.query_id][1], b.id, round(b.weight, 9)) for b in best for s, x in of.items() if s is not None and x == names[b.query_id][0]}
    plan = C.hypotheses(spark.createDataFrame(facts, "s string, r string, o string"), atoms, dim, 2, 0.3, 0.3)
    assert want and {(x.s, x.r, x.o, round(x.confidence, 9)) for x in plan.collect()} == want
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in tree and ("broadcast" in tree) == (few > 0)
