"""Vectors, bundles, retrieval, text, provenance, streams and the store on literal rows."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hvspark import provenance as P
from hvspark.functions import hashing as H
from hvspark.functions import text as T
from hvspark.functions import vectors as V
from hvspark.memory import Memory
from hvspark.operators import aggregate as A
from hvspark.operators import agency, factor, graph, meaning
from hvspark.operators import retrieve as R
from hvspark.plans import router
from hvspark.sources.store import Store
from hvspark.streaming import folds


def hv(*x):
    return F.array(*map(F.lit, x)).cast("array<int>")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_algebra(spark):
    a, b, none = hv(1, 3, 5), hv(3, 5, 7), F.array().cast("array<int>")
    r = one(
        spark, xor=V.xor(a, b), hamming=V.hamming(a, b), jaccard=V.jaccard(a, b), empty=V.jaccard(none, none), share=V.containment(a, b), none=V.containment(none, b),
        moved=V.permute(b, 10, 16), corrected=V.corrected(F.lit(0.75), 0.5), full=V.corrected(F.lit(1.0), 1.0), gaps=V.to_deltas(b), back=V.from_deltas(hv(3, 2, 20, 1), 16), clean=V.from_indices(hv(9, 3, 3, -1, 16), 16),
    )
    assert (r.xor, r.hamming, r.jaccard, r.empty, r.share, r.none) == ([1, 7], 2, 0.5, 1.0, pytest.approx(2 / 3), 1.0)
    assert (r.moved, r.corrected, r.full, r.gaps, r.back, r.clean) == ([1, 13, 15], 0.5, 0.0, [3, 2, 2], [3, 5], [3, 9])
    with pytest.raises(ValueError):
        V.compose([], 16)
    with pytest.raises(ValueError):
        V.register_role({}, "object", 2)


def test_bundles(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("a", [2, 3]), ("a", [2, 4]), ("b", [])], "k string, hv array<int>")
    assert {r.k: (r.members, r.hv) for r in A.bundle(df, ["k"], 1024).collect()} == {"a": (3, [2]), "b": (1, [])}
    assert {r.k: r.hv for r in A.union(df, ["k"]).collect()} == {"a": [1, 2, 3, 4], "b": []}
    noisy = [r.hv for r in A.bundle(df.where("k = 'a'"), ["k"], 1024, noise=50.0, seed=1).collect()]
    assert noisy == [[2]]
    assert A.bundle(df.limit(0), ["k"], 1024).count() == 0


def test_idf_takes_the_upper_median_over_all_indices(spark):
    v = spark.createDataFrame([(1, [0, 1]), (2, [0])], "id int, hv array<int>")
    got = {r.idx: r.w for r in A.idf(v, 4).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.510826, 0.693147, 1.098612, 1.098612]


def test_attention(spark):
    s = spark.createDataFrame([(0, "a", 2.0), (0, "b", 1.5), (0, "c", 0.0)], "query_id int, id string, score double")
    w = lambda f: {r.id: r.weight for r in f(s).collect()}
    assert w(R.sparsemax) == {"a": 0.75, "b": 0.25, "c": 0.0}
    soft = w(R.softmax)
    assert sum(soft.values()) == pytest.approx(1) and min(soft.values()) > 0
    mid = w(R.entmax)
    assert sum(mid.values()) == pytest.approx(1) and mid["c"] == 0


def test_text_encoder_is_deterministic_and_near_for_near_texts(spark):
    e = H.TextEncoder(16384)
    a, b, c = (set(e.encode(t)) for t in ("the cat sat on the mat", "the cat sat on the rug", "quarterly revenue projections"))
    assert 0 < len(a) <= 64 and 0 < len(b) <= 64 and 0 < len(c) <= 64 and a == set(e.encode("  the cat sat on the mat "))
    assert e.encode("") == e.encode("  ") == [] and e.encode(None) is None
    assert e.encode("x") and len(H.seeded(np.array([5], np.uint64), 4096)[0]) == 16
    rows = spark.createDataFrame([("the cat sat on the mat",), (None,)], "t string").select(H.text_udf(16384)(F.col("t")).alias("hv")).collect()
    assert set(rows[0].hv) == a and rows[1].hv is None


def test_numbers_near_each_other_are_similar(spark):
    r = spark.createDataFrame([(x,) for x in (10.0, 10.01, 40.0)], "x double").select(V.scalar(F.col("x"), 0, 50, 16384).alias("hv")).collect()
    a, b, c = (set(x.hv) for x in r)
    assert len(a) == 64 and len(a & b) > 50 and not a & c


def test_cleanup_finds_the_stored_atom(spark):
    rng = np.random.default_rng(1)
    m = H.seeded(np.arange(200, dtype=np.uint64), 4096)
    atoms = spark.createDataFrame([(f"a{i}", x.tolist()) for i, x in enumerate(m)], "id string, hv array<int>")
    noisy = [(i, sorted({*rng.choice(m[i], 11, False).tolist(), *rng.integers(0, 4096, 5).tolist()})) for i in range(5)]
    got = R.cleanup(spark.createDataFrame(noisy, "query_id int, hv array<int>"), atoms, A.idf(atoms, 4096), 4096)
    assert {r.query_id: r.id for r in got.collect()} == {i: f"a{i}" for i in range(5)}


def test_structural_query_both_ways(spark):
    rows = [("paris", "capital", "france"), ("rome", "capital", "italy"), ("paris", "river", "seine")]
    t = spark.createDataFrame([(":".join(x), *x) for x in rows], "id string, s string, r string, o string")
    names = sorted({n for x in rows for n in x})
    atoms = spark.createDataFrame([(n,) for n in names], "id string").withColumn("hv", H.atom_udf(4096)(F.col("id")))
    c = meaning.compose_triples(t, atoms, 4096).select("id", "hv")
    q = spark.createDataFrame([(0, "paris", "capital")], "query_id int, subject string, relation string")
    q = q.select("query_id", *[H.atom_udf(4096)(F.col(x)).alias(x) for x in ("subject", "relation")])
    for fan_out in (40, 0):
        got = meaning.structural(q, c, t, atoms, A.idf(c, 4096), A.idf(atoms, 4096), ["subject", "relation"], "object", 4096, fan_out=fan_out)
        assert got.orderBy(F.desc(F.round("confidence", 6)), F.desc("score")).first().entity == "france"


def test_graph_and_plans(spark):
    e = spark.createDataFrame([("a", "t", "b", 0.0, 0.0), ("b", "t", "c", 0.0, 0.0), ("x", "u", "y", 1000.0, 2000.0), ("x", "u", "z", 2001.0, 0.0)], "source string, type string, target string, valid_from double, valid_to double")
    types = spark.createDataFrame([("t", True, False)], "name string, transitive boolean, symmetric boolean")
    start = lambda x: spark.createDataFrame([(x,)], "start string")
    got = {(tuple(r.path), r.inferred) for r in graph.traverse(e, start("a"), 3, "t", 0, types).collect()}
    assert got == {(("a", "b"), False), (("a", "b", "c"), False), (("a", "c"), True)}
    assert [sorted(r.target for r in graph.outgoing(e, "x", None, t).collect()) for t in (0, 1500, 3000)] == [["z"], ["y"], ["z"]]
    t = spark.createDataFrame([("b", "causes", "a"), ("c", "causes", "a"), ("d", "causes", "b")], "s string, r string, o string")
    steps = agency.plan(t, spark.createDataFrame([("a",)], "goal string"), ["causes"], 3)
    assert {r.subject: (r.depth, round(r.cost, 3)) for r in steps.collect()} == {"b": (1, 0.333), "c": (1, 0.333), "d": (2, 0.5)}
    assert agency.complete(steps, t).first().complete
    hops = spark.createDataFrame([("a", "f", "b"), ("a", "f", "c"), ("b", "f", "d"), ("c", "f", "d")], "s string, r string, o string")
    ends = meaning.chain(hops, start("a"), ["f", "f"]).collect()
    assert [(r.node, round(r.confidence, 6)) for r in ends] == [("d", 0.572756)] * 2
    u = agency.utility(spark.createDataFrame([("g", 0.8, 0.5, 2.0, True)], "name string, relevance double, urgency double, cost double, active boolean")).first().utility
    assert u == pytest.approx(0.004)


def test_metrics_agree_and_sentences_come_apart(spark):
    texts = ["Hello, yes world! The gym.", "", "y Yy 1yes don't é ééa!", "no marks here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[c.alias(n) for n, c in T.metrics_columns(F.col("t")).items()]).collect()
    for r in rows:
        assert tuple(r)[1:] == T.metrics_of(r.t), r.t
    assert T.metrics_of("日本 x")[:3] == (3, 0, 2)
    assert T.decompose("The book was written by John.") == [("John", "write", "book")]
    assert T.decompose("Mary and Tom visited Rome in May; Paris is a city") == [("Mary", "visit", "Rome in May"), ("Tom", "visit", "Rome in May"), ("Paris", "is_a", "city")]
    assert T.decompose(None) == [] and T.lemma("running") == "run" and T.lemma("carries") == "carry"


def test_signatures_and_trees(spark):
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = P.sign(key, b"")
    assert P.public_key(key) == public and signature.hex().startswith("e5564300c360ac729086e2cc806e828a")
    assert P.verify(public, b"", signature) and not P.verify(public, b"x", signature)
    assert P.key_of_did(P.did_key(public)) == public
    record = P.fact_record("a", "b", "c", 1, key)
    assert all(ok for _, ok in P.check_record(record, "a", "b", "c", {record["issuer"]}))
    assert not all(ok for _, ok in P.check_record(record | {"sequence": 2}, "a", "b", "c"))
    leaves = spark.createDataFrame([("t", i) for i in range(7)], "tree string, seq int").withColumn("hash", F.sha2(F.col("seq").cast("string"), 256))
    tree = P.merkle_tree(leaves, "tree")
    root = P.merkle_root(leaves, "tree").first().root
    hashes = [r.hash for r in leaves.orderBy("seq").collect()]
    for i in range(7):
        proof = [(p.sibling_is_left, p.hash) for p in P.merkle_proof(tree, "tree", i).first().proof]
        assert P.proves(root, hashes[i], proof) and not P.proves(root, hashes[i - 1], proof)
    k = P.derive_key("secret", b"salt")
    assert one(spark, x=P.decrypt(P.encrypt(F.lit("text"), F.lit(bytearray(k))), F.lit(bytearray(k))).cast("string")).x == "text"
    made = P.encrypt(F.lit("text"), F.lit(bytearray(k)), "for a")
    assert one(spark, x=P.decrypt(made, F.lit(bytearray(k)), "for a").cast("string")).x == "text"
    with pytest.raises(Exception):
        one(spark, x=P.decrypt(made, F.lit(bytearray(k)), "for b"))


def test_plastic_field_strengthens_only_what_is_there():
    f = folds.PlasticField(4096)
    f.apply("store", "a", "r", "b")
    assert f.apply("query", "a", "r", "b") > 0.9 and f.score(f.edge("a", "r", "b")) > 2.5
    before = f.field.copy()
    f.apply("query", "x", "r", "y")
    assert (f.field == before).all()
    for _ in range(20):
        f.apply("query", "a", "r", "b")
    assert f.reads == 5


def test_plastic_stream_equals_the_batch_fold(spark, tmp_path):
    rows = [(i % 3, i, "store" if i % 4 == 0 else "query", f"s{i % 5}", "r", "o") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, seq long, op string, s string, r string, o string")
    want = sorted(tuple(r) for r in folds.plastic_fold(df, "k", 1024).collect())
    for lo in (0, 30):
        df.where(f"seq >= {lo} and seq < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.plastic_stream(stream, "k", 1024).writeStream.format("memory").queryName("plastic").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("plastic").collect()) == want


def test_factors_are_found(spark):
    m = H.seeded(np.arange(8, dtype=np.uint64), 4096)
    books = [[(f"f{k}{i}", m[4 * k + i].tolist()) for i in range(4)] for k in range(2)]
    product = sorted(set(m[2].tolist()) ^ set(m[5].tolist()))
    r = factor.factorise(spark.createDataFrame([(0, product)], "id int, hv array<int>"), books, 4096).first()
    assert (r.factors, r.distance) == (["f02", "f11"], 0)
    rng = np.random.default_rng(3)
    phases = [rng.integers(0, 16, (6, 512)) for _ in range(3)]
    p = (phases[0][1] + phases[1][4] + phases[2][2]) % 16
    assert factor.resonate(spark.createDataFrame([(0, p.tolist())], "id int, phases array<int>"), phases, 16).first().factors == [1, 4, 2]


def test_concepts_and_lists(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(3):
        base = rng.choice(4096, 16, False)
        rows += [(f"c{c}-{i}", sorted(set(base.tolist()) - {int(base[i])} | {int(rng.integers(4096))})) for i in range(6)]
    v = spark.createDataFrame(rows, "id string, hv array<int>")
    members, report = factor.concepts(v, 4096)
    assert sorted((r.centre, r.members, r.stable) for r in report.collect()) == [(f"c{c}-0", 6, True) for c in range(3)]
    q = v.withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in R.top_k(q, v, 5).collect()}
    found = {(r.query_id, r.id) for r in factor.search_lists(q, v, factor.train_lists(v, 4096, 18, 4), 5, 2).collect()}
    assert len(exact & found) > 0.9 * len(exact)


def test_codes_and_walks(spark):
    from hvspark.operators import quantise as Q

    rng = np.random.default_rng(4)
    base = H.seeded(np.arange(20, dtype=np.uint64), 4096)
    rows = [(i, sorted({*rng.choice(base[i % 20], 13, False).tolist(), *rng.integers(0, 4096, 3).tolist()})) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, hv array<int>")
    q = v.where("id < 20").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in R.top_k(q, v, 3).collect()}
    book = Q.train_codes(v, 4096, 16, 32)
    found = Q.search_codes(q, Q.encode_codes(v, book, 4096), book, 4096, 6).collect()
    assert len({(r.query_id, r.id) for r in found} & exact) > 0.6 * len(exact)
    graph_ = Q.neighbour_graph(v, 8)
    for shards in (1, 3):
        walked = {(r.query_id, r.id) for r in Q.walk(q, graph_, 3, 32, shards).collect()}
        assert len(walked & exact) > 0.9 * len(exact)


def test_analogies(spark):
    from hvspark.operators import cognition as C

    rows = [(f"{s}{a}", r, f"{s}{b}") for s in "xy" for a, r, b in ((1, "orbits", 0), (2, "orbits", 0), (0, "heats", 1), (0, "heats", 2))] + [("p", "likes", "q")]
    got = C.analogies(spark.createDataFrame(rows, "s string, r string, o string")).collect()
    assert [(r.root_a, r.root_b, r.mapped, r.score, r.edges) for r in got] == [("x0", "y0", 3, 1.0, 1.0)]


def test_upkeep(spark):
    from hvspark.operators import cognition as C

    c = spark.createDataFrame([(i, f"c{i}", x) for i, x in enumerate(([1, 2, 3], [1, 2, 3], [7, 8], [1, 2, 3]))], "seq int, id string, hv array<int>")
    assert sorted(r.id for r in C.duplicates(c).collect()) == ["c1", "c3"]
    t = spark.createDataFrame([("a", f"r{i}", f"o{i}") for i in range(3)] + [("b", f"r{i}", f"o{i}") for i in range(3)] + [("c", f"r{i}", "o0") for i in range(3)], "s string, r string, o string")
    atoms = t.select(F.explode(F.array("s", "r", "o")).alias("id")).distinct().withColumn("hv", H.atom_udf(4096)(F.col("id")))
    assert {r.id for r in C.refine(t, atoms, 4096).collect()} == {"a", "b", "c"}
    assert all(len(r.hv) <= 16 for r in C.refine(t, atoms, 4096).collect())


def test_routes():
    assert [router.route(n, 64, 16384, 10).kind for n in (10, 5000, 50_000)] == ["scan", "attend", "overlap"]
    assert router.route(50_000, 600, 16384, 10, lists=True).kind == "lists"
    assert (router.route(10, 1, 64, 100).beam, router.route(10, 1, 64, 100).probes) == (200, 12)


def test_heavy_overlaps_are_those_of_the_whole_join(spark):
    v = spark.createDataFrame([(i, sorted({0, 1, 10 + i % 7, 30 + i % 11, 50 + i})) for i in range(60)], "id long, hv array<int>")
    q = v.withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(100, [0, 1]), (101, []), (102, [999])], "query_id long, hv array<int>"))
    weights = A.idf(v, 1024)
    scores = {}
    for r in R.weighted_overlap(q, v, weights).collect():
        scores.setdefault(r.query_id, {})[r.id] = r.score
    want = {(a, b): s for a, of in scores.items() for b, s in of.items() if s > 0.3 * max(of.values())}
    got = {(r.query_id, r.id): r.score for r in R.heavy_overlap(q, v, weights, 0.3, 8).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got)


def test_a_router_gives_the_same_rows_either_way(spark, monkeypatch):
    v = spark.createDataFrame([(i, sorted({i, i + 1, 50 + i % 3})) for i in range(20)] + [(99, [])], "id long, hv array<int>")
    q = v.withColumnRenamed("id", "query_id")
    rows = []
    for below in (1000, 0):
        monkeypatch.setattr(router, "SCAN_BELOW", below)
        rows.append(sorted(map(tuple, router.search(q, v, 64, 15).collect())))
    assert rows[0] == rows[1] and rows[0]


def test_store_keeps_its_order(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4096)
    s.memorize(spark.range(0, 5000, 1, 4).select((F.col("id") % 2500).alias("id"), F.array(F.col("id").cast("int")).alias("hv")))
    assert s.log("vectors").select("seq").distinct().count() == 5000
    assert s.vectors.where("hv[0] <> cast(id as int) + 2500").count() == 0
    relation = spark.createDataFrame([("a", "t", "b")], "source string, type string, target string")
    s.remove_relations(relation)
    s.add_relations(relation)
    assert s.relations.count() == 1


def test_a_commit_that_ends_after_a_compaction_counts_in_its_place(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4096)
    row = lambda i, x: spark.createDataFrame([(i, [x])], "id string, hv array<int>")
    s.memorize(row("a", 1))
    s.memorize(row("b", 1))
    late = sorted(s._names("vectors"))[1]
    mark = tmp_path / "s" / "vectors" / late / "_SUCCESS"
    mark.unlink()
    s.memorize(row("c", 1))
    s.delete(spark.createDataFrame([("c",)], "id string"))
    s.memorize(row("a", 2))
    s.compact()
    assert {r.id: r.hv for r in s.vectors.collect()} == {"a": [2]}
    mark.touch()
    assert {r.id: r.hv for r in s.vectors.collect()} == {"a": [2], "b": [1]}
    s.compact()
    assert {r.id: r.hv for r in s.vectors.collect()} == {"a": [2], "b": [1]}


def test_store_and_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), 4096)
    m.memorize_batch([("a", "the cat sat on the mat"), ("b", "stocks fell sharply today")])
    m.memorize_text("c", "the cat sat on the rug")
    m.memorize_text("b", "the dog sat on the log")
    assert m.vector_count() == 3
    assert [r.id for r in m.query("the cat sat on the mat", 2).collect()] == ["a", "c"]
    assert m.delete("c") and not m.delete("zzz")
    m.compact()
    assert m.vector_count() == 2 and m.audit_since(0).where("op = 'delete'").count() == 1
    m.memorize_sequence("s", ["one", "two", "three"])
    assert m.query_sequence(["one", "two", "three"], 1).first().id == "s"
    m.memorize_scalar("n", 5.0, 0.0, 10.0)
    assert m.query_scalar(5.0, 0.0, 10.0, 1).first().id == "n"
    for f in (("paris", "capital", "france"), ("rome", "capital", "italy"), ("france", "in", "europe")):
        m.memorize_fact(*f)
    assert m.multi_hop_query("paris", ["capital", "in"]).first().node == "europe"
    assert m.structural_query({"subject": "rome", "relation": "capital"}, "object").orderBy(F.desc("score")).first().entity == "italy"
    m.add_relation("x", "t", "y")
    m.add_relation("y", "t", "z")
    m.declare_relation_type("t", transitive=True)
    assert m.relation_count() == 2 and m.traverse("x", "t").count() == 3
    assert m.remove_relation("y", "t", "z") and not m.remove_relation("y", "t", "z") and m.relation_count() == 1
    m.add_goal("g", "d", 0.5, 0.5, 0.1)
    assert m.active_goals().count() == 1 and m.deactivate_goal("g") and m.active_goal_count() == 0
    p = m.propose_rule("r", ["a", "b"], "c", "why")
    assert m.approve_proposal(p) and not m.reject_proposal(p) and m.pending_proposals() == [] and m.apply_approved() == 1
    other = Memory(spark, str(tmp_path / "o"), 4096)
    other.memorize_text("far", "the cat sat on the mat")
    assert {r.id for r in m.federated_query([str(tmp_path / "o"), str(tmp_path / "nowhere")], "the cat sat on the mat", 2).collect()} == {"a", "far"}
    assert Store(spark, str(tmp_path / "m"), 4096).vectors.count() == m.vector_count()
    with pytest.raises(Exception):
        m.memorize_text_buffer("bad", b"\xff\xfe")
    assert math.isclose(m.calculate_readability({"words": 10, "sentences": 2, "syllables": 15}), 206.835 - 5.075 - 126.9)
