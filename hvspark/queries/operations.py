"""Queries on change logs, streams of events, text, provenance and other kinds of vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark import provenance as P
from hvspark.functions import substrates as S
from hvspark.functions import text as T
from hvspark.operators import aggregate as A
from hvspark.operators import meaning as M
from hvspark.operators import retrieve as R
from hvspark.queries.vectors import BASKETS, TOP10, baskets
from hvspark.sources.store import Store
from hvspark.sources.tables import load, shared_root
from hvspark.streaming import folds

_OPS = "case event_id % 5 when 0 then 'store' else 'query' end"


def change_log(spark, sf_dir):
    """Events as versions of their users: the last one counts, and a refund deletes."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value", (F.pmod("event_id", F.lit(11)) == 0).alias("deleted"))


def latest_wins(spark, sf_dir):
    return M.latest(change_log(spark, sf_dir)).select("id", "seq", "value")


def audit_since(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("id_hash"))


def _store(spark, sf_dir):
    """A store of all order lines: odd lines in one commit, even ones in the next, each in the order of its keys; so ids come many times in each."""
    store = Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}", 1_000_000)
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.array(F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")).alias("hv"), "l_orderkey", "l_linenumber")
    for rest in (1, 0):
        store.memorize(lines.where(F.pmod("l_linenumber", F.lit(2)) == rest).orderBy("l_orderkey", "hv").select("id", "hv"))
    return store


def _rows(store):
    return store.vectors.select("id", F.array_join("hv", ",").alias("hv"))


def store_latest(spark, sf_dir):
    return _rows(_store(spark, sf_dir))


def store_compacted(spark, sf_dir):
    """The same without returned orders, compacted, and with more written after."""
    store = _store(spark, sf_dir)
    orders = load(spark, sf_dir, "orders")
    store.delete(orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))
    store.compact()
    store.memorize(orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.array(F.lit(0)).alias("hv")))
    store.compact()
    return _rows(store)


def store_relations(spark, sf_dir):
    """Relations of suppliers and parts, removed once for each of the first lines of an order; removals of what isn't there do nothing."""
    store = Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}", 1_000_000)
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("target"), "l_linenumber")
    store.remove_relations(lines.where("l_linenumber = 2"))
    store.add_relations(lines)
    store.remove_relations(lines.where("l_linenumber = 1"))
    store.compact()
    return store.relations.groupBy("source", "type", "target").agg(F.count("*").alias("n"))


def federated_orders(spark, sf_dir):
    b = baskets(spark, sf_dir)
    q = b.withColumnRenamed("id", "query_id")
    return R.federated(q, [b.where("id % 2 = 0"), b.where("id % 3 = 0"), b.where("id % 6 in (1, 5)")], 5)


def windowed_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return folds.windowed_counts(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def session_events(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return folds.sessions(e).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def order_items(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("seq")).join(baskets(spark, sf_dir), "id")


def sliding_unions(spark, sf_dir):
    w = folds.sliding_union(order_items(spark, sf_dir), "customer", 3)
    return w.select("id", F.array_join("window", ",").alias("held"))


def decayed_counts(spark, sf_dir):
    return folds.decayed_counts(order_items(spark, sf_dir), "customer", 0.5, 4000).select("customer", "idx", F.round("weight", 9).alias("weight"))


def spread_unions(spark, sf_dir):
    return folds.spread(order_items(spark, sf_dir), "customer", 3).select("customer", F.col("bundle").cast("int").alias("bundle"), "members", F.array_join("hv", ",").alias("hv"))


def cascaded_unions(spark, sf_dir):
    return folds.cascade(order_items(spark, sf_dir), "customer", 4).select("customer", "bundle", "members", F.array_join("hv", ",").alias("hv"))


def tiered_unions(spark, sf_dir):
    return folds.tiered(order_items(spark, sf_dir), "customer", 2).select("customer", "tier", F.array_join("hv", ",").alias("hv"))


def reservoir_sample(spark, sf_dir):
    return folds.reservoir(order_items(spark, sf_dir), "customer", 3).groupBy("customer").agg(F.count("*").alias("n"))


def count_read_outs(spark, sf_dir):
    b = baskets(spark, sf_dir)
    r = folds.read_outs(b, b)
    return r.select("id", "total", *[F.round(c, 6).alias(c) for c in ("logged", "cosine", "rare")])


def phase_store(spark, sf_dir):
    """How well each nation's place is held by the store of all of them, by phases."""
    c = load(spark, sf_dir, "nation")
    phases = lambda k: F.transform(F.sequence(F.lit(1), F.lit(32)), lambda d: F.pmod(F.xxhash64(k, d), F.lit(16)).cast("int"))
    t = c.select(F.col("n_name").alias("s"), F.lit("in").alias("r"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    names = t.select(F.explode(F.array("s", "r", "o")).alias("id")).distinct().withColumn("phases", phases("id"))
    trace = S.phase_trace(t, names, 16)
    p = {x: names.select(F.col("id").alias(x), F.col("phases").alias(f"_{x}")) for x in "sro"}
    asked = t.join(p["s"], "s").join(p["r"], "r").join(p["o"], "o").select(F.col("s").alias("query_id"), S.phase_bind(S.phase_bind(F.col("_s"), F.col("_r"), 16), F.col("_o"), 16).alias("phases"))
    return S.phase_score(asked, trace, 16, 32)


def plastic_scores(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("event_id").alias("seq"), F.expr(_OPS).alias("op"), F.concat(F.lit("u"), "user_id").alias("s"), F.lit("did").alias("r"), F.col("event_type").alias("o"))
    return folds.plastic_fold(rows, "user_id", 1024)


def two_stores(spark, sf_dir):
    return folds.consolidate(order_items(spark, sf_dir), "customer", 32768, every=5)


def text_readability(spark, sf_dir):
    m = T.metrics_columns(F.col("text"))
    d = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", *[c.alias(n) for n, c in m.items()])
    return d.withColumn("ease", F.round(T.readability(F.col("words"), F.col("sentences"), F.col("syllables")), 6))


def text_metrics(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.text_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


def facts_of_text(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.units(F.col("text"))).alias("nth", "u")).select("item_id", "nth", "u.*")


def chain_of_events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.concat_ws("|", "event_id", "event_type").alias("line"))
    w = W.partitionBy("log").orderBy("seq")
    linked = e.withColumn("prev_hash", F.coalesce(F.lag(F.sha2("line", 256)).over(w), F.lit("")))
    broken = linked.withColumn("prev_hash", F.when(F.pmod("seq", F.lit(997)) == 0, "x").otherwise(F.col("prev_hash")))
    return P.verify_chain(broken, "log")


def merkle_roots(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("tree"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    return P.merkle_levels(e, "tree").where("level = 1").select("tree", "pos", "hash")


def merkle_root(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("tree"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    return P.merkle_root(e, "tree")


def revoked_ids(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    marks = e.where("event_type = 'purchase'").select(F.col("user_id").alias("status"))
    return P.revoked(e.select(F.col("user_id").alias("status")).distinct(), marks)


def _codes(spark, sf_dir):
    """Codes of 8 blocks of 16 slots, by order."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda b: F.pmod(F.col("o_orderkey") * b + F.col("o_custkey"), F.lit(16)).cast("int")).alias("code"))


def _code_pairs(spark, sf_dir):
    w = W.partitionBy("customer").orderBy("id")
    return _codes(spark, sf_dir).withColumn("b", F.lag("code").over(w)).where("b is not null")


def block_codes(spark, sf_dir):
    a, b = F.col("code"), F.col("b")
    bound = S.block_bind(a, b, 16)
    return _code_pairs(spark, sf_dir).select("id", F.array_join(bound, ",").alias("bound"), (S.block_unbind(bound, b, 16) == a).alias("undone"), S.block_similarity(a, b).alias("similarity"), F.array_join(S.block_indices(a, 16), ",").alias("indices"))


def block_bundles(spark, sf_dir):
    return S.block_bundle(_codes(spark, sf_dir), "customer", "code").select("customer", F.array_join("code", ",").alias("code"))


def phase_similarity(spark, sf_dir):
    return _code_pairs(spark, sf_dir).select("id", F.round(S.phase_similarity(F.col("code"), F.col("b"), 16), 6).alias("similarity"))


def phase_bundles(spark, sf_dir):
    return S.phase_bundle(_codes(spark, sf_dir), "customer", "code", 16).select("customer", F.size("code").alias("places"))


def _signed(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return b.select("id", S.ternary(F.col("hv"), F.transform("hv", lambda x: x % 2 == 0)).alias("t"))


def ternary_vectors(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    w = W.partitionBy("customer").orderBy("id")
    p = _signed(spark, sf_dir).join(orders, "id").withColumn("b", F.lag("t").over(w)).where("b is not null")
    show = lambda t: F.array_join(F.transform(t, lambda e: e.idx * e.sign), ",")
    return p.select("id", show(S.ternary_bind(F.col("t"), F.col("b"))).alias("bound"), F.round(S.ternary_similarity(F.col("t"), F.col("b")), 9).alias("similarity"))


def ternary_bundles(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    t = _signed(spark, sf_dir).join(orders, "id")
    return S.ternary_bundle(t, "customer", "t").select("customer", F.array_join(F.transform("t", lambda e: e.idx * e.sign), ",").alias("t"))


def separation_auc(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return A.auc(d.select(F.col("n_chars"), (F.col("quality") == 1).alias("good")), "n_chars", "good").select(F.round("auc", 9).alias("auc"))


QUERIES = {f.__name__: f for f in (latest_wins, audit_since, store_latest, store_compacted, store_relations, federated_orders, windowed_events, session_events, sliding_unions, decayed_counts, spread_unions, cascaded_unions, tiered_unions, reservoir_sample, count_read_outs, phase_store, plastic_scores, two_stores, text_readability, text_metrics, facts_of_text, chain_of_events, merkle_roots, merkle_root, revoked_ids, block_codes, block_bundles, phase_similarity, phase_bundles, ternary_vectors, ternary_bundles, separation_auc)}
_E = r" \t\n\r.!?,;:()\[\]{}\"''\-"
_L = r"A-Za-z\x{80}-\x{10FFFF}"
_CODES = "codes as (select o_orderkey as id, o_custkey as customer, list_transform(range(1, 9), lambda b: (o_orderkey * b + o_custkey) % 16) as code from orders), pairs as (select id, code as a, lag(code) over (partition by customer order by id) as b from codes qualify b is not null)"
_ITEMS = f"{BASKETS}, items as (select o_custkey as customer, id, unnest(hv) as idx from baskets join orders on o_orderkey = id)"
_SIGNED = f"{BASKETS}, t as (select id, o_custkey as customer, hv from baskets join orders on o_orderkey = id)"
_LAST = "last as (select l_orderkey as id, max_by(l_linenumber || ',' || l_partkey, (1 - l_linenumber % 2, l_linenumber, l_partkey)) as hv from lineitem group by 1)"
ORACLES = {
    "store_latest": f"with {_LAST} select cast(id as varchar) as id, hv from last",
    "store_compacted": f"""with {_LAST} select cast(o_orderkey as varchar) as id, case when o_orderkey % 10 = 0 then '0' else hv end as hv
        from orders left join last on id = o_orderkey where o_orderkey % 10 = 0 or (o_orderstatus <> 'F' and hv is not null)
        union all select cast(id as varchar), hv from last where id not in (select o_orderkey from orders)""",
    "store_relations": "select cast(l_suppkey as varchar) as source, l_returnflag as type, l_linestatus as target, count(*) - count(*) filter (where l_linenumber = 1) as n from lineitem group by 1, 2, 3 having n > 0",
    "latest_wins": "select user_id as id, event_id as seq, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_id % 11 <> 0",
    "audit_since": "select event_id, sha256(cast(user_id as varchar)) as id_hash from events where ts >= timestamp '2024-01-20'",
    "federated_orders": f"with {BASKETS}, {TOP10} select query_id, rank, id, similarity from top where rank <= 5",
    "windowed_events": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "session_events": """with g as (select user_id, ts, case when ts <= lag(ts) over w + interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as nth from g)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, nth""",
    "sliding_unions": f"""with {_ITEMS}, n as (select customer, id, row_number() over (partition by customer order by id) as k from (select distinct customer, id from items))
        select a.id, string_agg(distinct i.idx, ',' order by i.idx) as held from n a join n b on b.customer = a.customer and b.k between a.k - 2 and a.k join items i on i.id = b.id group by a.id""",
    "decayed_counts": f"with {_ITEMS}, l as (select customer, max(id) as last from items group by 1) select customer, idx, round(sum(pow(0.5, floor((last - id) / 4000))), 9) as weight from items join l using (customer) group by 1, 2",
    "spread_unions": f"""with {_ITEMS}, n as (select customer, id, cast((row_number() over (partition by customer order by id) - 1) % 3 as integer) as bundle from (select distinct customer, id from items))
        select n.customer, bundle, count(distinct n.id) as members, string_agg(distinct idx, ',' order by idx) as hv from n join items using (id) group by 1, 2""",
    "cascaded_unions": f"""with {_ITEMS}, n as (select customer, id, cast((row_number() over (partition by customer order by id) - 1) // 4 as integer) as bundle from (select distinct customer, id from items))
        select n.customer, bundle, count(distinct n.id) as members, string_agg(distinct idx, ',' order by idx) as hv from n join items using (id) group by 1, 2""",
    "tiered_unions": f"""with {_ITEMS}, n as (select customer, id, case when row_number() over (partition by customer order by id desc) <= 2 then 1 else 2 end as tier from (select distinct customer, id from items))
        select n.customer, tier, string_agg(distinct idx, ',' order by idx) as hv from n join items using (id) group by 1, 2""",
    "reservoir_sample": f"with {_ITEMS} select customer, least(count(distinct id), 3) as n from items group by 1",
    "count_read_outs": f"""with {_ITEMS}, c as (select idx, count(*) as n from items group by 1), w as (select sqrt(sum(n * n)) as norm, (select count(*) from baskets) as stored from c)
        select id, cast(sum(n) as bigint) as total, round(sum(ln(1 + n)), 6) as logged, round(sum(n) / (sqrt(count(*)) * any_value(norm)), 6) as cosine, round(sum(ln(1 + stored / n)), 6) as rare from items join c using (idx), w group by 1""",
    "text_readability": f"""with d as (select doc_id, text, regexp_replace(text, '(^|[{_E}])([^{_E}{_L}]*)[yY]', '\\1\\2b', 'g') as plain from documents where text is not null),
        m as (select doc_id, cast(len(regexp_extract_all(text, '[^{_E}{_L}]*[{_L}][^{_E}]*')) as integer) as words, cast(len(regexp_extract_all(text, '[.!?]')) as integer) as sentences,
          cast(len(regexp_extract_all(plain, '[aeiouyAEIOUY]+')) as integer) as syllables, cast(len(regexp_extract_all(plain, '[aeiouyAEIOUY]')) as integer) as vowels,
          cast(len(regexp_extract_all(plain, '[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]')) as integer) as consonants, cast(len(regexp_extract_all(text, '[.!?,;:()\\[\\]{{}}\\"''\\-]')) as integer) as punctuation from d)
        select *, case when words = 0 or sentences = 0 then 0 else round(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 6) end as ease from m""",
    "chain_of_events": """with e as (select user_id as log, event_id as seq, lag(event_id) over (partition by user_id order by event_id) as before from events)
        select log, count(*) as entries, bool_and(seq % 997 <> 0) as intact, min(seq) filter (where seq % 997 = 0) as first_broken from e group by 1""",
    "merkle_roots": """with h as (select event_type as tree, row_number() over (partition by event_type order by event_id) - 1 as i, sha256(cast(event_id as varchar)) as hash from events)
        select tree, i // 2 as pos, case when count(*) = 1 then any_value(hash) else sha256(unhex(max(hash) filter (where i % 2 = 0)) || unhex(max(hash) filter (where i % 2 = 1))) end as hash from h group by 1, 2""",
    "revoked_ids": "select user_id as status, bool_or(event_type = 'purchase') as revoked from events group by 1",
    "block_codes": f"""with {_CODES} select id, array_to_string(list_transform(range(1, 9), lambda i: (a[i] + b[i]) % 16), ',') as bound, true as undone,
        len(list_filter(range(1, 9), lambda i: a[i] = b[i])) / 8 as similarity, array_to_string(list_transform(range(1, 9), lambda i: (i - 1) * 16 + a[i]), ',') as indices from pairs""",
    "block_bundles": f"""with {_CODES}, v as (select customer, unnest(range(1, 9)) as block, unnest(code) as slot from codes), b as (select customer, block, slot from v group by 1, 2, 3 qualify row_number() over (partition by customer, block order by count(*) desc, slot desc) = 1)
        select customer, string_agg(slot, ',' order by block) as code from b group by 1""",
    "phase_similarity": f"with {_CODES} select id, round(list_sum(list_transform(range(1, 9), lambda i: cos((a[i] - b[i]) * 2 * pi() / 16))) / 8, 6) as similarity from pairs",
    "ternary_vectors": f"""with {_SIGNED}, p as (select id, hv as a, lag(hv) over (partition by customer order by id) as b from t qualify b is not null),
        s as (select id, list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))) as x, len(list_intersect(a, b)) as c, len(a) as na, len(b) as nb from p)
        select id, array_to_string(list_transform(x, lambda i: case when i % 2 = 0 then -i else i end), ',') as bound, round(c / sqrt(na * nb), 9) as similarity from s""",
    "ternary_bundles": f"""with {_SIGNED}, n as (select customer, count(*) as members from t group by 1), i as (select customer, unnest(hv) as idx from t), k as (select customer, idx from i join n using (customer) group by customer, idx, members having count(*) >= ceil(members / 2))
        select customer, coalesce(string_agg(case when idx % 2 = 0 then -idx else idx end, ',' order by idx), '') as t from n left join k using (customer) group by 1""",
    "separation_auc": """with d as (select n_chars as x, quality = 1 as good from documents join labels using (doc_id)), g as (select x, count(*) filter (where good) as p, count(*) filter (where not good) as n from d group by 1),
        c as (select *, coalesce(sum(n) over (order by x rows between unbounded preceding and 1 preceding), 0) as below from g) select round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) as auc from c""",
}
