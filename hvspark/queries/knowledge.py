"""Queries on triples, relations, goals and chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.operators import agency as G
from hvspark.operators import cognition as C
from hvspark.operators import graph as H
from hvspark.operators import meaning as M
from hvspark.sources.tables import load

_PARTS = (
    ("nation", "'n' || n_nationkey", "in", "'r' || n_regionkey"),
    ("customer", "'c' || c_custkey", "in", "'n' || c_nationkey"),
    ("customer", "'c' || c_custkey", "segment", "c_mktsegment"),
    ("supplier", "'s' || s_suppkey", "in", "'n' || s_nationkey"),
    ("part", "'p' || p_partkey", "brand", "p_brand"),
    ("part", "'p' || p_partkey", "type", "p_type"),
    ("documents", "'d' || doc_id", "lang", "lang"),
    ("documents", "'d' || doc_id", "source", "source"),
    ("labels", "'d' || doc_id", "quality", "'q' || quality"),
)
TRIPLES = "triples as (" + " union all ".join(f"select {s} as s, '{r}' as r, {o} as o from {t}" for t, s, r, o in _PARTS) + ")"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (load(spark, sf_dir, t).select(F.expr(s).alias("s"), F.lit(r).alias("r"), F.expr(o).alias("o")) for t, s, r, o in _PARTS))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders from their day on, closed ones for 30 days, and where nations lie."""
    o = load(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double")
    timed = o.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.lit("ordered").alias("type"), F.concat(F.lit("o"), "o_orderkey").alias("target"), ms.alias("valid_from"), F.when(F.col("o_orderstatus") == "F", ms + 2592000000).otherwise(0.0).alias("valid_to"))
    placed = triples(spark, sf_dir).where("r = 'in'").select(F.col("s").alias("source"), F.lit("in").alias("type"), F.col("o").alias("target"), F.lit(0.0).alias("valid_from"), F.lit(0.0).alias("valid_to"))
    return timed.unionByName(placed)


RELATIONS = f"""{TRIPLES}, relations as (
  select 'c' || o_custkey as source, 'ordered' as type, 'o' || o_orderkey as target, cast(epoch_ms(o_orderdate) as double) as valid_from,
    case when o_orderstatus = 'F' then epoch_ms(o_orderdate) + 2592000000.0 else 0 end as valid_to from orders
  union all select s, 'in', o, 0, 0 from triples where r = 'in')"""
TIME = 852076800000  #: the first of 1997


def triple_pattern(spark, sf_dir):
    return M.match(triples(spark, sf_dir), r="in", o="n5").select("s", "r", "o")


def relation_patterns(spark, sf_dir):
    return C.patterns(triples(spark, sf_dir)).select("r", "frequency", F.size("subjects").alias("subjects"), F.array_join("objects", ",").alias("objects"))


def co_occurring(spark, sf_dir):
    return C.co_occurrence(triples(spark, sf_dir)).select(F.array_join("relations_a", ",").alias("relations_a"), F.array_join("relations_b", ",").alias("relations_b"), "n_a", "n_b", "shared")


def knowledge_gaps(spark, sf_dir):
    return C.gaps(triples(spark, sf_dir), 2, 0.3)


def gap_questions(spark, sf_dir):
    return G.gap_questions(knowledge_gaps(spark, sf_dir)).select("s", "r", "question")


def multi_hop(spark, sf_dir):
    t = triples(spark, sf_dir)
    starts = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return M.chain(t, starts, ["in", "in"]).select("start", "node", F.round("confidence", 9).alias("confidence"), F.array_join("path", ">").alias("path"))


def rule_hop(spark, sf_dir):
    """Two relations that a rule turns into one."""
    t = triples(spark, sf_dir)
    starts = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("start"))
    rules = spark.createDataFrame([(1, ["brand", "of"], "type"), (2, ["brand", "of"], "brand")], "seq int, inputs array<string>, output string")
    return M.chain(t, starts, ["brand", "of"], M.rules_table(rules)).select("start", "node", "confidence")


def outgoing_now(spark, sf_dir):
    r = relations(spark, sf_dir)
    return r.where(H.valid_at(0)).groupBy("type").agg(F.count("*").alias("open"))


def edges_at_time(spark, sf_dir):
    return relations(spark, sf_dir).where(H.valid_at(TIME)).select("source", "type", "target")


def incoming_edges(spark, sf_dir):
    return H.incoming(relations(spark, sf_dir), "n7", "in").select("source", "target")


def traverse_regions(spark, sf_dir):
    """What lies in what, from every customer."""
    starts = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    types = spark.createDataFrame([("in", True, False)], "name string, transitive boolean, symmetric boolean")
    return H.traverse(relations(spark, sf_dir), starts, 3, "in", 0, types).select("start", "node", "depth", F.array_join("path", ">").alias("path"), "score", "inferred")


def connected_places(spark, sf_dir):
    t = triples(spark, sf_dir).where("r = 'in'")
    return H.components(t.select(F.col("s").alias("u"), F.col("o").alias("v")))


def goal_utility(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    goals = c.select(F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000).alias("relevance"), (F.pmod("c_custkey", F.lit(10)) / 10).alias("urgency"), (F.pmod("c_custkey", F.lit(7)) / 5).alias("cost"), (F.col("c_mktsegment") != "BUILDING").alias("active"))
    return G.utility(goals).select("name", F.round("utility", 9).alias("utility"))


def plan_backward(spark, sf_dir):
    t = triples(spark, sf_dir)
    goals = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("goal"))
    return G.plan(t, goals, ["in"], 2).select("goal", "subject", "relation", "object", "depth", F.round("cost", 9).alias("cost"))


def unreferenced_atoms(spark, sf_dir):
    t = triples(spark, sf_dir).where("r <> 'segment' and o <> 'n3'")
    atoms = triples(spark, sf_dir).select(F.explode(F.array("s", "r", "o")).alias("id")).distinct()
    return C.unreferenced(atoms, t)


def stale_composites(spark, sf_dir):
    t = triples(spark, sf_dir).withColumn("id", F.concat_ws(":", "s", "r", "o"))
    return C.stale(t.select("id"), t.where("r <> 'brand'"))


def proposal_states(spark, sf_dir):
    ops = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.element_at(F.array(*map(F.lit, ("propose", "approve", "reject", "apply"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("op"))
    return G.proposals(ops)


QUERIES = {
    "triple_pattern": triple_pattern,
    "relation_patterns": relation_patterns,
    "co_occurrence": co_occurring,
    "knowledge_gaps": knowledge_gaps,
    "gap_questions": gap_questions,
    "multi_hop_chain": multi_hop,
    "rule_hop": rule_hop,
    "open_relations": outgoing_now,
    "edges_at_time": edges_at_time,
    "incoming_edges": incoming_edges,
    "traverse": traverse_regions,
    "connected_components": connected_places,
    "goal_utility": goal_utility,
    "plan_backward": plan_backward,
    "unreferenced_atoms": unreferenced_atoms,
    "stale_composites": stale_composites,
    "proposal_states": proposal_states,
}
_KINDS = f"{TRIPLES}, who as (select s, list_sort(list_distinct(list(r))) as rel from triples group by 1), kinds as (select rel, count(*) as n from who group by 1)"
_GAPS = f"""with {_KINDS}, peers as (select a.rel, b.rel as theirs, case when a.rel = b.rel then b.n - 1 else b.n end as m from kinds a join kinds b on len(list_intersect(a.rel, b.rel)) >= 2),
  total as (select rel, sum(m) as peers from peers where m > 0 group by 1),
  have as (select rel, r, sum(m) as have from (select rel, theirs, m, unnest(theirs) as r from peers where m > 0) where not list_contains(rel, r) group by 1, 2)"""
ORACLES = {
    "triple_pattern": f"with {TRIPLES} select * from triples where r = 'in' and o = 'n5'",
    "relation_patterns": f"with {TRIPLES} select r, count(*) as frequency, cast(count(distinct s) as integer) as subjects, string_agg(distinct o, ',' order by o) as objects from triples group by 1 having count(*) >= 3",
    "co_occurrence": f"""with {_KINDS} select array_to_string(a.rel, ',') as relations_a, array_to_string(b.rel, ',') as relations_b, a.n as n_a, b.n as n_b, cast(len(list_intersect(a.rel, b.rel)) as integer) as shared
        from kinds a join kinds b on array_to_string(a.rel, chr(1)) <= array_to_string(b.rel, chr(1)) where len(list_intersect(a.rel, b.rel)) >= 2 and (a.rel <> b.rel or a.n > 1)""",
    "knowledge_gaps": f"{_GAPS} select s, r, have / peers as coverage from who join have using (rel) join total using (rel) where have / peers >= 0.3",
    "gap_questions": f"{_GAPS} select s, r, 'What is the ' || r || ' of ' || s || '?' as question from who join have using (rel) join total using (rel) where have / peers >= 0.3",
    "multi_hop_chain": """select 'c' || c_custkey as start, 'r' || n_regionkey as node, cast(0.81 as double) as confidence, 'c' || c_custkey || '>n' || n_nationkey || '>r' || n_regionkey as path from customer join nation on c_nationkey = n_nationkey""",
    "rule_hop": "select 'p' || p_partkey as start, p_brand as node, cast(0.9 as double) as confidence from part",
    "open_relations": f"with {RELATIONS} select type, count(*) as open from relations where valid_to = 0 group by 1",
    "edges_at_time": f"with {RELATIONS} select source, type, target from relations where (valid_from = 0 or valid_from <= {TIME}) and (valid_to = 0 or valid_to >= {TIME})",
    "incoming_edges": "select 'c' || c_custkey as source, 'n7' as target from customer where c_nationkey = 7 union all select 's' || s_suppkey, 'n7' from supplier where s_nationkey = 7",
    "traverse": """with hops as (select 'c' || c_custkey as a, 'n' || n_nationkey as b, 'r' || n_regionkey as c from customer join nation on c_nationkey = n_nationkey)
        select a as start, b as node, 1 as depth, a || '>' || b as path, cast(1 as double) as score, false as inferred from hops
        union all select a, c, 2, a || '>' || b || '>' || c, 1, false from hops union all select a, c, 1, a || '>' || c, 1, true from hops""",
    "connected_components": f"""with {TRIPLES}, lies as (select s, o from triples where r = 'in'), up as (select s as node, o as top from lies where o like 'r%' union all select l.s, n.o from lies l join lies n on n.s = l.o union all select distinct o, o from lies where o like 'r%')
        select node, min(node) over (partition by top) as root from up""",
    "goal_utility": "select c_name as name, round(c_acctbal / 10000 * ((c_custkey % 10) / 10) * (1 - least((c_custkey % 7) / 5, 0.99)), 9) as utility from customer where c_mktsegment <> 'BUILDING'",
    "plan_backward": f"""with {TRIPLES}, e as (select distinct s, o from triples where r = 'in'), f as (select o, 1 / (1 + count(*)) as cost from e group by 1)
        select o as goal, s as subject, 'in' as relation, o as object, 1 as depth, round(cost, 9) as cost from e join f using (o) where o like 'r%'
        union all select g.o, e.s, 'in', e.o, 2, round(f.cost, 9) from e join e g on g.s = e.o join f on f.o = e.o where g.o like 'r%'""",
    "unreferenced_atoms": f"with {TRIPLES}, live as (select * from triples where r <> 'segment' and o <> 'n3') select id from (select s as id from triples union select r from triples union select o from triples) where id not in (select s from live union select r from live union select o from live)",
    "stale_composites": f"with {TRIPLES} select s || ':' || r || ':' || o as id from triples where r = 'brand'",
    "proposal_states": """with recursive ops as (select user_id as id, event_id % 4 as op, row_number() over (partition by user_id order by event_id) as n from events),
        run as (select id, n, case when op = 0 then 1 else 0 end as st from ops where n = 1 union all
          select o.id, o.n, case when st = 0 and op = 0 then 1 when st = 1 and op = 1 then 2 when st = 1 and op = 2 then 3 when st = 2 and op = 3 then 4 else st end from run r join ops o on o.id = r.id and o.n = r.n + 1)
        select id, case max_by(st, n) when 1 then 'pending' when 2 then 'approved' when 3 then 'rejected' when 4 then 'applied' end as state from run group by id having max_by(st, n) > 0""",
}
