"""Discovery over triples (s, r, o): patterns, gaps, abstractions, hypotheses, analogies, upkeep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.functions.vectors import active, jaccard
from hvspark.operators import aggregate as A
from hvspark.operators.graph import components
from hvspark.operators.retrieve import cleanup, similar_pairs
from hvspark.sources.tables import checkpointed, if_few


def patterns(triples: DataFrame, least: int = 3) -> DataFrame:
    """(r, frequency, subjects, objects): relations of so many triples at least, with who takes part."""
    return triples.groupBy("r").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("s")).alias("subjects"), F.array_sort(F.collect_set("o")).alias("objects")).where(F.col("frequency") >= least)


def shapes(triples: DataFrame) -> DataFrame:
    """(s, relations): the sorted distinct relations of each subject."""
    return triples.groupBy("s").agg(F.array_sort(F.collect_set("r")).alias("relations"))


def co_occurrence(triples: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared): shapes of subjects with so many relations in common, by the subjects that have them.

    Subjects with the same relations are one row: (relations_a, relations_b, n_a, n_b, shared), so
    that the result grows with the kinds of subjects, of which each pair holds for all members.
    """
    kinds = shapes(triples).groupBy("relations").agg(F.count("*").alias("n"))
    a, b = kinds.select(F.col("relations").alias("relations_a"), F.col("n").alias("n_a")), kinds.select(F.col("relations").alias("relations_b"), F.col("n").alias("n_b"))
    shared = F.size(F.array_intersect("relations_a", "relations_b"))
    pairs = a.join(b, F.array_join("relations_a", "\0") <= F.array_join("relations_b", "\0")).withColumn("shared", shared).where(F.col("shared") >= least)
    return pairs.where((F.col("relations_a") != F.col("relations_b")) | (F.col("n_a") > 1))


def lacking(kinds: DataFrame, shared: int, coverage: float) -> DataFrame:
    """(relations, r, coverage): relations that a kind of subject (relations, n) lacks and that enough of its peers have."""
    b = kinds.select(F.col("relations").alias("theirs"), F.col("n").alias("m"))
    peers = kinds.join(b, F.size(F.array_intersect("relations", "theirs")) >= shared).withColumn("m", F.when(F.col("relations") == F.col("theirs"), F.col("m") - 1).otherwise(F.col("m"))).where("m > 0")
    total = peers.groupBy("relations").agg(F.sum("m").alias("peers"))
    have = peers.select("relations", "m", F.explode(F.array_except("theirs", "relations")).alias("r")).groupBy("relations", "r").agg(F.sum("m").alias("have"))
    return have.join(total, "relations").withColumn("coverage", F.col("have") / F.col("peers")).where(F.col("coverage") >= coverage).select("relations", "r", "coverage")


def gaps(triples: DataFrame, shared: int = 2, coverage: float = 0.5) -> DataFrame:
    """(s, r, coverage): relations that a subject lacks and that enough of its peers have.

    Peers have so many relations in common with it. Counted by kind of subject, not by pair.
    """
    who = shapes(triples)
    kinds = who.groupBy("relations").agg(F.count("*").alias("n"))
    return who.join(lacking(kinds, shared, coverage), "relations").select("s", "r", "coverage")


def abstractions(triples: DataFrame, atoms: DataFrame, dim: int, least: int = 3) -> DataFrame:
    """(concept, members, hv) for each relation and end with so many distinct members."""
    ends = triples.select(F.concat(F.lit("concept:"), "r", F.lit(":subject")).alias("concept"), F.col("s").alias("id")).unionByName(triples.select(F.concat(F.lit("concept:"), "r", F.lit(":object")).alias("concept"), F.col("o").alias("id"))).distinct()
    many = ends.groupBy("concept").count().where(F.col("count") >= least)
    return A.prototype(ends.join(many, "concept", "left_semi").join(atoms, "id"), ["concept"], dim)


def hypotheses(triples: DataFrame, atoms: DataFrame, dim: int, shared: int = 2, coverage: float = 0.5, least: float = 0.3) -> DataFrame:
    """(s, r, o, confidence): for each gap, what the bundle of the peers' objects comes to rest at; the first object if nothing is in half of them."""
    # subjects are read in full for their relations, for the peers' objects and for the result; what is known by kind is small
    who = checkpointed(shapes(triples))
    kinds = checkpointed(who.groupBy("relations").agg(F.count("*").alias("n")))
    wanted = lacking(kinds, shared, coverage).select(F.col("relations").alias("mine"), "r")
    have = kinds.select("relations", F.explode("relations").alias("r"))
    peers = checkpointed(wanted.join(have, "r").where(F.size(F.array_intersect("mine", "relations")) >= shared).select("mine", "r", "relations"))
    theirs = who.join(if_few(checkpointed(peers.select("relations").distinct())), "relations")
    asked = triples.join(if_few(checkpointed(peers.select("r").distinct())), "r")
    fillers = asked.join(theirs, "s").groupBy("relations", "r", "o").agg(F.count("*").alias("n"))
    pool = checkpointed(fillers.join(if_few(peers), ["relations", "r"]).groupBy("mine", "r", "o").agg(F.sum("n").alias("n")))
    known = checkpointed(atoms.join(if_few(checkpointed(pool.select(F.col("o").alias("id")).distinct())), "id").select(F.col("id").alias("o"), "hv"))
    vectors = pool.join(known, "o")
    total = pool.groupBy("mine", "r").agg(F.sum("n").alias("total"), F.min("o").alias("first"))
    counts = vectors.select("mine", "r", "n", F.explode("hv").alias("idx")).groupBy("mine", "r", "idx").agg(F.sum("n").alias("n")).join(total, ["mine", "r"]).where(F.col("n") >= F.ceil(F.col("total") / 2))
    rank = F.row_number().over(W.partitionBy("mine", "r").orderBy(F.desc("n"), "idx"))
    bundled = counts.withColumn("_n", rank).where(F.col("_n") <= active(dim)).groupBy("mine", "r").agg(F.array_sort(F.collect_list("idx")).alias("bundle"))
    first = total.join(known.select(F.col("o").alias("first"), F.col("hv").alias("fallback")), "first")
    probes = checkpointed(first.join(bundled, ["mine", "r"], "left").select(F.struct("mine", "r").alias("query_id"), F.coalesce("bundle", "fallback").alias("hv")))
    best = cleanup(probes, atoms, A.idf(atoms, dim), dim).where(F.col("weight") >= least)
    found = checkpointed(best.select(F.col("query_id.mine").alias("relations"), F.col("query_id.r").alias("r"), F.col("id").alias("o"), F.col("weight").alias("confidence")))
    return who.where("s is not null").join(if_few(found), "relations").select("s", "r", "o", "confidence")


def analogies(triples: DataFrame, shared: int = 2) -> DataFrame:
    """(root_a, root_b, mapped, score, edges): structures that are alike, of the connected parts of the graph.

    Parts that share so many relations are compared; their nodes are mapped one to one, greedily by
    the Jaccard of the relations they have as subject and as object. edges: the share of the
    smaller part's triples that the mapping takes to triples of the other.
    """
    comp = components(triples.select(F.col("s").alias("u"), F.col("o").alias("v")))
    placed = triples.join(comp.withColumnRenamed("node", "s"), "s")
    kinds = placed.groupBy("root").agg(F.collect_set("r").alias("rels"))
    a, b = (kinds.select(F.col("root").alias(f"root_{x}"), F.col("rels").alias(f"rels_{x}")) for x in "ab")
    pairs = a.join(b, (F.col("root_a") < F.col("root_b")) & (F.size(F.array_intersect("rels_a", "rels_b")) >= shared)).select("root_a", "root_b")
    part = placed.groupBy("root").agg(F.collect_list(F.struct("s", "r", "o")).alias("t"))
    both = pairs.join(part.select(F.col("root").alias("root_a"), F.col("t").alias("ta")), "root_a").join(part.select(F.col("root").alias("root_b"), F.col("t").alias("tb")), "root_b")

    def profile(ts):
        out: dict[str, set] = {}
        for t in ts:
            out.setdefault(t["s"], set()).add((t["r"], 0))
            out.setdefault(t["o"], set()).add((t["r"], 1))
        return out

    def compare(batches):
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                pa, pb = profile(x.ta), profile(x.tb)
                cand = sorted(((-len(p & q) / len(p | q), m, n) for m, p in pa.items() for n, q in pb.items() if p & q))
                mapping, used, total = {}, set(), 0.0
                for neg, m, n in cand:
                    if m not in mapping and n not in used:
                        mapping[m] = n
                        used.add(n)
                        total -= neg
                tb = {(t["s"], t["r"], t["o"]) for t in x.tb}
                kept = sum((mapping.get(t["s"]), t["r"], mapping.get(t["o"])) in tb for t in x.ta)
                rows.append((x.root_a, x.root_b, len(mapping), total / len(mapping) if mapping else 0.0, kept / max(1, min(len(x.ta), len(x.tb)))))
            yield pd.DataFrame(rows, columns=["root_a", "root_b", "mapped", "score", "edges"])

    return both.mapInPandas(compare, "root_a string, root_b string, mapped int, score double, edges double")


def duplicates(composites: DataFrame, least: float = 0.95) -> DataFrame:
    """ids of composites (id, seq, hv) that an earlier one, itself kept, resembles."""
    pairs = similar_pairs(composites.select(F.struct("seq", "id").alias("id"), "hv"), least - 1e-12).where(F.col("similarity") >= least)
    comp = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    grouped = pairs.join(comp, pairs["a"] == comp["node"]).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))

    def greedy(batches):
        for pdf in batches:
            gone = []
            for ps in pdf["pairs"]:
                dead: set = set()
                for p in ps:
                    a, b = (p["a"]["seq"], p["a"]["id"]), (p["b"]["seq"], p["b"]["id"])
                    if a not in dead:
                        dead.add(b)
                gone += [i for _, i in dead]
            yield pd.DataFrame({"id": pd.Series(gone, dtype=object)})

    return grouped.select("pairs").mapInPandas(greedy, f"id {dict(composites.dtypes)['id']}")


ROWS = 1_000_000  #: ids that a task compares, about


def without(ids: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of ids (id) that others (id) lacks, each as often as it is there.

    An anti join would move below a union, whose parts would each sort all others, all within one
    task where the parts are small. This is one join, with as many tasks as the counted rows ask for.
    """
    n = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), (ids.count() + others.count()) // ROWS + 1)
    held = others.select("id").repartition(n, "id").distinct().withColumn("_held", F.lit(True))
    return ids.select("id").repartition(n, "id").join(held.hint("merge"), "id", "left").where("_held is null").select("id")


def stale(composites: DataFrame, triples: DataFrame) -> DataFrame:
    """ids of composites without a triple."""
    return without(composites.select("id"), triples.select("id"))


def unreferenced(atoms: DataFrame, triples: DataFrame) -> DataFrame:
    """ids of atoms that no triple has."""
    used = triples.select(F.explode(F.array("s", "r", "o")).alias("id")).distinct()
    return atoms.select("id").join(used, "id", "left_anti")


def refine(triples: DataFrame, atoms: DataFrame, dim: int, alpha: float = 0.2, relations: int = 2, peers: int = 2) -> DataFrame:
    """(id, hv) of atoms that change: a share alpha of their indices gives way to those most frequent among peers.

    Peers of a subject have a relation with it in common; each relation's peers weigh 1 together.
    """
    k = active(dim)
    has = triples.select("s", "r").distinct()
    n = has.groupBy("r").agg(F.count("*").alias("n"))
    usable = has.join(n, "r").where(F.col("n") - 1 >= peers)
    enough = usable.groupBy("s").agg(F.count("*").alias("m")).where(F.col("m") >= relations)
    mass = usable.join(atoms.withColumnRenamed("id", "s"), "s").select("r", "n", F.explode("hv").alias("idx")).groupBy("r", "n", "idx").agg(F.count("*").alias("c"))
    own = atoms.join(enough.select(F.col("s").alias("id")), "id", "left_semi")
    around = usable.withColumnRenamed("s", "id").join(own, "id").join(mass.drop("n"), "r")
    inside = F.array_contains("hv", F.col("idx")).cast("int")
    weight = around.groupBy("id", "idx").agg(F.sum((F.col("c") - inside) / (F.col("n") - 1)).alias("w"), F.max(inside).alias("inside"))
    new = weight.where("inside = 0 and w > 0").withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("w"), "idx"))).where(F.col("_n") <= int(alpha * k)).groupBy("id").agg(F.collect_list("idx").alias("more"))
    kept = own.join(new, "id").withColumn("new", F.array_sort(F.array_union(F.slice("hv", 1, max(1, int((1 - alpha) * k))), F.col("more"))))
    return kept.where(jaccard(F.col("hv"), F.col("new")) < 0.999).select("id", F.col("new").alias("hv"))


def cycle(triples: DataFrame, atoms: DataFrame, dim: int) -> dict[str, DataFrame]:
    """Everything that one round of discovery finds, by kind."""
    return {"patterns": patterns(triples), "abstractions": abstractions(triples, atoms, dim), "hypotheses": hypotheses(triples, atoms, dim), "gaps": gaps(triples), "analogies": analogies(triples)}


def govern(composites: DataFrame, triples: DataFrame, atoms: DataFrame) -> dict[str, DataFrame]:
    """What upkeep would remove, by kind."""
    return {"duplicates": duplicates(composites), "stale": stale(composites, triples), "unreferenced": unreferenced(atoms, triples)}
