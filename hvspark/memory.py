"""One object for a store and everything that can be asked of it. Searches return DataFrames."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.functions import text as T
from hvspark.functions import vectors as V
from hvspark.functions.hashing import TextEncoder, atom_udf, dense_udf, text_udf
from hvspark.operators import agency, aggregate, cognition, factor, graph, meaning, retrieve
from hvspark.plans import router
from hvspark.sources.store import Store


class Memory:
    def __init__(self, spark: SparkSession, folder: str, dimensions: int = 16384, fan_out: int = 40, peers: dict | None = None):
        self.spark, self.store, self.fan_out = spark, Store(spark, folder, dimensions), fan_out
        self._goals: dict[str, dict] = {}
        self._rules: list[tuple[int, list[str], str]] = []
        self._types: dict[str, tuple[bool, bool]] = {}
        self._roles: dict[str, int] = {}
        self._proposals: list[tuple[int, int, str]] = []
        self._proposed: dict[int, dict] = {}
        self._loop: threading.Thread | None = None
        self._stop = threading.Event()
        self._cycles, self._insights = 0, []
        self._lists = None

    # --- state ---

    def dimensions(self) -> int:
        return self.store.dim

    def vector_count(self) -> int:
        return self.store.vectors.count()

    def relation_count(self) -> int:
        return self.store.relations.count()

    def lists_trained(self) -> bool:
        return self._lists is not None

    def graph_trained(self) -> bool:
        """The exact overlap join takes the place of a neighbour graph, so there is nothing to train."""
        return True

    def meaning_enabled(self) -> bool:
        return True

    def cognition_enabled(self) -> bool:
        return True

    # --- text ---

    def analyze_text(self, text: str) -> dict[str, int]:
        return dict(zip((c.split()[0] for c in T.METRICS.split(", ")), T.metrics_of(text)))

    def calculate_readability(self, metrics: dict[str, int]) -> float:
        w, s = metrics["words"], metrics["sentences"]
        return 206.835 - 1.015 * (w / s) - 84.6 * (metrics["syllables"] / w) if w and s else 0.0

    # --- writing ---

    def _one(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([values], schema)

    def memorize_text(self, id: str, text: str) -> None:
        self.store.memorize_text(self._one("id string, text string", id, text))

    def memorize_text_buffer(self, id: str, data: bytes) -> None:
        self.store.memorize_buffer(self._one("id string, data binary", id, bytearray(data)))

    def memorize_batch(self, items: list[tuple[str, str]] | DataFrame) -> None:
        self.store.memorize_text(items if isinstance(items, DataFrame) else self.spark.createDataFrame(items, "id string, text string"))

    def memorize_file(self, id: str, path: str) -> None:
        self.store.memorize_text(self.spark.read.text(path, wholetext=True).select(F.lit(id).alias("id"), F.col("value").alias("text")))

    def memorize_vector(self, id: str, vector: list[float]) -> None:
        self.store.memorize_dense(self._one("id string, embedding array<float>", id, vector))

    def memorize_scalar(self, id: str, value: float, low: float, high: float) -> None:
        self.store.memorize_scalar(self._one("id string, value double", id, value), low, high)

    def memorize_triplet(self, id: str, head: str, relation: str, tail: str) -> None:
        self.store.memorize_bound(self._one("id string, head string, relation string, tail string", id, head, relation, tail))

    def memorize_sequence(self, id: str, items: list[str]) -> None:
        self.store.memorize_sequence(self._one("id string, items array<string>", id, items))

    def memorize_meaning(self, id: str, text: str) -> None:
        self.store.memorize_meaning(self._one("id string, text string", id, text))

    def memorize_fact(self, s: str, r: str, o: str) -> None:
        self.store.memorize_facts(self._one("s string, r string, o string", s, r, o))

    def delete(self, id: str, reason: str = "") -> bool:
        return self.store.delete(self._one("id string", id), reason).first()["existed"]

    def compact(self) -> None:
        self.store.compact()

    def audit_since(self, timestamp_ms: float) -> DataFrame:
        return self.store.audit_since(timestamp_ms)

    # --- searching ---

    def _texts(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
        return rows.select("query_id", text_udf(self.store.dim)(F.col("text")).alias("hv"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return router.search(queries, self.store.vectors, self.store.dim, k)

    def query(self, text: str, k: int) -> DataFrame:
        return self.query_batch([text], k)

    def query_batch(self, texts: list[str], k: int) -> DataFrame:
        return self.search(self._texts(texts), k)

    def query_vector(self, vector: list[float], k: int) -> DataFrame:
        return self.query_vector_batch([vector], k)

    def query_vector_batch(self, vectors: list[list[float]], k: int) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(vectors)), "query_id int, v array<float>")
        return self.search(rows.select("query_id", dense_udf(self.store.dim)(F.col("v")).alias("hv")), k)

    def query_scalar(self, value: float, low: float, high: float, k: int) -> DataFrame:
        return self.search(self._one("query_id int, value double", 0, value).select("query_id", V.scalar(F.col("value"), low, high, self.store.dim).alias("hv")), k)

    def query_hopfield(self, text: str, k: int, beta: float = 100.0, kind: str = "sparsemax") -> DataFrame:
        return retrieve.attend(self._texts([text]), self.store.vectors, k, beta, kind)

    def _bound(self, *texts: str) -> DataFrame:
        e = TextEncoder(self.store.dim)
        hv: set = set()
        for t in texts:
            hv ^= set(e.encode(t))
        return self._one("query_id int, hv array<int>", 0, sorted(hv))

    def query_triplet(self, head: str, relation: str, k: int) -> DataFrame:
        return self.search(self._bound(head, relation), k)

    def find_analogy(self, a: str, b: str, c: str, k: int = 5) -> DataFrame:
        return self.search(self._bound(a, b, c), k)

    def query_sequence(self, partial: list[str], k: int) -> DataFrame:
        items = self.spark.createDataFrame([(0, i, x) for i, x in enumerate(partial)], "id int, pos int, text string")
        made = meaning.sequence(items.select("id", "pos", text_udf(self.store.dim)(F.col("text")).alias("hv")), self.store.dim)
        return self.search(made.select(F.col("id").alias("query_id"), "hv"), k)

    def analyze_components(self, text: str) -> DataFrame:
        return self.query(text, 20).where("similarity > 0.05")

    def federated_query(self, folders: list[str], text: str, k: int) -> DataFrame:
        """Peers that can't be read are passed over."""
        stores = [self.store.vectors]
        for f in folders:
            try:
                peer = Store(self.spark, f, self.store.dim).vectors
                peer.limit(1).count()
                stores.append(peer)
            except Exception as e:  # noqa: BLE001
                print(f"peer {f} is passed over: {e}")
        return retrieve.federated(self._texts([text]), stores, k)

    def bundle_texts(self, texts: list[str], noise: float = 0.0) -> list[int]:
        return aggregate.bundle(self._texts(texts).withColumn("all", F.lit(1)), ["all"], self.store.dim, noise=noise).first()["hv"]

    def factorize_diffusion(self, product: str, domains: list[list[str]], rounds: int = 20) -> DataFrame:
        e = TextEncoder(self.store.dim)
        books = [[(x, e.encode(x)) for x in d] for d in domains]
        hv: set = set()
        for part in product.split(" * "):
            hv ^= set(e.encode(part))
        return factor.factorise(self._one("id int, hv array<int>", 0, sorted(hv)), books, self.store.dim, rounds)

    def synthesize_concepts(self) -> DataFrame:
        return factor.concepts(self.store.vectors, self.store.dim)[1]

    def train_lists(self) -> None:
        self._lists = factor.train_lists(self.store.vectors, self.store.dim)

    def query_lists(self, text: str, k: int, probes: int = 8) -> DataFrame:
        if self._lists is None:
            self.train_lists()
        return factor.search_lists(self._texts([text]), self.store.vectors, self._lists, k, probes)

    # --- meaning ---

    def register_role(self, name: str, shift: int) -> None:
        self._roles = V.register_role(self._roles, name, shift)

    def structural_query(self, known: dict[str, str], target: str) -> DataFrame:
        """known: the filler's name for each role."""
        q = self.spark.createDataFrame([(0, *known.values())], "query_id int, " + ", ".join(f"{r} string" for r in known))
        q = q.select("query_id", *[atom_udf(self.store.dim)(F.col(r)).alias(r) for r in known])
        atoms, composites = self.store.atoms, self.store.composites
        return meaning.structural(q, composites, self.store.triples, atoms, aggregate.idf(composites, self.store.dim), aggregate.idf(atoms, self.store.dim), list(known), target, self.store.dim, self._roles, self.fan_out)

    def multi_hop_query(self, start: str, relations: list[str]) -> DataFrame:
        rules = {tuple(i): o for _, i, o in self._rules if len(i) == 2}
        return meaning.chain(self.store.triples, self._one("start string", start), relations, rules)

    def declare_composition_rule(self, name: str, inputs: list[str], output: str) -> None:
        self._rules.append((len(self._rules), inputs, output))

    def meaning_cleanup(self, text: str) -> DataFrame:
        return self._clean(self._texts([text]))

    def cleanup_vector(self, vector: list[float]) -> DataFrame:
        return self._clean(self._one("query_id int, v array<float>", 0, vector).select("query_id", dense_udf(self.store.dim)(F.col("v")).alias("hv")))

    def _clean(self, probes: DataFrame) -> DataFrame:
        atoms = self.store.atoms
        return retrieve.cleanup(probes, atoms, aggregate.idf(atoms, self.store.dim), self.store.dim)

    # --- relations ---

    def add_relation(self, source: str, kind: str, target: str, properties: str | None = None, valid_from: float = 0.0, valid_to: float = 0.0) -> None:
        self.store.add_relations(self._one("source string, type string, target string, properties string, valid_from double, valid_to double", source, kind, target, properties, valid_from, valid_to))

    def remove_relation(self, source: str, kind: str, target: str) -> bool:
        row = self._one("source string, type string, target string", source, kind, target)
        there = not self.store.relations.join(row, ["source", "type", "target"], "left_semi").isEmpty()
        if there:
            self.store.remove_relations(row)
        return there

    def declare_relation_type(self, name: str, transitive: bool = False, symmetric: bool = False) -> None:
        self._types[name] = (transitive, symmetric)

    def _kinds(self) -> DataFrame:
        return self.spark.createDataFrame([(n, *f) for n, f in self._types.items()], "name string, transitive boolean, symmetric boolean")

    def traverse(self, start: str, kind: str | None = None, depth: int = 3, at_time: float = 0) -> DataFrame:
        found = graph.traverse(self.store.relations, self._one("start string", start), depth, kind, at_time, self._kinds(), self.store.vectors)
        return found.orderBy(F.desc("score"), "path")

    def outgoing_relations(self, node: str, kind: str | None = None, at_time: float = 0) -> DataFrame:
        return graph.outgoing(self.store.relations, node, kind, at_time)

    def incoming_relations(self, node: str, kind: str | None = None, at_time: float = 0) -> DataFrame:
        return graph.incoming(self.store.relations, node, kind, at_time)

    # --- discovery ---

    def run_cognition_once(self) -> int:
        """One round; how many things it found."""
        found = {k: df.count() for k, df in cognition.cycle(self.store.triples, self.store.atoms, self.store.dim).items()}
        self._cycles += 1
        self._insights.append(found)
        return sum(found.values())

    def start_cognition(self, seconds: float = 60.0) -> bool:
        if self.cognition_running():
            return False
        self._stop.clear()

        def run() -> None:
            while not self._stop.wait(0.1):
                self.run_cognition_once()
                end = time.time() + seconds
                while time.time() < end and not self._stop.wait(0.1):
                    pass

        self._loop = threading.Thread(target=run, daemon=True)
        self._loop.start()
        return True

    def stop_cognition(self) -> None:
        self._stop.set()
        if self._loop:
            self._loop.join()
            self._loop = None

    def cognition_running(self) -> bool:
        return self._loop is not None and self._loop.is_alive()

    def cognition_cycle_count(self) -> int:
        return self._cycles

    def cognition_insight_count(self) -> int:
        return sum(sum(x.values()) for x in self._insights)

    def take_insights(self) -> list[dict[str, int]]:
        out, self._insights = self._insights, []
        return out

    def govern_memory(self) -> dict[str, int]:
        composites = self.store.composites.withColumn("seq", F.lit(0))
        return {k: df.count() for k, df in cognition.govern(composites, self.store.triples, self.store.atoms).items()}

    # --- goals, questions, proposals ---

    def add_goal(self, name: str, description: str, relevance: float, urgency: float, cost: float) -> None:
        self._goals[name] = {"name": name, "description": description, "relevance": relevance, "urgency": urgency, "cost": cost, "active": True}

    def deactivate_goal(self, name: str) -> bool:
        there = self._goals.get(name, {}).get("active", False)
        if there:
            self._goals[name]["active"] = False
        return there

    def active_goals(self) -> DataFrame:
        return agency.utility(self.spark.createDataFrame([tuple(g.values()) for g in self._goals.values()], "name string, description string, relevance double, urgency double, cost double, active boolean"))

    def goal_count(self) -> int:
        return len(self._goals)

    def active_goal_count(self) -> int:
        return sum(g["active"] for g in self._goals.values())

    def plan_goal(self, goal: str, causal: list[str], depth: int = 5) -> DataFrame:
        return agency.plan(self.store.triples, self._one("goal string", goal), causal, depth)

    def generate_questions(self) -> DataFrame:
        return agency.gap_questions(cognition.gaps(self.store.triples))

    def propose_rule(self, name: str, inputs: list[str], output: str, reason: str) -> int:
        id = len(self._proposed) + 1
        self._proposed[id] = {"name": name, "inputs": inputs, "output": output, "reason": reason, "state": "pending"}
        return id

    def _decide(self, id: int, state: str) -> bool:
        fits = self._proposed.get(id, {}).get("state") == "pending"
        if fits:
            self._proposed[id]["state"] = state
        return fits

    def approve_proposal(self, id: int) -> bool:
        return self._decide(id, "approved")

    def reject_proposal(self, id: int) -> bool:
        return self._decide(id, "rejected")

    def pending_proposals(self) -> list[dict]:
        return [p | {"id": i} for i, p in self._proposed.items() if p["state"] == "pending"]

    def apply_approved(self) -> int:
        """Declare the rules of approved proposals; how many."""
        done = 0
        for p in self._proposed.values():
            if p["state"] == "approved":
                self.declare_composition_rule(p["name"], p["inputs"], p["output"])
                p["state"] = "applied"
                done += 1
        return done
