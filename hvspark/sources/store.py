"""A store of vectors, facts and relations: append-only Parquet change logs with latest-wins views.

Each kind is a folder of commits; a commit is written under a new name and counts once Spark's mark of
success stands, so a job that dies leaves nothing half done. ``seq``, the time of the commit and the row's
place in it, orders the rows of all commits; no two rows share one.

A compaction writes a base and, after it, the names of the commits that the base replaces. Rows of a base
keep their ``seq``, and deletions stay in it, so a commit that was begun before and ends after it is read
in its place.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from hvspark.functions.hashing import atom_udf, dense_udf, text_udf
from hvspark.functions.vectors import scalar, xor
from hvspark.operators.meaning import compose_triples, latest, sequence

SCHEMAS = {
    "vectors": "id string, hv array<int>, deleted boolean, seq struct<at:bigint,n:bigint>",
    "atoms": "id string, hv array<int>, deleted boolean, seq struct<at:bigint,n:bigint>",
    "triples": "id string, s string, r string, o string, source string, deleted boolean, seq struct<at:bigint,n:bigint>",
    "relations": "source string, type string, target string, properties string, valid_from double, valid_to double, deleted boolean, seq struct<at:bigint,n:bigint>",
    "audit": "timestamp_ms bigint, op string, id_hash string, reason string, seq struct<at:bigint,n:bigint>",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str, dim: int = 16384):
        if not 0 < dim <= 1_000_000:
            raise ValueError("the dimension is from 1 to 1,000,000")
        self.spark, self.folder, self.dim = spark, folder, dim

    # --- change logs ---

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _commits(self, kind: str) -> list[str]:
        """The commits that count: done, and not replaced by a base."""
        done = []
        for n in self._names(kind):
            path, fs = self._path(f"{kind}/{n}/_SUCCESS")
            if fs.exists(path):
                done.append(n)
        replaced, bases = set(), set()
        for n in self._names(f"{kind}-replaced"):
            path, fs = self._path(f"{kind}-replaced/{n}/_SUCCESS")
            if fs.exists(path):
                bases.add(n)
                replaced |= {r[0] for r in self.spark.read.text(f"{self.folder}/{kind}-replaced/{n}").collect()}
        return sorted(n for n in done if n not in replaced and (not n.endswith("-base") or n in bases))

    def log(self, kind: str) -> DataFrame:
        """All rows of all commits that count."""
        paths = [f"{self.folder}/{kind}/{n}" for n in self._commits(kind)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        return self.spark.read.schema(SCHEMAS[kind]).parquet(*paths)

    def _append(self, kind: str, rows: DataFrame) -> None:
        at = time.time_ns()
        names = [c.name for c in _parse_datatype_string(SCHEMAS[kind]).fields]
        seq = F.struct(F.lit(at).alias("at"), F.monotonically_increasing_id().alias("n"))
        rows.withColumn("seq", seq).select(*names).write.parquet(f"{self.folder}/{kind}/{at:020d}")

    def _audit(self, op: str, ids: DataFrame, reason: str = "") -> None:
        self._append("audit", ids.select(F.lit(time.time_ns() // 1_000_000).alias("timestamp_ms"), F.lit(op).alias("op"), F.sha2(F.col("id").cast("string"), 256).alias("id_hash"), F.lit(reason).alias("reason")))

    def audit_since(self, timestamp_ms: float) -> DataFrame:
        return self.log("audit").where(F.col("timestamp_ms") >= timestamp_ms)

    # --- live views ---

    @property
    def vectors(self) -> DataFrame:
        return latest(self.log("vectors")).select("id", "hv")

    @property
    def atoms(self) -> DataFrame:
        """The first vector of each name since it was last deleted."""
        return self._atoms().select("id", "hv")

    def _atoms(self) -> DataFrame:
        gone = F.max(F.when(F.col("deleted"), F.col("seq")))
        log = self.log("atoms")
        last = log.groupBy("id").agg(gone.alias("gone"))
        live = log.where(~F.col("deleted")).join(last, "id").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
        return live.groupBy("id").agg(F.min_by("hv", "seq").alias("hv"), F.min("seq").alias("seq"))

    @property
    def triples(self) -> DataFrame:
        return latest(self.log("triples")).select("id", "s", "r", "o", "source")

    @property
    def relations(self) -> DataFrame:
        """Additions that no removal met; a removal meets the first one that is there at its time, if any."""
        what = W.partitionBy("source", "type", "target")
        order = what.orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
        log = self.log("relations").withColumns({"_n": F.sum(F.when(F.col("deleted"), 0).otherwise(1)).over(order), "_held": F.sum(F.when(F.col("deleted"), -1).otherwise(1)).over(order)})
        met = F.sum(F.col("deleted").cast("int")).over(what) - F.greatest(F.lit(0), -F.min("_held").over(what))
        return log.withColumn("_met", met).where(~F.col("deleted") & (F.col("_n") > F.col("_met"))).drop("_n", "_held", "_met", "deleted")

    @property
    def composites(self) -> DataFrame:
        return compose_triples(self.triples, self.atoms, self.dim).select("id", "hv")

    # --- writing ---

    def memorize(self, rows: DataFrame) -> None:
        """(id, hv); an id that is there gets the new vector. Ids are of at most 65,535 bytes and not null."""
        checked = rows.select(F.when(F.col("id").isNull() | (F.octet_length("id") > 65535), F.raise_error(F.lit("an id is null or too long"))).otherwise(F.col("id").cast("string")).alias("id"), "hv")
        self._append("vectors", checked.withColumn("deleted", F.lit(False)))
        self._audit("memorize", rows)

    def memorize_text(self, rows: DataFrame) -> None:
        self.memorize(rows.select("id", text_udf(self.dim)(F.col("text")).alias("hv")))

    def memorize_buffer(self, rows: DataFrame) -> None:
        """(id, data binary); bytes that are no UTF-8 are an error."""
        self.memorize_text(rows.select("id", F.expr("validate_utf8(cast(data as string))").alias("text")))

    def memorize_files(self, paths: list[str], name: str = "path") -> None:
        """A text a file, by its path."""
        self.memorize_text(self.spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text")))

    def memorize_dense(self, rows: DataFrame) -> None:
        self.memorize(rows.select("id", dense_udf(self.dim)(F.col("embedding")).alias("hv")))

    def memorize_scalar(self, rows: DataFrame, low: float, high: float) -> None:
        self.memorize(rows.select("id", scalar(F.col("value"), low, high, self.dim).alias("hv")))

    def memorize_bound(self, rows: DataFrame) -> None:
        """(id, head, relation, tail): the three texts bound; no fact is stored."""
        e = text_udf(self.dim)
        self.memorize(rows.select("id", xor(xor(e(F.col("head")), e(F.col("relation"))), e(F.col("tail"))).alias("hv")))

    def memorize_sequence(self, rows: DataFrame) -> None:
        """(id, items array<string>); an empty sequence isn't stored."""
        items = rows.select("id", F.posexplode("items").alias("pos", "text"))
        self.memorize(sequence(items.select("id", "pos", text_udf(self.dim)(F.col("text")).alias("hv")), self.dim).select("id", "hv"))

    def memorize_facts(self, rows: DataFrame) -> None:
        """(s, r, o[, source]): the fact, and atoms for names that have none."""
        if "source" not in rows.columns:
            rows = rows.withColumn("source", F.lit(None).cast("string"))
        names = rows.select(F.explode(F.array("s", "r", "o")).alias("id")).distinct().join(self.atoms.select("id"), "id", "left_anti")
        self._append("atoms", names.select("id", atom_udf(self.dim)(F.col("id")).alias("hv"), F.lit(False).alias("deleted")))
        self._append("triples", rows.select(F.concat_ws(":", "source", "s", "r", "o").alias("id"), "s", "r", "o", "source", F.lit(False).alias("deleted")))

    def memorize_meaning(self, rows: DataFrame) -> None:
        """(id, text): the text, and the facts that its sentences state."""
        from hvspark.functions.text import units

        self.memorize_text(rows)
        self.memorize_facts(rows.select(F.col("id").cast("string").alias("source"), F.explode(units(F.col("text"))).alias("u")).select("source", "u.s", "u.r", "u.o"))

    def add_relations(self, rows: DataFrame) -> None:
        """(source, type, target[, properties, valid_from, valid_to])."""
        given = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in rows.columns else F.lit(default).cast(kind)).alias(c)
        self._append("relations", rows.select("source", "type", "target", given("properties", "string", None), given("valid_from", "double", 0.0), given("valid_to", "double", 0.0), F.lit(False).alias("deleted")))
        self._audit("relate", rows.select(F.concat_ws(":", "source", "type", "target").alias("id")))

    def remove_relations(self, rows: DataFrame) -> None:
        self._append("relations", rows.select("source", "type", "target", F.lit(None).cast("string").alias("properties"), F.lit(0.0).alias("valid_from"), F.lit(0.0).alias("valid_to"), F.lit(True).alias("deleted")))

    def delete(self, ids: DataFrame, reason: str = "") -> DataFrame:
        """Delete by id; (id, existed). Ids that aren't there leave no trace."""
        ids = ids.select(F.col("id").cast("string").alias("id")).distinct()
        from hvspark.sources.tables import checkpointed

        there = checkpointed(ids.join(self.vectors.select("id", F.lit(True).alias("v")), "id", "left").join(self.atoms.select("id", F.lit(True).alias("a")), "id", "left"))
        tomb = lambda c: there.where(c).select("id", F.array().cast("array<int>").alias("hv"), F.lit(True).alias("deleted"))
        self._append("vectors", tomb("v"))
        self._append("atoms", tomb("a"))
        self._audit("delete", there.where("v or a"), reason)
        return there.select("id", F.coalesce("v", F.lit(False)).alias("existed"))

    def compact(self) -> None:
        """Rewrite what counts as a new base, which later reads use in place of the commits there were. The audit log stays whole."""
        for kind in ("vectors", "atoms", "triples", "relations"):
            commits = self._commits(kind)
            if not commits:
                continue
            log = self.log(kind)
            if kind == "relations":
                rows = self.relations.withColumn("deleted", F.lit(False))
            elif kind == "atoms":
                rows = self._atoms().withColumn("deleted", F.lit(False)).unionByName(log.where("deleted").groupBy("id").agg(F.max("seq").alias("seq")).select("id", F.array().cast("array<int>").alias("hv"), F.lit(True).alias("deleted"), "seq"))
            else:
                rows = log.join(log.groupBy("id").agg(F.max("seq").alias("seq")), ["id", "seq"])
            name = f"{time.time_ns():020d}-base"
            rows.select(*[c.name for c in _parse_datatype_string(SCHEMAS[kind]).fields]).write.parquet(f"{self.folder}/{kind}/{name}")
            self.spark.createDataFrame([(c,) for c in commits], "name string").coalesce(1).write.text(f"{self.folder}/{kind}-replaced/{name}")


def federated_vectors(stores: list[Store]) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.vectors for s in stores))
