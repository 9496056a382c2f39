"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A ``LineStore`` is a folder of Parquet tables that all executors can reach, to which each change adds:

* ``lines``: every occurrence (shard, h1, h2, batch, doc_id, key, pos) of a document's line,
* ``keys`` and ``gone``: the documents that were inserted, and deleted,
* ``refs``: for each distinct line that a change touches, by how much the exact number of its occurrences
  changed, and its owner if that is another one now. The owner is the occurrence that stays: the least by
  (batch, doc_id, key, pos),
* ``filters``: for each shard of the lines' hashes that a change touches a cuckoo filter of the distinct lines.

A change counts once its list of tables is written (``changes``); so a job that dies leaves the store
as it was, and ``LineStore.open`` takes it up again. What was written before isn't written again.

``insert`` asks the filters first. A line that its shard's filter doesn't hold is new and needs
no look-up; only the rest is joined to the exact counts, which decide. ``delete`` takes a document's
occurrences back: counts fall, a line at zero leaves table and filter, and a line whose owner
went passes to its next occurrence, which comes back in that document's text. So the state after
any insertions and deletions is that of inserting what is live.

A line is compared without blanks at its ends, by two 64-bit hashes. Blank lines are never
repeats. ``key`` is a hash of a row's id and text: rows that repeat both are one document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.cuckoo import CuckooFilter, Full
from hvspark.llm.frames import BROADCAST_BYTES, KEY, broadcast_if_small, checkpointed, keyed, load, parts_of, row_key, shared_root

SHARD_BYTES = 16 << 20  #: of documents a shard, where the number of shards isn't given
LINE = ["shard", "h1", "h2"]
_OWNER = f"struct<batch:int,doc_id:bigint,key:{KEY},pos:int>"
_REFS = f"shard int, h1 bigint, h2 bigint, refs bigint, owner {_OWNER}"
_LINES = f"shard int, h1 bigint, h2 bigint, batch int, doc_id bigint, key {KEY}, pos int"
_PROBED = f"{_REFS}, seen boolean, filter binary"
_KINDS = {"lines": _LINES, "refs": f"{_REFS}, version int", "filters": "shard int, filter binary, version int", "keys": f"key {KEY}", "gone": f"key {KEY}, version int"}


def occurrences(docs: DataFrame, shards: int, batch: int) -> DataFrame:
    """The lines of docs that aren't blank, with their place."""
    lines = docs.select(F.lit(batch).alias("batch"), F.col("doc_id").cast("bigint"), row_key("doc_id", "text").alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    h1 = F.xxhash64(line)
    return lines.where(line != "").select(F.pmod(h1, F.lit(shards)).cast("int").alias("shard"), h1.alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), "batch", "doc_id", "key", "pos")


def _once(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Occurrences without repeats, which only the documents of the keys in twice have."""
    n = twice.count()
    if n * 32 > BROADCAST_BYTES:
        return rows.distinct()
    if not n:
        return rows
    few = F.broadcast(twice)
    again = rows.join(few, "key", "left_semi").distinct()
    return rows.join(few, "key", "left_anti").unionByName(again)


def _filter_of(table: pa.Table) -> CuckooFilter | None:
    return CuckooFilter.from_bytes(table["filter"][0].as_py()) if table.num_rows else None


def _probe(new: pa.Table, old: pa.Table) -> pa.Table:
    """Whether the shard's filter holds each line; and, in one more row, the filter with the others added.

    The row's filter is null if they don't fit; it is then to be built from the exact table.
    """
    now, h = _filter_of(old), new["h1"].to_numpy().view(np.uint64)
    seen = now.contains(h) if now else np.zeros(len(h), np.bool_)
    fresh = np.unique(h[~seen])
    try:
        if now:
            now.insert(fresh)
        else:
            now = CuckooFilter.build(fresh)
        data = now.to_bytes()
    except Full:
        data = None
    shard = new["shard"][0].as_py() if len(h) else old["shard"][0].as_py()
    rows = new.append_column("seen", pa.array(seen)).append_column("filter", pa.nulls(len(h), pa.binary()))
    last = {n: pa.nulls(1, rows.schema.field(n).type) for n in rows.column_names} | {"shard": pa.array([shard], pa.int32()), "filter": pa.array([data], pa.binary())}
    return pa.concat_tables([rows, pa.table(last, schema=rows.schema)])


def _rebuild(lines: pa.Table) -> pa.Table:
    h = np.unique(lines["h1"].to_numpy().view(np.uint64))
    return pa.table({"shard": lines["shard"][:1], "filter": pa.array([CuckooFilter.build(h).to_bytes()], pa.binary())})


def _remove(gone: pa.Table, old: pa.Table) -> pa.Table:
    now = _filter_of(old)
    now.remove(np.unique(gone["h1"].to_numpy().view(np.uint64)))
    return pa.table({"shard": old["shard"][:1], "filter": pa.array([now.to_bytes()], pa.binary())})


class LineStore:
    """The state in a shared folder; one change at a time."""

    def __init__(self, spark: SparkSession, folder: str, shards: int):
        self.spark, self.folder, self.shards, self.version = spark, folder, shards, 0
        self.looked_up = 0  #: lines of the last insertion that were looked up in the exact table
        self._paths: dict[str, list[str]] = {}

    @classmethod
    def scratch(cls, docs: DataFrame, shards: int | None = None) -> LineStore:
        """An empty store in the session's shared folder."""
        spark = docs.sparkSession
        return cls(spark, f"{shared_root(spark)}/lines-{uuid.uuid4().hex}", shards or parts_of(docs, SHARD_BYTES))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineStore:
        """The store that is in a folder, as its last change left it."""
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [x.getPath().toString() for x in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        rows = spark.read.schema("version int, shards int, kind string, path string").json(done).orderBy("version").collect()
        store = cls(spark, folder, rows[0]["shards"])
        for r in rows:
            store.version = r["version"]
            store._paths.setdefault(r["kind"], []).append(r["path"])
        return store

    def _read(self, kind: str) -> DataFrame:
        """All that changes added to a table."""
        if kind not in self._paths:
            return self.spark.createDataFrame([], _KINDS[kind])
        return self.spark.read.schema(_KINDS[kind]).parquet(*self._paths[kind])

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/{name}/{self.version}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _commit(self, paths: dict[str, str], scratch: list[str]) -> None:
        rows = [(self.version, self.shards, kind, path) for kind, path in paths.items()]
        self.spark.createDataFrame(rows, "version int, shards int, kind string, path string").coalesce(1).write.json(f"{self.folder}/changes/{self.version}-{uuid.uuid4().hex}")
        for kind, path in paths.items():
            self._paths.setdefault(kind, []).append(path)
        for path in scratch:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _state(self, rows: DataFrame) -> DataFrame:
        """(shard, h1, h2, refs, owner) of the lines that rows of ``refs`` tell of."""
        if len(self._paths.get("refs", ())) < 2:
            return rows.drop("version").where("refs > 0")
        last = F.max(F.when(F.col("owner").isNotNull(), F.struct("version", "owner"))).getField("owner")
        return rows.groupBy(*LINE).agg(F.sum("refs").alias("refs"), last.alias("owner")).where("refs > 0")

    @property
    def lines(self) -> DataFrame:
        """The occurrences in documents that weren't deleted."""
        rows = self._read("lines")
        if "gone" not in self._paths:
            return rows
        gone = self._read("gone").groupBy("key").agg(F.max("version").alias("dead"))
        return rows.join(gone, "key", "left").where("dead is null or batch > dead").select(*LINE, "batch", "doc_id", "key", "pos")

    @property
    def keys(self) -> DataFrame:
        return self.lines.select("key").distinct() if "gone" in self._paths else self._read("keys")

    @property
    def refs(self) -> DataFrame:
        return self._state(self._read("refs"))

    @property
    def filters(self) -> DataFrame:
        rows = self._read("filters")
        if len(self._paths.get("filters", ())) < 2:
            return rows.drop("version")
        return rows.groupBy("shard").agg(F.max_by("filter", "version").alias("filter"))

    def insert(self, docs: DataFrame) -> None:
        """Documents that are in the store already, by id and text, are left as they are."""
        first = not self._paths
        self.version += 1
        version = F.lit(self.version)
        keys = checkpointed(docs.groupBy(row_key("doc_id", "text").alias("key")).agg(F.count("*").alias("rows")))
        rows = _once(occurrences(docs, self.shards, self.version), keys.where("rows > 1").select("key"))
        keys = keys.select("key")
        if not first:
            known = checkpointed(keys.join(self.keys, "key", "left_semi"))
            if not known.isEmpty():
                rows = rows.join(broadcast_if_small(known, 32), "key", "left_anti").select(*LINE, "batch", "doc_id", "key", "pos")
                keys = keys.join(broadcast_if_small(known, 32), "key", "left_anti")
        paths = {"lines": self._write("lines", rows)}
        added = self.spark.read.schema(_LINES).parquet(paths["lines"])
        delta = added.groupBy(*LINE).agg(F.count("*").alias("refs"), F.min(F.struct("batch", "doc_id", "key", "pos")).alias("owner"))
        scratch = [self._write("probed", delta.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, _PROBED))]
        probed = self.spark.read.schema(_PROBED).parquet(scratch[0])
        own = probed.where("refs is not null and not seen").select(*LINE, "refs", "owner")
        if not first:
            maybe = probed.where("seen").select(*LINE, "refs", "owner")
            self.looked_up = maybe.count()
            there = self._state(self._read("refs").join(maybe.select(*LINE), LINE, "left_semi")).select(*LINE, F.lit(True).alias("there"))
            own = own.unionByName(maybe.join(there, LINE, "left").select(*LINE, "refs", F.when(F.col("there").isNull(), F.col("owner")).alias("owner")))
        paths["refs"] = self._write("refs", own.withColumn("version", version))
        paths["keys"] = self._write("keys", keys)
        blobs = probed.where("refs is null").select("shard", "filter")
        fits, overflow = blobs.where("filter is not null"), blobs.where("filter is null").select("shard")
        if not first and not overflow.isEmpty():
            held = self.refs.select("shard", "h1").unionByName(probed.where("refs is not null").select("shard", "h1"))
            fits = fits.unionByName(held.join(overflow, "shard", "left_semi").groupBy("shard").applyInArrow(_rebuild, "shard int, filter binary"))
        paths["filters"] = self._write("filters", fits.withColumn("version", version))
        self._commit(paths, scratch)

    def delete(self, docs: DataFrame) -> None:
        """Take documents, by id and text, out again; those that aren't in the store don't matter."""
        self.version += 1
        version = F.lit(self.version)
        keys = checkpointed(docs.select(row_key("doc_id", "text").alias("key")).distinct())
        where = broadcast_if_small(keys, 32)
        loss = checkpointed(self.lines.join(where, "key", "left_semi").groupBy(*LINE).agg(F.count("*").alias("lost")))
        now = self._state(self._read("refs").join(loss.select(*LINE), LINE, "left_semi")).select(*LINE, "refs", F.col("owner.key").alias("key"))
        left = loss.join(now, LINE).join(where.withColumn("orphan", F.lit(True)), "key", "left")
        left = checkpointed(left.select(*LINE, "lost", (F.col("refs") - F.col("lost")).alias("left"), F.coalesce("orphan", F.lit(False)).alias("orphan")))
        orphans = broadcast_if_small(left.where("orphan and left > 0").select(*LINE), 32)
        live = self.lines.join(where, "key", "left_anti").groupBy(*LINE).agg(F.min(F.struct("batch", "doc_id", "key", "pos")).alias("owner"))
        heirs = live.join(orphans, LINE, "left_semi")  # Catalyst asks few orphans before it aggregates, many after
        paths = {"refs": self._write("refs", left.join(heirs, LINE, "left").select(*LINE, (-F.col("lost")).alias("refs"), "owner", version.alias("version")))}
        dead = left.where("left = 0").select("shard", "h1").distinct()
        alive = self._state(self._read("refs").join(dead, ["shard", "h1"], "left_semi")).join(left.where("left = 0").select(*LINE), LINE, "left_anti")
        dead = dead.join(alive.select("shard", "h1"), ["shard", "h1"], "left_anti")
        touched = self.filters.join(dead.select("shard").distinct(), "shard", "left_semi")
        paths["filters"] = self._write("filters", dead.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(_remove, "shard int, filter binary").withColumn("version", version))
        paths["gone"] = self._write("gone", keys.withColumn("version", version))
        self._commit(paths, [])

    def kept(self) -> DataFrame:
        """(key, keep): the positions of the lines that each document owns.

        Where nothing was deleted, a line's owner stays what it was when the line came, and no change names another.
        """
        owned = self.refs if "gone" in self._paths else self._read("refs").where("owner is not null")
        return owned.select("owner.key", "owner.pos").groupBy("key").agg(F.collect_list("pos").alias("keep"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """docs, all of which are in the store, with only the lines that they own in their text.

        Blank lines stay where they are. A document all of whose lines went is gone, a null
        text or one of blank lines stays, and rows that repeat id and text become one.
        Two columns more, which replace such columns: ``_lines``, the lines that aren't blank, and ``_kept``.
        """
        lines = F.split("row.text", "\n")
        mine = F.coalesce("own", F.array().cast("array<int>"))
        parts = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), ((F.trim(x) == "") | F.array_contains(mine, i)).alias("stays"))), lambda x: x.stays)
        rows = keyed(docs).groupBy("key").agg(F.first("row").alias("row")).join(self.kept().withColumnRenamed("keep", "own"), "key", "left")
        total = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.trim(x) != "")))
        rows = rows.withColumn("total", total).withColumn("held", F.size(mine)).where("held > 0 or total = 0")
        text = F.when(F.col("held") == F.col("total"), F.col("row.text")).otherwise(F.array_join(F.transform(parts, lambda x: x.line), "\n"))
        kept = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("_lines", "_kept")]
        return rows.select(*kept, F.col("total").alias("_lines"), F.col("held").alias("_kept"))


def dedup(docs: DataFrame, shards: int | None = None, batches: int = 1) -> DataFrame:
    """docs without lines that came before, in the order of doc_id and place; see ``deduplicated``.

    In so many batches, one after the other by doc_id; their number doesn't change the result.
    """
    store = LineStore.scratch(docs, shards)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts or ()), F.lit(0))
    for i in range(batches if cuts else 1):
        store.insert(docs.where(F.coalesce(batch, F.lit(0)) == i) if cuts else docs)
    return store.deduplicated(docs)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the second half by id after the first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, batches=2).withColumnsRenamed({"_lines": "n_lines", "_kept": "n_kept"})


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line only where it comes first; n_chars follows the text."""
    rows = dedup(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("_kept") < F.col("_lines"), F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {
    "op9_line_dedup": r"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as parts from (select distinct doc_id, text from documents)
), places as (
  select doc_id, text, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split
), ranked as (
  select *, trim(line, ' ') = '' as blank,
    row_number() over (partition by trim(line, ' ') order by doc_id, pos) = 1 as first
  from places
)
select doc_id,
  string_agg(line, chr(10) order by pos) filter (where blank or first) as text,
  cast(count(*) filter (where not blank) as integer) as n_lines,
  cast(count(*) filter (where not blank and first) as integer) as n_kept
from ranked
group by doc_id
having count(*) filter (where not blank) = 0 or count(*) filter (where not blank and first) > 0
"""
}
