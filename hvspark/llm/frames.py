"""Shared helpers: reading tables, the shared checkpoint folder, row keys, and broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.sources.tables import checkpointed, shared_root  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


KEY = "struct<a:bigint,b:bigint>"  #: type of a row's key


def row_key(id_column: str, text_column: str) -> Column:
    """128 bits that stand for a row's id and text; rows that repeat both share them.

    Of n rows about n**2 / 2**129 pairs that differ share a key: none of 5e10 rows, where 64 bits had 70.
    """
    i, t = F.col(id_column), F.col(text_column)
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, i).alias("b"))


def parts_of(df: DataFrame, each: int) -> int:
    """How many parts of about so many bytes df has, by Catalyst's estimate, without running it.

    Where that knows no size, as of rows that don't come from files, it is the number of shuffle partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 56:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // each))


BROADCAST_BYTES = 64 << 20  #: of rows, up to which a counted table is sent to every task


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, computed and counted, and marked for broadcast if its rows of about so many bytes fit the limit.

    Beyond it the join shuffles both sides.
    """
    df = checkpointed(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


HOT = 1 << 16  #: rows from which a key is hot


def spread_join(rows: DataFrame, table: DataFrame, on: str, count: str, hot: int = HOT, row_bytes: int = 128) -> DataFrame:
    """The inner join of rows with table, which has one row a key and in ``count`` how many rows of rows have it.

    Hot keys, of which there are no more than rows / hot, are broadcast, so that no task gets all rows
    of one; if they don't fit, the hottest of them. The rest is shuffled. table is read several times.
    """
    n = table.where(F.col(count) >= hot).count()
    while n * row_bytes > BROADCAST_BYTES:
        hot *= 4
        n = table.where(F.col(count) >= hot).count()
    if not n:
        return rows.join(table, on)
    many = F.broadcast(table.where(F.col(count) >= hot))
    rest = rows.join(many.select(on), on, "left_anti").join(table.where(F.col(count) < hot), on)
    return rows.join(many, on).unionByName(rest)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key): each row as a struct, so that no column of it can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key("doc_id", "text").alias("key"))
