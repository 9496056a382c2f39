"""Reading tables, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names for what all executors read.

    Where none is named, a temporary one of this machine: allowed with a local master only, as
    executors elsewhere wouldn't see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared")
    return named


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, within ``shared_root``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


FEW = 100_000  #: rows, up to which a counted table is sent to every task


def if_few(df: DataFrame) -> DataFrame:
    """df, which is cheap to count as a checkpoint is, marked for broadcast if its rows are few; else a join shuffles both sides."""
    return F.broadcast(df) if df.count() <= FEW else df
