"""The corpus pipeline: documents in, tokens out.

Each stage works on what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hvspark.llm import bpe, decontaminate, jaccard, language, lines
from hvspark.llm.frames import shared_root

STAGES = [
    ("language ID", language.stage),
    ("line dedup", lines.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE", bpe.stage),
]

#: SQL expresses neither cross-parsing nor byte-pair merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in the shared folder that the session names."""
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
