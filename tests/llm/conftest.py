import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: columns beside doc_id and text have names that operators use themselves
SCHEMA = StructType([StructField(c, LongType() if c in ("doc_id", "n_chars") else StringType()) for c in ("doc_id", "text", "lang", "source", "n_chars", "key", "row", "_ids", "keep", "block", "window")])
PROSE = "the quick brown fox jumps over the lazy dog and runs into the dark wood where nobody has ever seen it again"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, clashing columns."""
    long = " ".join(f"{PROSE} {i}" for i in range(4000))
    rows = [
        (1, PROSE, "en"),
        (1, PROSE, "en"),
        (2, None, "en"),
        (3, "", None),
        (None, PROSE + " once more", "en"),
        (None, None, None),
        (4, long, "en"),
        (5, " \n\n ", "en"),
        (6, "...", "en"),
        (7, PROSE, "en"),
    ]
    return spark.createDataFrame([(i, t, lang, None, len(t) if t is not None else None, "k", "r", "x", "y", None, "w") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
