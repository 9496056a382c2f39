"""All queries on the tables and, where SQL can express them, their SQL."""

from hvspark.queries import encoding, knowledge, operations, vectors

_MODULES = (vectors, knowledge, operations, encoding)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
