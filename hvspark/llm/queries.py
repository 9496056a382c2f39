"""The queries of this subpackage and, where SQL can express them, their SQL."""

from hvspark.llm import bpe, chat, decontaminate, jaccard, language, licences, lines, neighbours, quality, urls

_MODULES = (decontaminate, language, chat, jaccard, bpe, quality, urls, neighbours, lines, licences)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.ORACLES.items()}
