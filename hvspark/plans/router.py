"""Which way a search goes, by how many vectors there are and what the query looks like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hvspark.operators import retrieve as R

SCAN_BELOW, ATTEND_UP_TO, SPARSE_QUERY = 1000, 10_000, 4


@dataclass(frozen=True)
class Route:
    kind: str  #: scan, attend, overlap or lists
    beam: int
    probes: int


def route(n: int, size: int, dim: int, k: int, lists: bool = False, attention: bool = True) -> Route:
    """n vectors, a query of so many indices."""
    beam, probes = min(max(2 * k, 32), 512), min(max(k // 8, 4), 64)
    if n < SCAN_BELOW:
        kind = "scan"
    elif size <= SPARSE_QUERY or size < dim // 32 and not (attention and n <= ATTEND_UP_TO):
        kind = "overlap"
    elif attention and n <= ATTEND_UP_TO:
        kind = "attend"
    else:
        kind = "lists" if lists else "overlap"
    return Route(kind, beam, probes)


def search(queries: DataFrame, vectors: DataFrame, dim: int, k: int, attention: bool = False) -> DataFrame:
    """(query_id, rank, id, similarity), by the route for the number of vectors and the queries' mean size."""
    n = vectors.count()
    size = queries.agg(F.avg(F.size("hv"))).first()[0] or 0
    way = route(n, int(size), dim, k, attention=attention)
    if way.kind == "scan":  # the rows of the overlap join, which has none of empty vectors and none at 0
        some = F.size("hv") > 0
        return R.top_k_scan(queries.where(some), vectors.where(some), k).where("similarity > 0")
    if way.kind == "attend":
        return R.attend(queries, vectors, k).select("query_id", "rank", "id", "similarity")
    return R.top_k(queries, vectors, k)
