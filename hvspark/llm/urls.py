"""URL filter by a weighted vocabulary.

One Aho-Corasick automaton of all terms passes over the URL, percent-decoded and lower-cased. A hit counts
where the term is bounded: a letter may not be followed by another over either of its borders, nor a digit
by another digit. Terms marked ``host`` also count at the beginning or the end of a label of the host,
as names there are written without blanks. One strict term rejects a page, and so do several distinct
soft terms whose weights add up to SOFT_LIMIT, each term counting once.
"""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hvspark.llm.frames import load

#: (term, strict, weight, host): a table of this form can be given instead
TERMS = (
    *((x, True, 0.0, True) for x in ("porn", "porno", "pornography", "hentai", "camgirl", "camgirls", "viagra", "casino", "casinos", "warez")),
    *((x, True, 0.0, False) for x in ("xxx", "escort", "escorts", "milf", "cialis", "cheap-pills", "spam-farm", "adult-videos", "free-sex", "malware", "phishing")),
    *((x, False, 1.5, False) for x in ("sex", "sexy", "nude", "erotic", "poker", "betting", "gambling", "jackpot", "payday", "keygen", "pharma")),
    *((x, False, 1.0, False) for x in ("adult", "dating", "webcam", "bet", "slots", "loan", "loans", "pill", "pills", "pharmacy", "replica", "spam", "crack", "torrent", "hack")),
    *((x, False, 0.5, False) for x in ("credit", "cheap", "discount", "free", "win", "winner", "prize", "bonus", "farm", "download")),
)
SOFT_LIMIT, SEVERAL = 2.0, 2
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_SCHEMA = "strict_hits int, soft_hits int, soft_weight double, terms string, reject boolean"


def _joined(a: str, b: str) -> bool:
    return (a in _LETTERS and b in _LETTERS) or (a in _DIGITS and b in _DIGITS)


def lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def host_of(url: str) -> tuple[int, int]:
    """Where the host stands in a URL: after ``//``, to the first of ``/?#:`` or the end."""
    start = url.find("//")
    if start < 0:
        return 0, 0
    start += 2
    return start, min((i for i in (url.find(c, start) for c in "/?#:") if i >= 0), default=len(url))


class Vocabulary:
    """terms: (term, strict, weight, host). Of rows for one term the strict one counts, then the heaviest; case of ASCII letters doesn't matter, and empty terms don't."""

    def __init__(self, terms=TERMS, limit: float = SOFT_LIMIT):
        self.terms: dict[str, tuple[bool, float, bool]] = {}
        for term, strict, weight, host in terms:
            if term:
                term = lower_ascii(term)
                self.terms[term] = max(self.terms.get(term, (False, 0.0, False)), (bool(strict), float(weight), bool(host)))
        self.limit = limit
        self.automaton = ahocorasick.Automaton()
        for x in sorted(self.terms):
            self.automaton.add_word(x, x)
        if len(self.automaton):
            self.automaton.make_automaton()

    def judge(self, url: str | None) -> tuple[int, int, float, str, bool]:
        """(distinct strict terms, distinct soft terms, their weight, the terms, reject)."""
        found = set()
        text = lower_ascii(unquote(url or "", errors="replace"))
        lo, hi = host_of(text)
        for at, term in self.automaton.iter(text) if len(self.automaton) else ():
            start, end = at + 1 - len(term), at + 1
            bounds = not (start and _joined(text[start - 1], term[0])), not (end < len(text) and _joined(term[-1], text[end]))
            in_host = self.terms[term][2] and lo <= start and end <= hi
            if all(bounds) or in_host and (start == lo or text[start - 1] == "." or end == hi or text[end] == "."):
                found.add(term)
        strict = {x for x in found if self.terms[x][0]}
        soft = found - strict
        weight = sum(self.terms[x][1] for x in sorted(soft))
        return len(strict), len(soft), float(weight), " ".join(sorted(found)), bool(strict) or len(soft) >= SEVERAL and weight >= self.limit


@lru_cache(maxsize=4)
def _vocabulary(terms: tuple, limit: float) -> Vocabulary:
    """One automaton a worker."""
    return Vocabulary(terms, limit)


def terms_of(table: DataFrame) -> tuple:
    """The rows of a table (term, strict, weight, host), which must be few, as a vocabulary is."""
    return tuple(map(tuple, table.select("term", "strict", "weight", "host").collect()))


def filter_urls(pages: DataFrame, terms: tuple = TERMS, limit: float = SOFT_LIMIT, column: str = "url") -> DataFrame:
    """pages, all columns as they are, and ``_verdict``, which replaces such a column: struct of the counts of distinct terms, their weight, the terms and reject.

    A null or empty URL has no hits and isn't rejected. Rows that repeat give equal verdicts. URLs of any
    length are read whole. ``%XX`` is decoded once; bytes that are no UTF-8 become U+FFFD.
    """
    given = tuple(map(tuple, terms))

    @F.pandas_udf(_SCHEMA)
    def verdict(urls: pd.Series) -> pd.DataFrame:
        v = _vocabulary(given, limit)
        return pd.DataFrame([v.judge(None if x is None or x != x else x) for x in urls], columns=["strict_hits", "soft_hits", "soft_weight", "terms", "reject"])

    return pages.withColumn("_verdict", verdict(F.col(column)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url", "_verdict.*")


def _terms_sql() -> str:
    return ", ".join(f"('{t}', {int(s)}, {w}, {str(h).lower()})" for t, s, w, h in TERMS)


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {
    "op7_url_filter": rf"""
with terms(term, strict, weight, host) as (values {_terms_sql()}),
urls as (select distinct page_id, lower(url_decode(url)) as u from pages),
places as (select *, coalesce(regexp_extract(u, '//([^/?#:]*)', 1), '') as at from urls),
hits as (
  select p.page_id, t.* from places p join terms t
  on regexp_matches(u, '(^|[^a-z])' || term || '($|[^a-z])') or (host and regexp_matches(at, '(^|[.])' || term || '|' || term || '([.]|$)'))
)
select page_id, url,
  cast(coalesce(sum(strict), 0) as integer) as strict_hits,
  cast(coalesce(sum(1 - strict), 0) as integer) as soft_hits,
  cast(coalesce(sum(weight), 0) as double) as soft_weight,
  coalesce(string_agg(term, ' ' order by term), '') as terms,
  coalesce(sum(strict), 0) > 0 or (coalesce(sum(1 - strict), 0) >= {SEVERAL} and coalesce(sum(weight), 0) >= {SOFT_LIMIT}) as reject
from pages left join hits using (page_id)
group by page_id, url
"""
}
