"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split by PATTERN, and each piece's bytes, mapped to Latin-1 characters, pass once through
an Aho-Corasick automaton of all tokens, which gives the tokens that match at each place. From left
to right the longest is taken; it stays only if it is compatible with the token before it, that is,
if merging would not join across their border earlier than inside them. Otherwise the next shorter
one is tried, and where none is left, the last token is taken back; a place that failed once is
never entered again, so the time is linear. Compatibility of two adjacent tokens follows from their
last merges and is memoised. The result is exactly that of merging pairs in the order of ranks.

Encodings of pieces are memoised too, up to a number of pieces, beyond which the memory is emptied.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from hvspark.llm.frames import load
from hvspark.llm.tokens import give_back

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: default for ``path``
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO, MEMO_PIECE = 400_000, 64  #: pieces remembered, and the most characters of one that is
FITS = 400_000  #: pairs of tokens remembered
SLICE = 512  #: rows handed on at a time


def _latin_pattern() -> re.Pattern:
    """PATTERN for texts of characters under U+0250, spelt out for the faster of the two libraries."""
    of = lambda k: "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k)
    letters, numbers = of("L"), of("N")
    return re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


_LATIN, _ANY = _latin_pattern(), regex.compile(PATTERN)
_OTHER = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def pieces(text: str) -> list[str]:
    return (_ANY if _OTHER.search(text) else _LATIN).findall(text)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and number in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class _Memo(dict):
    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.coder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


class Coder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.single = [ranks[bytes([x])] for x in range(256)]
        for b, i in ranks.items():
            if len(b) > 1:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.merge: dict[tuple[int, int], int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.left[i] = self.right[i] = i
            for k in range(1, len(b)):
                x, y = ranks.get(b[:k]), ranks.get(b[k:])
                if x is not None and y is not None and x < i and y < i and self._compatible(x, y):
                    self.left[i], self.right[i] = x, y
                    self.merge[x, y] = i
                    break
        self.fits.clear()
        self.memo = _Memo(self)

    def _compatible(self, x: int, y: int) -> bool:
        """Whether merging the bytes of x and y gives x and y."""
        limit = 1 << 62
        while True:
            joined = self.merge.get((x, y))
            if joined is not None and joined < limit:
                return False
            if x > y:
                limit, x = x, self.right[x]
                if x == limit:
                    limit, y = y + 1, self.left[y]
                    if y + 1 == limit:
                        return True
            else:
                limit, y = y + 1, self.left[y]
                if y + 1 == limit:
                    limit, x = x, self.right[x]
                    if x == limit:
                        return True

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        single, fits = self.single, self.fits
        at = [(1, single[x], None) for x in data]  # from a token to the next shorter one at its place
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - length
            at[start] = (length, token, at[start])
        at.append(None)
        dead = bytearray(n + 1)
        out: list[int] = []
        taken: list[tuple] = []
        pos, last, way = 0, -1, at[0]
        while pos < n:
            while way is not None:
                length, token, shorter = way
                if not dead[pos + length]:
                    ok = last < 0 or fits.get((last, token))
                    if ok is None:
                        if len(fits) >= FITS:
                            fits.clear()
                        ok = fits[last, token] = self._compatible(last, token)
                    if ok:
                        break
                way = shorter
            if way is not None:
                taken.append(way)
                out.append(token)
                last = token
                pos += length
                way = at[pos]
            else:
                dead[pos] = 1
                out.pop()
                length, _, way = taken.pop()
                pos -= length
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        return b"".join(map(self.memo.__getitem__, pieces(text)))

    def forget(self) -> None:
        """Let go of what is remembered of texts."""
        self.memo.clear()
        self.fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_coders: dict[int, Coder] = {}  #: 30 MB each; what they remember goes with each task, as workers outlive the stage


def _coder(shared) -> Coder:
    """This process's coder for broadcast ranks."""
    if shared.value["id"] not in _coders:
        _coders[shared.value["id"]] = Coder(shared.value["ranks"])
    return _coders[shared.value["id"]]


def _share(spark: SparkSession, path: str):
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast({"id": hash(frozenset(ranks.items())), "ranks": ranks})


def encode(docs: DataFrame, path: str = VOCABULARY, verify: bool = False, name: str = "_ids") -> DataFrame:
    """docs, all columns as they are, and ``name`` array<int>, null for a null text and empty for an empty one.

    verify: decode the ids, too, and add ``_exact``: whether that gives the text; null for a null text.
    Both replace columns of their names. Rows that repeat give rows that repeat.
    """
    docs = docs.drop(name, *(["_exact"] if verify else []))
    shared = _share(docs.sparkSession, path)
    at = docs.columns.index("text")

    def run(batches):
        coder = _coder(shared)
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                parts, ends, null, exact = [], [0], [], []
                for x in b.column(at):
                    x = x.as_py()
                    null.append(x is None)
                    ids = coder.encode(x) if x else b""
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                    if verify:
                        exact.append(None if x is None else coder.decode(np.frombuffer(ids, np.uint32).tolist()) == x.encode())
                flat = pa.array(np.frombuffer(b"".join(parts), np.uint32).view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(null, pa.bool_()))
                more = [lists, pa.array(exact, pa.bool_())] if verify else [lists]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "ids", "exact"][: len(b.columns) + len(more)])
        coder.forget()
        give_back()

    spaced = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = [StructField("ids", ArrayType(IntegerType())), StructField("exact", BooleanType())][: 1 + verify]
    return spaced.mapInArrow(run, StructType([*spaced.schema.fields, *more])).toDF(*docs.columns, name, *["_exact"][: int(verify)])


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """rows, all columns as they are, and ``_text``: the text of ``_ids``, null for null; bytes that are no UTF-8 become U+FFFD.

    An id that the vocabulary lacks, or a null among the ids, is an error.
    """
    rows = rows.drop("_text")
    shared = _share(rows.sparkSession, path)
    at = rows.columns.index("_ids")

    def run(batches):
        tokens = {i: b for b, i in shared.value["ranks"].items()}
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                b = whole.slice(first, SLICE)
                text = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "_text"])

    spaced = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    schema = StructType([*spaced.schema.fields, StructField("_text", StringType())])
    return spaced.mapInArrow(run, schema).toDF(*rows.columns, "_text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, round_trip, ids): each document encoded, and decoded again for comparison."""
    rows = encode(load(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)
    return rows.select("doc_id", F.when(F.col("_ids").isNotNull(), F.size("_ids")).alias("n_tokens"), F.col("_exact").alias("round_trip"), F.col("_ids").alias("ids"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens: the columns of docs, and ``ids`` and ``n_tokens``, which replace such columns."""
    rows = encode(docs.drop("n_tokens"), name="ids")
    return rows.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids")))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
