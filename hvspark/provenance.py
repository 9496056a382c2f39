"""Provenance: hash chains, Merkle trees, revocation, canonical JSON, identifiers and signatures."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hvspark.sources.tables import checkpointed


def chain(lines: DataFrame, key: str, order: str = "seq", line: str = "line") -> DataFrame:
    """lines with ``prev_hash``, the SHA-256 of the line before."""
    w = W.partitionBy(key).orderBy(order)
    return lines.withColumn("prev_hash", F.coalesce(F.lag(F.sha2(line, 256)).over(w), F.lit("")))


def verify_chain(lines: DataFrame, key: str, order: str = "seq", line: str = "line") -> DataFrame:
    """(key, entries, intact, first_broken): whether each ``prev_hash`` is that of the line before."""
    w = W.partitionBy(key).orderBy(order)
    fits = F.col("prev_hash") == F.coalesce(F.lag(F.sha2(line, 256)).over(w), F.lit(""))
    return lines.withColumn("_fits", fits).groupBy(key).agg(F.count("*").alias("entries"), F.bool_and("_fits").alias("intact"), F.min(F.when(~F.col("_fits"), F.col(order))).alias("first_broken"))


def merkle_levels(leaves: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, level, pos, hash) of the leaves, level 0, and the level above: the hash of both; one left over goes up as it is."""
    first = leaves.select(key, F.lit(0).alias("level"), (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("bigint").alias("pos"), "hash")
    return first.unionByName(_above(first))


def _above(level: DataFrame) -> DataFrame:
    key = level.columns[0]
    pairs = level.groupBy(key, "level", F.floor(F.col("pos") / 2).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), "hash"))).alias("h"))
    both = F.sha2(F.concat(F.unhex(F.col("h")[0].hash), F.unhex(F.get("h", F.lit(1)).hash)), 256)
    return pairs.select(key, (F.col("level") + 1).alias("level"), "pos", F.when(F.size("h") == 1, F.col("h")[0].hash).otherwise(both).alias("hash"))


def merkle_tree(leaves: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """All levels of each tree, up to its root; as many rounds as the largest tree has levels."""
    now = checkpointed(merkle_levels(leaves, key, order).where("level = 0"))
    out = now
    while (now.agg(F.max("pos")).first()[0] or 0) > 0:
        now = checkpointed(_above(now.join(now.where("pos > 0").select(key).distinct(), key, "left_semi")))
        out = out.unionByName(now)
    return out


def merkle_root(leaves: DataFrame, key: str, order: str = "seq") -> DataFrame:
    return merkle_tree(leaves, key, order).groupBy(key).agg(F.max_by("hash", "level").alias("root"))


def merkle_proof(tree: DataFrame, key: str, leaf: int) -> DataFrame:
    """(key, proof array<struct(sibling_is_left, hash)>) of one leaf, from the leaf upwards."""
    at = F.floor(F.lit(leaf) / F.pow(F.lit(2), F.col("level"))).cast("bigint")
    sibling = F.when(at % 2 == 0, at + 1).otherwise(at - 1)
    hits = tree.where(F.col("pos") == sibling)
    return hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", (F.col("pos") % 2 == 0).alias("left"), "hash"))), lambda x: F.struct(x.left.alias("sibling_is_left"), x.hash.alias("hash"))).alias("proof"))


def proves(root: str, leaf: str, proof: list[tuple[bool, str]]) -> bool:
    h = bytes.fromhex(leaf)
    for left, other in proof:
        o = bytes.fromhex(other)
        h = hashlib.sha256(o + h if left else h + o).digest()
    return h.hex() == root


def revoked(ids: DataFrame, marks: DataFrame) -> DataFrame:
    """(status, revoked): whether an index of the status list is marked."""
    return ids.join(marks.select("status").distinct().withColumn("_r", F.lit(True)), "status", "left").select("status", F.coalesce("_r", F.lit(False)).alias("revoked"))


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data), ""
    while n:
        n, r = divmod(n, 58)
        out = _B58[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def unbase58(text: str) -> bytes:
    n = 0
    for c in text:
        n = n * 58 + _B58.index(c)
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8)


def did_key(public: bytes) -> str:
    """The identifier of an Ed25519 public key."""
    return "did:key:z" + base58(b"\xed\x01" + public)


def key_of_did(did: str) -> bytes:
    data = unbase58(did.removeprefix("did:key:z"))
    if not did.startswith("did:key:z") or data[:2] != b"\xed\x01" or len(data) != 34:
        raise ValueError("no Ed25519 key")
    return data[2:]


# --- Ed25519 as RFC 8032 describes it; slow, for signatures of batches and heads of logs -----------

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(s: int, p):
    q = (0, 1, 1, 0)
    while s:
        if s & 1:
            q = _add(q, p)
        p, s = _add(p, p), s >> 1
    return q


def _x(y: int, odd: int) -> int | None:
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    if not square:
        return None if odd else 0
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _I % _P
    if (x * x - square) % _P:
        return None
    return _P - x if x & 1 != odd else x


_GY = 4 * pow(5, -1, _P) % _P
_G = (_x(_GY, 0), _GY, 1, _x(_GY, 0) * _GY % _P)


def _pack(p) -> bytes:
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    y = int.from_bytes(data, "little")
    x = _x(y & (1 << 255) - 1, y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % _P)


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def public_key(key: bytes) -> bytes:
    return _pack(_times(_secret(key)[0], _G))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    r = _number(prefix, message)
    point = _pack(_times(r, _G))
    return point + ((r + _number(point, public_key(key), message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    left, right = _times(s, _G), _add(r, _times(_number(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


def fact_record(s: str, r: str, o: str, sequence: int, key: bytes) -> dict:
    """A signed claim of a fact."""
    content = hashlib.sha256(canonical([s, r, o]).encode()).hexdigest()
    claim = {"content": content, "sequence": sequence, "issuer": did_key(public_key(key))}
    return claim | {"signature": sign(key, canonical(claim).encode()).hex()}


def check_record(record: dict, s: str, r: str, o: str, trusted: set[str] | None = None) -> list[tuple[str, bool]]:
    """Named checks, all of which must hold."""
    claim = {k: v for k, v in record.items() if k != "signature"}
    return [
        ("content", record["content"] == hashlib.sha256(canonical([s, r, o]).encode()).hexdigest()),
        ("signature", verify(key_of_did(record["issuer"]), canonical(claim).encode(), bytes.fromhex(record["signature"]))),
        ("trust", trusted is None or record["issuer"] in trusted),
    ]


def encrypt(column, key, aad: str = ""):
    """AES-GCM under a key of 16, 24 or 32 bytes; the nonce goes before the ciphertext. aad is bound to it, unencrypted, and needed again."""
    return F.aes_encrypt(column, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad.encode()))


def decrypt(column, key, aad: str = ""):
    """What ``encrypt`` was given; an error if key, aad or data differ."""
    return F.aes_decrypt(column, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad.encode()))


def derive_key(password: str, salt: bytes) -> bytes:
    """32 bytes by scrypt."""
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)
