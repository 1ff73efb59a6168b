"""Evidence-diverse selection, canonical records, a Merkle log and signatures. Driver-side and bounded."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest pool that the greedy selection takes to the driver, and the overlap it still accepts.
POOL, OVERLAP = 2_000, 0.25


def diverse(scored: DataFrame, id_col: str, score: str, support: str, k: int, pool: int = POOL, overlap: float = OVERLAP) -> list:
    """Ids of up to k best rows whose support sets overlap little with any chosen before.

    Greedy by score, then id, over the ``pool`` best rows with a score and a support;
    a greedy choice is sequential by nature, so the pool is what bounds it.
    """
    rows = scored.where(F.col(score).isNotNull() & (F.size(support) > 0)).orderBy(F.desc(score), F.asc(id_col)).limit(pool).select(id_col, support).collect()
    chosen, sets = [], []
    for r in rows:
        s = frozenset(r[support])
        if all(len(s & t) <= overlap * len(s | t) for t in sets):
            chosen.append(r[id_col])
            sets.append(s)
            if len(chosen) == k:
                break
    return chosen


def canonical(record: dict) -> bytes:
    """ASCII JSON bytes with sorted keys, no blanks, no NaN."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode("ascii")


def leaf(record: dict) -> str:
    """Hex digest of a record's canonical bytes."""
    return hashlib.sha256(canonical(record)).hexdigest()


# Fixed value: the head of an empty log.
GENESIS = "0" * 64


def _pair(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode("ascii")).hexdigest()


class Log:
    """Append-only log whose head commits to all records before it.

    A node is the digest of its children's hex digests; an odd node is paired with
    itself. The right edge of the tree is kept, so appending costs the depth of the
    tree and not its size.
    """

    def __init__(self) -> None:
        self.leaves: list[str] = []
        self.heads: list[str] = []
        # roots of the full subtrees from the left: (height, digest)
        self._full: list[tuple[int, str]] = []

    def append(self, record: dict) -> str:
        self.leaves.append(leaf(record))
        node, height = self.leaves[-1], 0
        while self._full and self._full[-1][0] == height:
            node, height = _pair(self._full.pop()[1], node), height + 1
        self._full.append((height, node))
        self.heads.append(self._head())
        return self.heads[-1]

    def _head(self) -> str:
        height, node = self._full[-1]
        for above, full in reversed(self._full[:-1]):
            while height < above:  # a level on which this node has no neighbour
                node, height = _pair(node, node), height + 1
            node, height = _pair(full, node), height + 1
        return node

    def verify(self, records: list[dict]) -> bool:
        """Whether the records are exactly those of the log, in order."""
        again = Log()
        for r in records:
            again.append(r)
        return again.leaves == self.leaves and again.heads == self.heads


def merkle_root(leaves: list[str]) -> str:
    """Root over leaf digests, level by level; no leaves: the head of an empty log."""
    level = list(leaves)
    while len(level) > 1:
        level = [_pair(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    return level[0] if level else GENESIS


def replay_digest(record: dict, field: str = "replay_sha256") -> str:
    """Digest of a record with its own digest field blank."""
    return hashlib.sha256(canonical({**record, field: ""})).hexdigest()


# Fixed values of Ed25519 (RFC 8032).
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_BY = 4 * pow(5, _P - 2, _P) % _P


def _recover(y: int, odd: int) -> int:
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if (x * x - square) % _P:
        raise ValueError("no point of the curve")
    return _P - x if x & 1 != odd else x


def _add(a: tuple, b: tuple) -> tuple:
    (x1, y1, z1, t1), (x2, y2, z2, t2) = a, b
    p, q = (y1 - x1) * (y2 - x2) % _P, (y1 + x1) * (y2 + x2) % _P
    r, s = 2 * t1 * t2 * _D % _P, 2 * z1 * z2 % _P
    e, f, g, h = q - p, s - r, s + r, q + p
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point = _add(point, point)
        n >>= 1
    return out


def _pack(point: tuple) -> bytes:
    inverse = pow(point[2], _P - 2, _P)
    x, y = point[0] * inverse % _P, point[1] * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> tuple:
    n = int.from_bytes(data, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    x = _recover(y, odd)
    return x, y, 1, x * y % _P


_BASE = (_recover(_BY, 0), _BY, 1, _recover(_BY, 0) * _BY % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    """Ed25519 signature of a message."""
    a, prefix = _secret(seed)
    r = _hash(prefix, message) % _L
    big_r = _pack(_times(r, _BASE))
    s = (r + _hash(big_r, public_key(seed), message) * a) % _L
    return big_r + s.to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is the key's over the message."""
    if len(signature) != 64 or len(key) != 32:
        return False
    s = int.from_bytes(signature[32:], "little")
    if s >= _L:
        return False
    try:
        r, a = _unpack(signature[:32]), _unpack(key)
    except ValueError:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_hash(signature[:32], key, message) % _L, a))
    return _pack(left) == _pack(right)
