"""Encoding of a corpus by a public byte-level BPE vocabulary (problem 8).

A sentencepiece BPE model is serialised directly from the vocabulary: every token
becomes a piece, its bytes mapped one by one to visible characters, scored by its
negative rank; normalisation is the identity. Texts are cut into pre-tokens by
the vocabulary's pattern, distinct pre-tokens are encoded as pieces, and ids are
the ranks. Decoding inverts the byte mapping.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.runtime import ship

# Folder of the vocabulary files; the files are read where they are.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pre-token pattern of byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pre-tokens kept encoded by a worker, and the longest that is kept.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64


def byte_characters() -> dict[int, str]:
    """One visible character per byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    mapping = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in mapping:
            mapping[b] = chr(0x100 + len(mapping) - len(printable))
    return mapping


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, payload: bytes | int) -> bytes:
    head = _varint(number << 3 | kind)
    if kind == 2:
        return head + _varint(len(payload)) + payload
    return head + (_varint(payload) if kind == 0 else payload)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """Protobuf bytes of a sentencepiece BPE model with the given vocabulary.

    Piece 0 is the unknown piece that the format requires; piece r + 1 is the
    token of the r-th smallest rank. Ranks must be distinct.
    """
    chars = byte_characters()
    pieces = [_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, 2))]
    for order, (token, _) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, 2, _field(1, 2, text) + _field(2, 5, struct.pack("<f", -float(order)))))
    # model type 2 is BPE; unknown id 0, no begin, end or padding piece
    minus = (1 << 64) - 1
    trainer = _field(3, 0, 2) + _field(4, 0, len(pieces)) + _field(40, 0, 0) + _field(41, 0, minus) + _field(42, 0, minus) + _field(43, 0, minus)
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.ids = [rank for _, rank in sorted(ranks.items(), key=lambda x: x[1])]
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = sentencepiece.SentencePieceProcessor()
        self.pieces.LoadFromSerializedProto(serialise_model(ranks))
        self.cut = regex.compile(pattern)
        self.chars = {b: c for b, c in byte_characters().items()}
        self.table = {i: c for i, c in self.chars.items()}
        self.cache: dict[str, list[int]] = {}

    def _encode_new(self, pre: list[str]) -> list[list[int]]:
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for p in pre]
        return [[self.ids[i - 1] for i in ids] for ids in self.pieces.encode(mapped, num_threads=1)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have no ids."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        fresh = list({p for pre in cut for p in pre if p not in self.cache})
        if len(self.cache) + len(fresh) > CACHE_ENTRIES:
            self.cache.clear()
            fresh = list({p for pre in cut for p in pre})
        local = dict(zip(fresh, self._encode_new(fresh), strict=True)) if fresh else {}
        self.cache.update((p, ids) for p, ids in local.items() if len(p) <= CACHE_CHARS)
        out = []
        for pre in cut:
            ids: list[int] = []
            for p in pre:
                ids += local[p] if p in local else self.cache[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file, built once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text by the vocabulary, without special tokens.

    Null and empty texts have an empty list. The strings of special tokens are
    ordinary text. Whole texts of any length are encoded; other columns are
    ignored; repeated rows are encoded each. No shuffle unless the input has
    fewer partitions than the cluster has cores.
    """
    path = os.path.join(folder or TOKENIZERS, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            # small slices bound the Python objects alive at once
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                ids = own.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    slim = documents.select(F.col(id_col).cast("long").alias(id_col), text_col)
    cores = documents.sparkSession.sparkContext.defaultParallelism
    if slim.rdd.getNumPartitions() < cores:
        slim = slim.repartition(cores)
    ship(slim.sparkSession)
    return slim.mapInArrow(encode, f"`{id_col}` long, ids array<long>")
