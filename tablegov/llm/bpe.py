"""Byte-level BPE with a sentencepiece model built straight from a rank file.

The model is never trained: its protobuf is written here from the vocabulary.
Every token becomes one piece, its bytes mapped to printable characters, with
the negative rank as score, so that the best-scored merge is the one of lowest
rank.  Normalisation is the identity and no prefix is added.  A text is split
by the pre-token pattern, every pre-token is encoded by itself, and decoding
maps the ids back to bytes.

Nulls: a null text is an empty text and has no ids.  Ids of rows, repeated rows
and other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches

# Pre-tokens in one generation of a worker's memory, besides those of the last batch.
CACHE_SIZE = 150_000

# Numbers of the public sentencepiece model format.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it,
    else the next one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model.  Piece 0 is the unknown piece, which no text
    reaches because all 256 bytes are pieces; rank r is piece r + 1."""
    chars = byte_characters()
    pieces = [_piece("<unk>", 0.0, _UNKNOWN)]
    pieces += [_piece("".join(chars[b] for b in token), -float(rank), _NORMAL) for rank, token in enumerate(tokens)]
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, 0) + b"".join(
        _number(field, -1) for field in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encodes batches of texts.  What a worker has learnt of pre-tokens is kept
    in two generations: when the younger is full it becomes the older one, and
    only what is met again moves on."""

    def __init__(self, proto: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        # Ids as 32-bit numbers, so that joining them gives the ids of a text.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.find(t or "") for t in texts]
        if len(self.known) > CACHE_SIZE:
            self.older, self.known = self.known, {}
        new = []
        for part in set().union(*parts).difference(self.known):
            ids = self.older.get(part)
            if ids is None:
                new.append(part)
            else:
                self.known[part] = ids
        if new:
            mapped = [p.encode().decode("latin-1").translate(self.chars) for p in new]
            for part, ids in zip(new, self.model.encode(mapped, num_threads=1)):
                self.known[part] = struct.pack(f"<{len(ids)}i", *[i - 1 for i in ids])
        look_up = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look_up, p)), "<i4") for p in parts]

    def ids(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(digest: str, shared, pattern: str) -> Encoder:
    """The encoder that a worker process keeps, by the digest of its model."""
    if (digest, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest, pattern] = Encoder(shared.value, pattern)
    return _ENCODERS[digest, pattern]


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a text column and others as the others and ids."""
    for batch in batches:
        rows = encoder.batch(batch.column(0).to_pylist())
        ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=names)


def _decoded(tokens: list[bytes], batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with one column more, the bytes that the ids in column ``at`` stand for."""
    token = tokens.__getitem__
    for batch in batches:
        ends = batch.column(at).offsets.to_pylist()
        flat = batch.column(at).values.to_numpy().tolist()
        out = [b"".join(map(token, flat[a:b])) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: list[str] | None = None, with_decoded: bool = False) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``ids``, an array of token ids;
    ``with_decoded`` adds what ``decode`` adds, in the same Python worker."""
    spark = docs.sparkSession
    text_batches(spark)
    ranks = read_ranks(vocabulary)
    proto = model_proto(ranks)
    digest, shared = hashlib.sha256(proto).hexdigest(), spark.sparkContext.broadcast(proto)  # fixed size: one vocabulary
    tokens = spark.sparkContext.broadcast(ranks) if with_decoded else None
    kept = [id_col, *[c for c in keep or [] if c != id_col]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _encoded(_encoder(digest, shared, pattern), batches, [*kept, "ids"])
        return out if tokens is None else _decoded(tokens.value, out, len(kept), [*kept, "ids", "decoded"])

    return docs.select(F.col(text_col).alias("_t"), *kept).mapInArrow(
        run, f"{_schema(docs, kept)}, ids array<int>" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its ``ids`` stand for."""
    spark = encoded.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(shared.value, batches, at, [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, f"{_schema(encoded, names)}, decoded binary")
