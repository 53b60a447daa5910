"""Token shards in training order.

Documents become token ids, are packed with an end mark after each into
sequences of fixed length, and every sequence gets a global number: sequences
are numbered within their input task, and a row per task carries the offset.  A
keyed Feistel network permutes the numbers.  It works on pairs of digits to the
base ``ceil(sqrt(n))``, hence on hardly more values than there are sequences,
and a value outside is sent through again until it falls inside (cycle
walking).  Slot s lies in shard ``s // per_shard`` at byte
``(s % per_shard) * stride``: shards are ranges of slots, each written by one
task as one binary file of records of equal length.  Reading in training order
is reading files from front to back, and a run resumes at any slot by seeking.

A record is ``length`` unsigned 16-bit little-endian ids and a line feed, which
lets Spark's own committed writer produce the files.  Only the last sequence of
an input task is padded, with the end mark.  On their way sequences are packed
with zstandard and a raw dictionary of bounded size, because the stored
sequences, their exchange and the shards exist side by side.

Nulls: a null text is an empty document, of which only the end mark remains.  Ids
of documents are carried along as they are; repeated rows are packed again.  An
empty table gives no sequences.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegov.llm import bpe
from tablegov.llm.common import text_batches, written
from tablegov.session import ensure_checkpoint_dir

LENGTH = 2_048
PER_SHARD = 4_096
_ROUNDS = 6
_WALKS = 64
_LEVEL = 6
_DICTIONARY_BYTES = 112 << 10

_TOKENISERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def _tokeniser(digest: str, shared, pattern: str) -> tiktoken.Encoding:
    """The one a worker process keeps, by the digest of its tokens; ``shared`` holds their bytes."""
    if (digest, pattern) not in _TOKENISERS:
        _TOKENISERS.clear()
        _TOKENISERS[digest, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks={t: r for r, t in enumerate(shared.value)}, special_tokens={})
    return _TOKENISERS[digest, pattern]


def _ids(tokeniser: tiktoken.Encoding, text: str | None) -> np.ndarray:
    return tokeniser.encode_to_numpy(text or "", disallowed_special=())


class Packing:
    """Compression of single sequences with a dictionary of typical ones."""

    def __init__(self, dictionary: bytes):
        self.dictionary = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def press(self):
        return zstandard.ZstdCompressor(level=_LEVEL, dict_data=self.dictionary).compress

    def unpress(self):
        return zstandard.ZstdDecompressor(dict_data=self.dictionary).decompress


def typical(docs: DataFrame, tokeniser: tiktoken.Encoding, text_col: str = "text") -> bytes:
    """Ids of a few documents: only a compression dictionary, results never depend on it."""
    rows = docs.select(F.substring(text_col, 1, _DICTIONARY_BYTES)).limit(32).collect()
    return b"".join(_ids(tokeniser, t).astype("<u2").tobytes() for t, in rows)[:_DICTIONARY_BYTES]


def pack(docs: DataFrame, vocabulary: str, pattern: str, length: int = LENGTH, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Sequences: ``task``, ``at`` (number within the task), ``first_doc`` (the
    document of its first token), ``n_tokens`` without padding, ``crc32`` and
    ``packed`` ids; and the dictionary of the packing."""
    spark = docs.sparkSession
    text_batches(spark)
    tokens = bpe.read_ranks(vocabulary)
    end_mark = len(tokens)
    if end_mark >= 1 << 16:
        raise ValueError("the vocabulary does not fit 16-bit ids")
    digest = hashlib.sha256(b"\n".join(map(base64.b64encode, tokens))).hexdigest()
    shared = spark.sparkContext.broadcast(tokens)
    dictionary = typical(docs, _tokeniser(digest, shared, pattern), text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser, press = _tokeniser(digest, shared, pattern), Packing(dictionary).press()
        task, at = TaskContext.get().partitionId(), 0
        rest, rest_doc = np.empty(0, "<u2"), None
        end = np.array([end_mark], "<u2")

        def rows(flat, first, counts):
            nonlocal at
            data = [flat[i * length:(i + 1) * length].tobytes() for i in range(len(counts))]
            out = pa.RecordBatch.from_arrays(
                [pa.array([task] * len(data), pa.int32()), pa.array(range(at, at + len(data)), pa.int64()), first,
                 pa.array(counts, pa.int32()), pa.array([zlib.crc32(d) for d in data], pa.int64()),
                 pa.array([press(d) for d in data], pa.binary())],
                names=["task", "at", "first_doc", "n_tokens", "crc32", "packed"])
            at += len(data)
            return out

        for batch in batches:
            ids = batch.column(0)
            each = [_ids(tokeniser, t).astype("<u2") for t in batch.column(1).to_pylist()]
            flat = np.concatenate([rest, *[part for e in each for part in (e, end)]])
            edges = np.cumsum([len(rest), *[len(e) + 1 for e in each]])
            n = len(flat) // length
            owner = np.searchsorted(edges, np.arange(n + 1) * length, side="right") - 1
            docs_of = [rest_doc if o < 0 else ids[o].as_py() for o in owner.tolist() if o < len(ids)]
            if n:
                yield rows(flat, pa.array(docs_of[:n], ids.type), [length] * n)
            rest = flat[n * length:]
            rest_doc = docs_of[n] if len(rest) else None
        if len(rest):
            padded = np.concatenate([rest, np.repeat(end, length - len(rest))])
            yield rows(padded, pa.array([rest_doc], ids.type), [len(rest)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"task int, at bigint, first_doc {kind}, n_tokens int, crc32 bigint, packed binary"), dictionary


def permuted(number: Column, n: int, key: int) -> Column:
    """Place of ``number`` (0 .. n - 1) under the permutation chosen by ``key``."""
    base = max(2, math.isqrt(max(n - 1, 0)) + 1)

    def network(x: Column) -> Column:
        # One round maps (a, b) to (b, a + f(b)), modulo the base, in the digits of x = a * base + b.
        return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), x, lambda v, r: (v % base) * base + F.pmod(
            F.floor(v / F.lit(base)) + F.pmod(F.xxhash64(F.lit(key), r, v % base), F.lit(base)), F.lit(base)))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALKS)), network(number), lambda v, _: F.when(
        v >= n, network(v)).otherwise(v))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def place(sequences: DataFrame, key: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``sequences`` (stored) with ``seq``, ``slot``, ``shard`` and ``byte_offset``."""
    spark = sequences.sparkSession
    counts = sorted(sequences.groupBy("task").agg(F.max("at") + 1).collect())  # a row per input task
    offsets, n = [], 0
    for task, many in counts:
        offsets.append((task, n))
        n += many
    table = spark.createDataFrame(offsets, "task int, before bigint")
    numbered = sequences.join(F.broadcast(table), "task").withColumn("seq", F.col("before") + F.col("at"))
    slot = permuted(F.col("seq"), n, key)
    placed = numbered.withColumn("slot", slot).drop("before")
    return placed.withColumn("shard", F.floor(F.col("slot") / per_shard)).withColumn(
        "byte_offset", (F.col("slot") % per_shard) * (2 * length + 1))


def write_shards(placed: DataFrame, path: str, shards: int, dictionary: bytes) -> None:
    """A folder ``shard=<number>`` with one file of fixed-stride records each."""
    if not shards:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = Packing(dictionary).unpress()
        for batch in batches:
            plain = [unpress(b) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(plain, pa.binary())], names=["shard", "slot", "ids"])

    ranged = placed.select("shard", "slot", "packed").repartitionByRange(shards, "shard")
    plain = ranged.mapInArrow(run, "shard bigint, slot bigint, ids binary").sortWithinPartitions("shard", "slot")
    plain.select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").option(
        "lineSep", "\n").text(path)


def read_slots(spark: SparkSession, path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot`` and ``ids`` of ``count`` slots from ``first`` on: only the files
    that hold them are read."""
    shards = range(first // per_shard, (first + count - 1) // per_shard + 1)
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").load([f"{path}/shard={s}" for s in shards])
    number = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    begin = F.greatest(F.lit(first) - number * per_shard, F.lit(0))
    until = F.least(F.lit(first + count) - number * per_shard, F.floor(F.col("length") / stride))
    each = files.select("content", number.alias("n"), F.explode(F.sequence(begin, until - 1)).alias("i"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.conv(F.hex(F.concat(
        F.substring(F.col("r"), k * 2 + 2, F.lit(1)), F.substring(F.col("r"), k * 2 + 1, F.lit(1)))), 16, 10).cast("int"))
    record = F.substring("content", (F.col("i") * stride + 1).cast("int"), F.lit(2 * length))
    return each.select((F.col("n") * per_shard + F.col("i")).alias("slot"), record.alias("r")).select(
        "slot", ids.alias("ids"))


def materialise(docs: DataFrame, vocabulary: str, pattern: str, key: int, path: str | None = None,
                length: int = LENGTH, per_shard: int = PER_SHARD) -> tuple[DataFrame, str]:
    """Write the shards below ``path`` (default: the shared checkpoint folder)
    and return their index, one row per sequence, and the path."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or f"{spark.sparkContext.getCheckpointDir()}/order-{uuid.uuid4().hex}"
    sequences, dictionary = pack(docs, vocabulary, pattern, length)
    sequences = written(sequences, "sequences")
    placed = place(sequences, key, length, per_shard)
    write_shards(placed, path, math.ceil(sequences.count() / per_shard), dictionary)
    return placed.drop("packed"), path
