"""Log-likelihood of whole documents under a gated recurrent language model.

All counts come from every training document: words are counted by Spark, the
most frequent (``known_words``, a fixed number) are sent to the tasks, and every
rarer word is looked up by a join on its hash.  Documents are encoded once and
written as 16-bit model tokens; what the counts say about rarer words is summed
up beside them.

Training is rounds of local descent: in each round every task starts from the
same weights, goes through its share of the round's documents with truncated
back-propagation, and gives its weights, which are averaged by the number of
tokens in two levels of grouping, block by block.  Every training document is in
exactly one round, so the work grows with the corpus; the weights do not.
Gradients are taken in every window.

Scoring carries the state through the windows of a document, whatever its
length.  The result is log10 P(text): a rarer word has the probability of its
bucket in this state times its smoothed share of the bucket.

Nulls: a null text is an empty one, which has its end mark only; a null id has
the hash of an empty text and counts as held out.  Repeated rows are trained on
and scored one by one.  Without any training document all counts are zero and
the model is untrained.  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.llm import gru_lm
from tablegov.llm.common import text_batches, written

KNOWN_WORDS = 1 << 18
MODEL_WORDS = 2_048
BUCKETS = 48
WORD_CLASSES = 32
HIDDEN = 16
ROUNDS = 3
RATES = (0.3, 0.15, 0.08)

_ADD = 0.1
_SEED = 42
_FLUSH = 300_000       # distinct words a counting task holds before it passes them on
_BUFFER = 4_000_000    # tokens a training or scoring task lays out at once
_CHUNK = 1 << 14       # weights per row while averaging


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def bucket_of(word: bytes, buckets: int) -> int:
    """Words with the same first two bytes and last byte share a bucket."""
    h = xxhash.xxh64_intdigest(word[:2] + b"|" + word[-1:], _SEED)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _bucket(word: Column, buckets: int) -> Column:
    key = F.concat(F.substring(word, 1, 2), F.lit(b"|"), F.substring(word, -1, 1))
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(docs: DataFrame) -> DataFrame:
    """``w``, ``n``, ``h`` (XXH64 of the word), ``b`` (bucket) over ``docs.t``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    counted = docs.select("t").mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return counted.select("w", "n", F.xxhash64("w").alias("h"), _bucket(F.col("w"), BUCKETS).alias("b"))


@dataclass
class Lexicon:
    """What a task knows of the words: rank by word, and per rank the count's
    logarithms and the model token.  The last entry of each array is for words
    that are not known here."""
    rank: dict[bytes, int]
    base: np.ndarray
    tail: np.ndarray
    token: np.ndarray
    end_base: float
    end_known: int
    z: float                # denominator of the base score
    bucket_z: np.ndarray    # denominators within the buckets
    total: int
    spec: gru_lm.Spec
    counts: np.ndarray      # of the model tokens


def lexicon(counts: DataFrame, train_docs: int, known_words: int = KNOWN_WORDS) -> Lexicon:
    """From the stored word counts; at most ``known_words`` words come to the driver."""
    words = total = taken = least = 0
    full = False
    for n, many in counts.groupBy("n").count().orderBy(F.col("n").desc()).toLocalIterator():
        words, total = words + many, total + n * many
        full = full or taken + many > known_words
        if not full:
            taken, least = taken + many, n
    top = counts.where(F.col("n") >= least).select("w", "n").toArrow() if taken else None
    known = sorted(zip(top.column(0).to_pylist(), top.column(1).to_pylist()), key=lambda x: (-x[1], x[0])) if taken else []
    model_words = min(MODEL_WORDS, len(known))
    n_b, v_b = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, n, v in counts.groupBy("b").agg(F.sum("n"), F.count("*")).collect():
        n_b[b], v_b[b] = n, v
    for w, n in known[:model_words]:
        b = bucket_of(w, BUCKETS)
        n_b[b], v_b[b] = n_b[b] - n, v_b[b] - 1
    total += train_docs
    z = total + _ADD * (words + (train_docs > 0) + 1)
    bucket_z = n_b + _ADD * (v_b + 1)
    n = np.array([c for _, c in known], float)
    owner = np.array([bucket_of(w, BUCKETS) for w, _ in known], np.int64)
    token = np.where(np.arange(len(known)) < model_words, np.arange(len(known)), model_words + owner)
    tail = np.where(np.arange(len(known)) < model_words, 0.0, np.log10((n + _ADD) / bucket_z[owner]))
    spec = gru_lm.Spec(model_words, BUCKETS, HIDDEN, gru_lm.word_classes(n[:model_words], WORD_CLASSES))
    return Lexicon({w: i for i, (w, _) in enumerate(known)}, np.r_[np.log10((n + _ADD) / z), 0.0], np.r_[tail, 0.0],
                   np.r_[token, 0].astype(np.uint16), float(np.log10((train_docs + _ADD) / z)), int(train_docs > 0),
                   float(z), bucket_z, int(total), spec, np.r_[n[:model_words], n_b, train_docs])


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """``docs`` (``id``, ``held``, ``t``) as model tokens: ``rid``, ``id``,
    ``held``, ``round``, ``n_tokens``, ``known``, ``base``, ``tail``, ``ids``
    (16-bit, end mark last) and ``rare`` (hash, bucket, times)."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)  # a fixed number of words
    kind = docs.schema["id"].dataType.simpleString()
    names = ["rid", "id", "held", "round", "n_tokens", "known", "base", "tail", "ids", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        get, unknown, spec = x.rank.get, len(x.rank), x.spec
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            size = batch.num_rows
            n, known, base, tail = (np.zeros(size, d) for d in (np.int64, np.int64, float, float))
            ids, ends, hashes, owners, times = [], [0], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                rank = np.fromiter(map(get, words, repeat(unknown)), np.int64, len(words))
                token = np.empty(len(words) + 1, "<u2")
                token[:-1], token[-1] = x.token[rank], spec.end
                rare = np.flatnonzero(rank == unknown)
                if len(rare):
                    mine = Counter()
                    for at in rare.tolist():
                        w = words[at]
                        b = bucket_of(w, spec.buckets)
                        token[at] = spec.words + b
                        mine[xxhash.xxh64_intdigest(w, _SEED), b] += 1
                    hashes += [h for h, _ in mine]
                    owners += [b for _, b in mine]
                    times += mine.values()
                ids.append(token.tobytes())
                ends.append(len(hashes))
                n[i], known[i] = len(words) + 1, len(words) - len(rare) + x.end_known
                base[i], tail[i] = x.base[rank].sum() + x.end_base, x.tail[rank].sum()
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(owners, pa.int32()), pa.array(times, pa.int32())],
                names=["h", "b", "m"]))
            rids = rid + np.arange(size)
            rid += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), batch.column(0), batch.column(1), pa.array((rids % ROUNDS).astype(np.int32)), pa.array(n), pa.array(known),
                 pa.array(base), pa.array(tail), pa.array(ids, pa.binary()), rare], names=names)

    return docs.select("id", "held", "t").mapInArrow(
        run, f"rid bigint, id {kind}, held boolean, round int, n_tokens bigint, known bigint, base double, tail double, "
             "ids binary, rare array<struct<h:bigint,b:int,m:int>>")


def _buffers(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and their token arrays, some million tokens at a time."""
    kept, docs, size = [], [], 0
    for batch in batches:
        kept.append(batch)
        new = [np.frombuffer(b, "<u2").astype(np.int32) for b in batch.column(column).to_pylist()]
        docs += new
        size += sum(map(len, new))
        if size >= _BUFFER:
            yield kept, docs
            kept, docs, size = [], [], 0
    if docs:
        yield kept, docs


def train_round(encoded: DataFrame, spec: gru_lm.Spec, weights: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one round over ``encoded``: the mean over the tasks."""
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru_lm.Gru.from_flat(spec, shared.value.copy())
        memory = {k: np.full_like(v, 1e-8) for k, v in model.w.items()}
        n = 0
        for _, docs in _buffers(batches, 0):
            n += gru_lm.train(model, docs, memory, rate)
        if n:
            flat = model.flat() * np.float32(n)
            parts = [flat[i:i + _CHUNK].tobytes() for i in range(0, len(flat), _CHUNK)]
            k = len(parts)
            group = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array([group] * k, pa.int32()), pa.array([float(n)] * k), pa.array(parts, pa.binary())],
                names=["chunk", "part", "n", "w"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(float) for b in table.column("w").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1],
                         "n": pa.array([float(np.sum(table.column("n").to_numpy()))]),
                         "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "chunk int, part int, n double, w binary"
    given = encoded.select("ids").mapInArrow(run, schema)
    mean = given.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    rows = sorted(mean.collect())  # as many rows as the weights have blocks
    if not rows:
        return weights
    return np.concatenate([np.frombuffer(w, np.float32) / np.float32(n) for _, _, n, w in rows])


def train(encoded: DataFrame, lex: Lexicon) -> np.ndarray:
    weights = gru_lm.Gru.start(lex.spec, lex.counts).flat()
    mine = encoded.where("NOT held")
    for number in range(ROUNDS):
        weights = train_round(mine.where(F.col("round") == number), lex.spec, weights, RATES[number])
    return weights


def log_likelihood(encoded: DataFrame, spec: gru_lm.Spec, weights: np.ndarray) -> DataFrame:
    """``encoded`` without ``ids`` and ``rare``, with ``logp`` (natural logarithm)."""
    shared = encoded.sparkSession.sparkContext.broadcast(weights)
    names = ["rid", "id", "held", "n_tokens", "known", "base", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru_lm.Gru.from_flat(spec, shared.value)
        for kept, docs in _buffers(batches, len(names)):
            log_p = gru_lm.score(model, docs, lanes=384)
            at = 0
            for batch in kept:
                part = pa.array(log_p[at:at + batch.num_rows])
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], part], names=[*names, "logp"])

    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    return encoded.select(*names, "ids").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", logp double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (both log10)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held"),
                       F.col(text_col).cast("binary").alias("t"))
    training = rows.where("NOT held")
    counts = written(count_words(training), "words")
    lex = lexicon(counts, training.count())
    encoded = written(encode(rows, lex), "encoded")
    rated = log_likelihood(encoded, lex.spec, train(encoded, lex))
    rare = encoded.where(F.size("rare") > 0).select("rid", F.inline("rare")).join(
        counts.select(F.col("h").alias("wh"), "n"), F.col("h") == F.col("wh"), "left")
    n = F.coalesce("n", F.lit(0))
    within = F.get(F.array(*[F.lit(float(z)) for z in lex.bucket_z]), F.col("b"))
    rare = rare.groupBy(F.col("rid").alias("r")).agg(
        F.sum(F.when(n > 0, F.col("m")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("m") * F.log10((n + _ADD) / lex.z)).alias("rare_base"),
        F.sum(F.col("m") * F.log10((n + _ADD) / within)).alias("rare_tail"))
    out = rated.join(rare, F.col("rid") == F.col("r"), "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("logp") / float(np.log(10)) + F.col("tail") + F.coalesce("rare_tail", zero)).alias("score"))
