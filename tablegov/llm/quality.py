"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

The model is fitted on all documents labelled as good and not toxic of one half,
chosen by a hash of their id.  Neither their number nor that of their words has
a bound, and no n-gram table passes through the driver or is broadcast: n-grams
are dealt over shards by their middle word, so that a shard has the trigram, its
context, its shorter n-gram and that one's context together.  Trusted documents
are counted shard by shard; the n-grams of every document go to the same shards,
are looked up in the tables counted there and come back as sums per document.

A word is its place among the ``FREQUENT`` most frequent words of the trusted
documents, which are broadcast, or else its XXH64 with the top bit set; n-grams
are told apart by 64 bits mixed from their words.  A middle word with more than
an even share of all words is dealt over several shards by the word before it.
Its bigram counts are then added up over these and handed back to each of them.
Probabilities of the other words come by joins on the word.

The perplexity of every document is computed over its whole text.  Documents are
scored in ``ROUNDS``, by the hash of their text, because their n-grams take several
times the disk that they do: a round's n-grams leave it before the next one, and
the tables of a shard are made again in each.  ``docs`` is read once a round.  The
threshold of a language is a high quantile over all its trusted documents of the
half that is never fitted; a language without any takes the quantile over all
languages.  Documents above it are rejected.

Nulls: a null text is an empty one (only its end is scored); a null language is
a language of its own.  A document without words is not kept.  Repeated rows are
scored alike and each keeps its row.  Without trusted documents nothing can be
judged, and every document with words is kept; with very few, the quantile is
their largest perplexity.  Empty tables give an empty
result.  Other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import lent, shuffles_freed, small_batches, text_batches, written

QUANTILE = 0.999
# Words with a number of two bytes; the others travel as hashes.
FREQUENT = 65_000
# Trusted trigrams of a shard, and words and documents whose n-grams are sent together.
SHARD_GRAMS = 1 << 20
CHUNK_WORDS = 1 << 18
CHUNK_DOCS = 60_000
KNOWN_WORDS = 200_000
ROUNDS = 4

_BOS, _EOS, _FIRST_WORD = 0, 1, 2
_RARE = 0xFFFF
_SEED = 42
# Rows that a shard gets, in the order in which it needs them.
_WORD, _SPREAD, _FITTED, _SCORED, _DOCS = range(5)
_PARCEL = "shard int, kind int, chunk bigint, n int, size int, data binary, a bigint, b bigint, x double"
_PARCEL_COLUMNS = ["shard", "kind", "chunk", "n", "size", "data", "a", "b", "x"]
# Counts of counts of trigrams and bigrams, words after unspread words, and bigrams of spread ones.
_TRI_COUNTS, _BI_COUNTS, _LAST, _PAIR = range(4)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words (A-Z only); full stops and commas stand alone."""
    return (text or b"").lower().replace(b".", b" . ").replace(b",", b" , ").split()


def _hash(word: bytes) -> int:
    """A negative number for each word."""
    return (xxhash.xxh64_intdigest(word, _SEED) | 1 << 63) - (1 << 64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits from two numbers."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += b.view(np.uint64)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _spot(word: np.ndarray) -> np.ndarray:
    return (mix(word, np.zeros(1, np.uint64)) >> np.uint64(20)).astype(np.int64)


@dataclass
class Dealing:
    """The numbered words and over how many shards each is dealt as a middle word."""
    numbers: dict[int, int]
    spread: np.ndarray
    shards: int

    def shard(self, before: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return (_spot(middle) + _spot(before) % self.over(middle)) % self.shards

    def over(self, middle: np.ndarray) -> np.ndarray:
        return np.where(middle >= 0, self.spread[np.maximum(middle, 0)], 1)


class _Words(dict):
    """Word to its number or hash."""

    def __init__(self, dealing: Dealing) -> None:
        self.numbers = dealing.numbers

    def __missing__(self, word: bytes) -> int:
        value = _hash(word)
        self[word] = value = self.numbers.get(value, value)
        return value

    def of(self, text: bytes | None) -> list[int]:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return list(map(self.__getitem__, words_of(text)))


def _pack(words: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[int, int, bytes]:
    """Number of n-grams, plain size and bytes: two a word and document, then the hashes."""
    every = np.concatenate(words)
    rare = every[every < 0]
    plain = np.where(every < 0, _RARE, every).astype("<u2").tobytes() + doc.astype("<u2").tobytes() + rare.astype("<i8").tobytes()
    return len(doc), len(plain), pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(n: int, size: int, data: bytes) -> tuple[np.ndarray, ...]:
    plain = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)
    every = np.frombuffer(plain, "<u2", 3 * n).astype(np.int64)
    every[every == _RARE] = np.frombuffer(plain, "<i8", offset=8 * n)
    return every[:n], every[n:2 * n], every[2 * n:], np.frombuffer(plain, "<u2", n, 6 * n).astype(np.int64)


def _parcel(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(
        arrays + [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.float64())], names=_PARCEL_COLUMNS)


def _parcels(texts: DataFrame, shared, kind: int) -> DataFrame:
    """The n-grams of (``h``, ``t``) rows by shard, and for ``_SCORED`` a row per chunk with
    the hashes and the numbers of words of its documents."""
    def send(words, sizes, hashes, chunk, dealing) -> pa.RecordBatch:
        w, doc = np.array(words, np.int64), np.repeat(np.arange(len(sizes)), np.array(sizes) + 3)
        whole = doc[2:] == doc[:-2]
        grams = [x[whole] for x in (w[:-2], w[1:-1], w[2:], doc[2:])]
        shard = dealing.shard(grams[0], grams[1])
        if kind == _FITTED:  # their documents and order do not matter and would take room
            grams[3] = np.zeros_like(grams[3])
            order = np.lexsort((grams[2], grams[0], grams[1], shard))
        else:
            order = np.argsort(shard, kind="stable")
        grams = [x[order] for x in grams]
        found, starts = np.unique(shard[order], return_index=True)
        rows = []
        for s, a, b in zip(found.tolist(), starts, [*starts[1:], len(order)]):
            rows.append((s, kind, chunk, *_pack(tuple(x[a:b] for x in grams[:3]), grams[3][a:b])))
        if kind == _SCORED:
            own = np.array(hashes, "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
            rows.append((chunk % dealing.shards, _DOCS, chunk, len(sizes), len(own), own))
        return _parcel(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing = shared.value
        known, chunk = _Words(dealing), TaskContext.get().partitionId() << 32
        words, sizes, hashes = [], [], []
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = known.of(t)
                words += (_BOS, _BOS, *own, _EOS)
                sizes.append(len(own))
                hashes.append(h)
                if len(words) >= CHUNK_WORDS or len(sizes) >= CHUNK_DOCS:
                    yield send(words, sizes, hashes, chunk, dealing)
                    chunk += 1
                    words, sizes, hashes = [], [], []
        if sizes:
            yield send(words, sizes, hashes, chunk, dealing)

    return texts.select("h", F.col("t").cast("binary").alias("t")).mapInArrow(run, _PARCEL)


def _distinct(keys: np.ndarray, places: bool = True) -> tuple[np.ndarray, ...]:
    """The values of ``keys`` in order, the place of one of each, each key's value (with ``places``) and
    how often it is there."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts, at = np.flatnonzero(new), None
    values = keys[starts]
    del keys
    first = order[starts]
    if places:
        at = np.empty(len(order), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32)
        at -= 1
    return values, first, at, np.diff(starts, append=len(order))


class _Counts:
    """The distinct trigrams of a shard's fitted rows with their words and counts, and the bigrams
    they end with: in how many trigrams, or after the start mark, which has no other word before it,
    how often.

    A shard's n-grams are most of what a Python worker holds.  So ``rows`` are taken out of their
    list one by one, and an array goes as soon as the next one is made from it."""

    def __init__(self, rows: list[tuple]) -> None:
        w1, w2, w3 = (np.empty(sum(r[0] for r in rows), np.int64) for _ in range(3))
        end = 0
        while rows:
            row = rows.pop()
            start, end = end, end + row[0]
            w1[start:end], w2[start:end], w3[start:end], _ = _unpack(*row)
        self.tri, first, _, self.n = _distinct(mix(mix(w1, w2), w3), places=False)
        self.n = self.n.astype(np.int32)
        w1 = w1[first]
        w2 = w2[first]
        w3 = w3[first]
        self.context = mix(w1, w2)
        del w1, first
        self.bi, first, self.pair, types = _distinct(mix(w2, w3))
        self.w2 = w2[first]
        del w2
        self.w3 = w3[first]
        del w3, first
        whole = np.bincount(self.pair, self.n, len(self.bi)).astype(np.int64)
        self.types = np.where(self.w2 == _BOS, whole, types)


def _counts_of_counts(n: np.ndarray) -> list[tuple[int, int]]:
    return [(i, c) for i, c in enumerate(np.bincount(np.minimum(n, 5), minlength=6).tolist()) if 0 < i < 5 and c]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """Rows of one sorted partition, one shard and kind after the other."""
    for batch in batches:
        shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)]):
            if b > a:
                yield int(shards[a]), int(kinds[a]), batch.slice(a, b - a)


def _bytes(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("n", "size", "data"))))


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; plain values where they cannot be estimated."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def _discounted(key: np.ndarray, n: np.ndarray, d: tuple[float, ...]):
    """Per row its discounted share of the context ``key`` and its context's place; the
    contexts in order and the weights they leave to the next lower order."""
    contexts, _, at, _ = _distinct(key)
    total = np.bincount(at, n, len(contexts))
    off = np.array([0.0, *d])[np.minimum(n, 3)]
    gamma = np.bincount(at, off, len(contexts)) / total
    alpha = np.subtract(n, off, out=off)
    alpha /= total[at]
    return alpha, at, contexts, gamma


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the ordered ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order, at = np.argsort(keys), np.empty(len(keys), np.int64)
    at[order] = np.minimum(np.searchsorted(known, keys[order]), len(known) - 1)  # in order, the search stays in the cache
    return at, known[at] == keys


def _looked_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    at, hit = _find(known, keys)
    out = np.full(len(keys), default)
    out[hit] = values[at[hit]]
    return out


@dataclass
class Weights:
    """What every shard needs: discounts, probabilities of the numbered words, and that of an unknown one."""
    discounts3: tuple[float, ...]
    discounts2: tuple[float, ...]
    unigram: np.ndarray
    base: float


class _Tables:
    """log10 probabilities of a shard's known trigrams and bigrams and the weights of their contexts.
    ``counts`` is used up: its arrays go with their last use."""

    def __init__(self, counts: _Counts, words: list[tuple], spread: list[tuple], dealing: Dealing, weights: Weights) -> None:
        self.weights = weights
        rare, rare_p = (np.concatenate(x) for x in zip(*words)) if words else (np.empty(0, np.int64), np.empty(0))
        order = np.argsort(rare)
        rare, rare_p = rare[order], rare_p[order]
        own = dealing.over(counts.w2) == 1
        parts = [(counts.w2[own], counts.w3[own], counts.types[own]), *spread]
        del counts.w2, counts.w3, counts.types, own
        w2, w3, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        p2, at, self.middles, gamma = _discounted(w2, n.astype(np.int64), weights.discounts2)
        key = mix(w2, w3)
        del w2, n
        p1 = np.full(len(w3), weights.base)
        p1[w3 >= 0] = weights.unigram[w3[w3 >= 0]]
        p1[w3 < 0] = _looked_up(rare, rare_p, w3[w3 < 0], weights.base)
        del w3, rare, rare_p
        p1 *= gamma[at]
        p2 += p1
        del at, p1
        self.middle_log = np.log10(gamma, out=gamma)
        order = np.argsort(key)
        self.bi, p2 = key[order], p2[order]
        del key, order
        below = p2[_find(self.bi, counts.bi)[0]] if len(p2) else np.empty(0)
        del counts.bi
        self.bi_log = np.log10(p2, out=p2)
        self.tri, context, n, pair = counts.tri, counts.context, counts.n, counts.pair
        del counts.tri, counts.context, counts.n, counts.pair
        p3, at, self.contexts, gamma = _discounted(context, n, weights.discounts3)
        del context, n
        below = below[pair]
        del pair
        below *= gamma[at]
        p3 += below
        self.tri_log, self.context_log = np.log10(p3, out=p3), np.log10(gamma, out=gamma)

    def log10(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each trigram; where the second is true, that of its last word has to be added."""
        context = mix(w1, w2)
        at, hit = _find(self.tri, mix(context, w3))
        out = np.empty(len(w1))
        out[hit] = self.tri_log[at[hit]]
        miss = np.flatnonzero(~hit)
        out[miss] = _looked_up(self.contexts, self.context_log, context[miss], 0.0)
        w2, w3 = w2[miss], w3[miss]
        at, hit = _find(self.bi, mix(w2, w3))
        out[miss[hit]] += self.bi_log[at[hit]]
        miss, w2, w3 = miss[~hit], w2[~hit], w3[~hit]
        out[miss] += _looked_up(self.middles, self.middle_log, w2, 0.0)
        plain = w3 >= 0
        out[miss[plain]] += np.log10(self.weights.unigram[w3[plain]])
        left = np.zeros(len(out), bool)
        left[miss[~plain]] = True
        return out, left


@dataclass
class Model:
    """The packed n-grams of the fitted documents and what else their shards need as parcels, the
    probabilities (``w``, ``p``) of all known words, and the small figures."""
    parcels: DataFrame
    words: DataFrame
    dealing: Dealing
    weights: Weights


def _spell(texts: DataFrame) -> DataFrame:
    """(``w``, ``n``): how often each word's hash occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(Dealing({}, np.ones(1, np.int64), 1))
        for batch in batches:
            values = [np.empty(0, np.int64), *(np.array(known.of(t), np.int64) for t in batch.column(0).to_pylist())]
            w, n = np.unique(np.concatenate(values), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], names=["w", "n"])

    return texts.select(F.col("t").cast("binary")).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _dealt(parcels: DataFrame, shards: int) -> DataFrame:
    return parcels.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")


def _count(parcels: DataFrame, shared) -> DataFrame:
    """(``what``, ``shard``, ``a``, ``b``, ``n``) rows of the counts of each shard."""
    def rows_of(shard: int, counts: _Counts, dealing: Dealing) -> pa.RecordBatch:
        own = dealing.over(counts.w2) == 1
        last, n = np.unique(counts.w3[own], return_counts=True)
        rows = [(_TRI_COUNTS, shard, *np.array(_counts_of_counts(counts.n), np.int64).reshape(-1, 2).T),
                (_BI_COUNTS, shard, *np.array(_counts_of_counts(counts.types[own]), np.int64).reshape(-1, 2).T), (_LAST, shard, last, n)]
        parts = [(np.full(len(n), what), np.full(len(n), s), a, np.zeros(len(n), np.int64), n) for what, s, a, n in rows]
        spread = ~own
        parts.append((np.full(spread.sum(), _PAIR), _spot(counts.w2[spread]) % dealing.shards, counts.w2[spread],
                      counts.w3[spread], counts.types[spread]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(
            zip(*parts), ("i4", "i4", "i8", "i8", "i8"))], names=["what", "shard", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for shard, _, part in _by_shard(batches):
            if shard != now and held:
                yield rows_of(now, _Counts(held), shared.value)
                held = []
            now = shard
            held += _bytes(part)
        if held:
            yield rows_of(now, _Counts(held), shared.value)

    return _dealt(parcels, shared.value.shards).mapInArrow(run, "what int, shard int, a bigint, b bigint, n bigint")


def _sums(df: DataFrame, by: str, n: str) -> dict[int, int]:
    """At most four counts of counts."""
    return {int(r[0]): int(r[1]) for r in df.groupBy(by).agg(F.sum(n)).collect()}


def fit(trusted: DataFrame, text_col: str = "text", shards: int | None = None) -> Model:
    """The model of all trusted documents.  ``shards`` follows from their number of words."""
    spark = trusted.sparkSession
    context = spark.sparkContext
    text_batches(spark)
    texts = trusted.select(F.lit(0).cast("bigint").alias("h"), F.col(text_col).alias("t"))
    with lent(_spell(texts), "kn") as words, shuffles_freed(spark):
        total = words.agg(F.sum("n")).first()[0] or 0
        top = words.orderBy(F.desc("n"), "w").limit(FREQUENT).collect()
    shards = shards or max(2 * context.defaultParallelism, -(-total // SHARD_GRAMS))
    spread = np.ones(_FIRST_WORD + len(top), np.int64)
    spread[_FIRST_WORD:] = [-(-r["n"] * shards // total) for r in top]
    dealing = Dealing({r["w"]: i for i, r in enumerate(top, _FIRST_WORD)}, spread, shards)
    shared = context.broadcast(dealing)
    fitted = written(_parcels(texts, shared, _FITTED), "kn")
    with small_batches(spark), lent(_count(fitted, shared), "kn") as counted:
        known, extra, weights = _estimated(counted, dealing)
    parcels = fitted.unionByName(extra, allowMissingColumns=True)
    return Model(parcels, known.where("w < 0"), dealing, weights)


def _estimated(counted: DataFrame, dealing: Dealing) -> tuple[DataFrame, DataFrame, Weights]:
    """From the counts of all shards the probabilities (``w``, ``p``) of the known words, what the
    shards need of other shards, and the small figures."""
    spark, spread, shards = counted.sparkSession, dealing.spread, dealing.shards
    # Bigrams of spread words, in total; there are fewer spread words than shards.
    hot = np.flatnonzero(spread > 1)
    places = spark.createDataFrame([(int(w), int(spread[w])) for w in hot], "a bigint, many int")
    pairs = written(counted.where(F.col("what") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("shard").alias("shard")), "kn")
    last = counted.where(F.col("what") == _LAST).select("shard", "a", "n")
    ones = last.select("a", "n").unionByName(pairs.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n")))
    ones = written(ones.groupBy("a").agg(F.sum("n").alias("n")), "kn")
    counts3 = _sums(counted.where(F.col("what") == _TRI_COUNTS), "a", "n")
    counts2 = _sums(counted.where(F.col("what") == _BI_COUNTS).select("a", "n").unionByName(
        pairs.where("n < 5").select(F.col("n").alias("a"), F.lit(1).cast("bigint").alias("n"))), "a", "n")
    d1 = _discounts(_sums(ones.where("n < 5").select(F.col("n").alias("a"), F.lit(1).alias("n")), "a", "n"))
    n = F.col("n")
    off = F.when(n == 1, d1[0]).when(n == 2, d1[1]).otherwise(d1[2])
    many, of, left = ones.agg(F.count("*"), F.sum("n"), F.sum(off)).first()
    # Words, the end (counted among them) and the unknown word; nothing is known without documents.
    base = left / of / (many + 1) if many else 0.5
    known = ones.select(F.col("a").alias("w"), ((n - off) / F.lit(of) + F.lit(base)).alias("p"))
    unigram = np.full(len(spread), base)
    for r in known.where("w >= 0").collect():  # numbered words
        unigram[r["w"]] = r["p"]

    spread_pairs = pairs.join(F.broadcast(places), "a").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select(
        ((F.col("shard") + F.col("j")) % shards).alias("shard"), "a", "b", F.col("n").cast("double").alias("x"))
    rare = last.where("a < 0").select("shard", F.col("a").alias("w")).unionByName(
        spread_pairs.where("b < 0").select("shard", F.col("b").alias("w"))).distinct()
    rare = rare.join(known, "w").select("shard", F.lit(_WORD).alias("kind"), F.col("w").alias("a"), F.col("p").alias("x"))
    extra = written(rare.unionByName(spread_pairs.withColumn("kind", F.lit(_SPREAD)), allowMissingColumns=True), "kn")
    return known, extra, Weights(_discounts(counts3), _discounts(counts2), unigram, base)


def _scored(parcels: DataFrame, shared, shared_weights) -> DataFrame:
    """(``chunk``, ``doc``, ``s``, ``rare_doc``, ``rare``, ``h``, ``size``): sums per document of the chunk, the
    words whose log10 has to be added, and in one row per chunk its documents."""
    none = np.empty(0, np.int64)

    def scored(batch: pa.RecordBatch, tables: _Tables) -> list[tuple]:
        rows = []
        for chunk, packed in zip(batch.column("chunk").to_pylist(), _bytes(batch)):
            w1, w2, w3, doc = _unpack(*packed)
            logs, left = tables.log10(w1, w2, w3)
            found, at = np.unique(doc, return_inverse=True)
            rows.append((chunk, found, np.bincount(at, logs), doc[left], w3[left], none, none))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealing, weights = shared.value, shared_weights.value
        now = tables = None
        for shard, kind, part in _by_shard(batches):
            if shard != now:
                now, tables, fitted, words, spread = shard, None, [], [], []
            rows = []
            if kind == _WORD:  # copies, because a view keeps its whole batch
                words.append(tuple(part.column(c).to_numpy().copy() for c in ("a", "x")))
            elif kind == _SPREAD:
                spread.append(tuple(part.column(c).to_numpy().copy() for c in ("a", "b", "x")))
            elif kind == _FITTED:
                fitted += _bytes(part)
            elif kind == _SCORED:
                if tables is None:
                    tables = _Tables(_Counts(fitted), words, spread, dealing, weights)
                    words, spread = [], []
                rows = scored(part, tables)
            else:
                for chunk, (n, _, data) in zip(part.column("chunk").to_pylist(), _bytes(part)):
                    hashes, sizes = np.frombuffer(data, "<i8").reshape(2, n)
                    rows.append((chunk, np.arange(n), np.zeros(n), none, none, hashes, sizes))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    names = ["chunk", "doc", "s", "rare_doc", "rare", "h", "size"]
    many = pa.list_(pa.int64())
    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), many, many, many]
    return _dealt(parcels, shared.value.shards).mapInArrow(
        run, "chunk bigint, doc array<int>, s array<double>, rare_doc array<int>, rare array<bigint>, h array<bigint>, size array<bigint>")


def _rated(sums: DataFrame, model: Model, out_cols: tuple[str, str]) -> DataFrame:
    """``h`` and ``out_cols`` of the documents of one round."""
    rare = sums.where("size(rare) > 0").select("chunk", F.explode(F.arrays_zip("rare_doc", "rare")).alias("r")).select(
        "chunk", F.col("r.rare_doc").alias("doc"), F.col("r.rare").alias("w")).join(model.words, "w", "left")
    rare = rare.groupBy("chunk", "doc").agg(F.sum(F.log10(F.coalesce("p", F.lit(model.weights.base)))).alias("s"))
    # Dealt by chunk while the lists are short, then opened where they lie.
    plain = sums.select("chunk", "doc", "s", "h", "size").repartition("chunk")
    plain = plain.select("chunk", F.explode(F.arrays_zip("doc", "s", "h", "size")).alias("r")).select("chunk", "r.*")
    plain = plain.groupBy("chunk", "doc").agg(F.sum("s").alias("s"), F.max("h").alias("h"), F.max("size").alias("size"))
    rated = plain.join(rare.withColumnRenamed("s", "more"), ["chunk", "doc"], "left").select(
        "h", "size", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"))
    # Equal texts have one figure.
    return rated.groupBy("h").agg(F.max("size").alias(out_cols[0]), F.max(
        F.pow(F.lit(10.0), -F.col("s") / (F.col("size") + 1))).alias(out_cols[1]))


def perplexities(docs: DataFrame, model: Model, text_col: str = "text", out_cols: tuple[str, str] = (
        "n_tokens", "perplexity")) -> DataFrame:
    """``docs`` with its number of words and its perplexity in place of the
    column ``text_col``; give a copy of the text to keep it."""
    spark = docs.sparkSession
    text_batches(spark)
    shared, weights = (spark.sparkContext.broadcast(x) for x in (model.dealing, model.weights))
    kept = [c for c in docs.columns if c != text_col]
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rated = []
    for at in range(ROUNDS):
        own = _parcels(texts.where(F.pmod("h", F.lit(ROUNDS)) == at), shared, _SCORED)
        with small_batches(spark), lent(_scored(model.parcels.unionByName(own), shared, weights), "kn") as sums:
            rated.append(written(_rated(sums, model, out_cols), "kn"))
    rated = reduce(DataFrame.union, rated)
    return docs.select(*kept, F.xxhash64(text_col).alias("__text")).join(
        rated.withColumnRenamed("h", "__text"), "__text").select(*kept, *out_cols)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id")).distinct()


def thresholds(rated: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(``lang``, ``threshold``), with one row more (``every`` true) over all languages."""
    bound = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    return rated.groupBy("lang").agg(bound).withColumn("every", F.lit(False)).unionByName(
        rated.agg(bound).select(F.lit(None).cast("string").alias("lang"), "threshold", F.lit(True).alias("every")))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          quantile: float = QUANTILE) -> DataFrame:
    """One row per document row: ``id_col``, ``lang_col``, ``text_hash`` (XXH64),
    ``n_tokens``, ``perplexity``, ``threshold``, ``keep``."""
    trusted = trusted_ids(labels, id_col)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    fitted = written(trusted.where(half == 0), "trusted")
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    model = fit(rows.join(fitted, "id", "left_semi").select("t"), "t")
    rated = written(perplexities(rows, model, "t"), "perplexity")
    bounds = thresholds(rated.join(trusted.where(half == 1), "id", "left_semi").where("n_tokens > 0"), quantile)
    bounds = written(bounds, "thresholds")  # a row per language
    general = bounds.where("every").first()["threshold"]
    per = bounds.where("NOT every").select(F.col("lang").alias("bl"), F.col("threshold").alias("own"))
    threshold = F.coalesce("own", F.lit(general).cast("double"))
    return rated.join(per, F.col("lang").eqNullSafe(F.col("bl")), "left").select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "text_hash", "n_tokens", "perplexity",
        threshold.alias("threshold"),
        ((F.col("n_tokens") > 0) & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", **settings) -> DataFrame:
    """``docs`` without the rows that ``score`` rejects.  The verdict depends on
    text and language alone, so the id and the text hash find the row again."""
    bad = score(docs, labels, id_col, text_col, lang_col, **settings).where("NOT keep").select(
        F.col(id_col).alias("__bad_id"), F.col("text_hash").alias("__bad_hash"), F.col(lang_col).alias("__bad_lang"))
    return docs.join(bad.distinct(), F.xxhash64(docs[text_col]).eqNullSafe(F.col("__bad_hash"))
                     & docs[id_col].eqNullSafe(F.col("__bad_id"))
                     & docs[lang_col].eqNullSafe(F.col("__bad_lang")), "left_anti")
