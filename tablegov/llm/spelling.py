"""Spelling variants: words that differ by one letter, and the frequent form of each.

The vocabulary is counted over all documents.  Two words are near when one
inserted, deleted or replaced code point makes them equal.  They are searched
in shards with a bit-sliced index: for every (position, letter) one bitset says
which words of the shard have that letter there.  One pass over the letters of
a word then carries four bitsets at once: words equal so far, and words with
one error so far, which is a replaced letter (same position), a letter that the
other word lacks (its positions are one less) or has more (one more).  Lengths
settle the rest, so a pass finds all near words of the shard together.

Shards: of two near words, the shorter of m letters, the shared beginning and
the shared end have m - 1 letters at least together, so the pair agrees in the
first half of its m letters or in the last.  A word goes to the shards of its
length and of one letter less, by beginning and by end.  A shard above
``SHARD_LIMIT`` words is dealt again by half of the letters that are still
free; with one free letter left a shard is bounded by the alphabet.  So no task
meets the whole vocabulary, and no pair is lost.

Nulls: a null text has no words, like an empty one; a null id counts as an
empty one where ``drop_every`` looks at ids.  Repeated rows count again.  Other
columns of the input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches, written
from tablegov.session import cut

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT = 6, 5
# A form has to be this many times as frequent.
FORM_FACTOR = 5
# Words of a shard before it is dealt again; more than the two free letters of a last shard can make.
SHARD_LIMIT = 8_192

_FLUSH = 100_000  # distinct words that a task holds before it hands their counts on


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None) -> DataFrame:
    """``word``, ``n``: words of ``MIN_LETTERS`` letters at least that occur
    ``MIN_COUNT`` times at least.  ``drop_every`` plants typing errors: where it
    divides the crc32 of ``<id>:<word>``, the word loses the letter at the
    position crc32 modulo its length."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(LETTERS.findall((text or b"").lower().decode("utf-8", "replace")))
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in found.items():
                    if len(word) < MIN_LETTERS:
                        continue
                    if drop_every and not (h := zlib.crc32(word.encode(), seed)) % drop_every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < MIN_LETTERS:
                            continue
                    total[word] += n
            if len(total) > _FLUSH:
                yield counted()
                total.clear()
        if total:
            yield counted()

    counts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keyed(df: DataFrame) -> DataFrame:
    """``key`` of the shard that fixes ``p`` letters at the beginning and ``s`` at the end."""
    return df.withColumn("key", F.concat_ws(
        " ", F.col("m").cast("string"), F.col("p").cast("string"), F.col("s").cast("string"),
        F.expr("left(word, p)"), F.expr("right(word, s)")))


def shards(words: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """``key``, ``m``, ``word``, ``n``: every word in the shards where its near words are."""
    posts = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("m")).where(
        F.col("m") >= MIN_LETTERS).select(
        "word", "n", "m", F.explode(F.expr("array(struct(m - m div 2 AS p, 0L AS s), struct(0L AS p, m div 2 AS s))")).alias("e"))
    todo = _keyed(posts.select("word", "n", "m", "e.p", "e.s"))
    done = None
    while True:
        # With one free letter a shard cannot be dealt further.
        free = todo.where("m - p - s > 1")
        big = free.groupBy("key").count().where(F.col("count") > limit).select("key")
        if big.isEmpty():
            return (todo if done is None else done.unionByName(todo)).select("key", "m", "word", "n")
        big = cut(big)
        part = todo.join(big, "key", "left_anti")
        done = part if done is None else done.unionByName(part)
        again = todo.join(big, "key", "left_semi").withColumn("r", F.col("m") - F.col("p") - F.col("s"))
        todo = cut(_keyed(again.select("word", "n", "m", F.explode(F.expr(
            "array(struct(p + r - r div 2 AS p, s AS s), struct(p AS p, s + r div 2 AS s))")).alias("e")).select(
            "word", "n", "m", "e.p", "e.s")))


class Index:
    """Bitsets of one shard: bit i of ``at[position, letter]`` is set when word i has that letter there."""

    def __init__(self, words: list[str]):
        self.at: dict[tuple[int, str], int] = defaultdict(int)
        self.long: dict[int, int] = defaultdict(int)
        for no, word in enumerate(words):
            for place in enumerate(word):
                self.at[place] |= 1 << no
            self.long[len(word)] |= 1 << no
        self.every = (1 << len(words)) - 1

    def near(self, word: str) -> int:
        """Bitset of the words at one error from ``word``."""
        get = self.at.get
        equal, swapped, less, more = self.every, 0, 0, 0
        for i, letter in enumerate(word):
            here = get((i, letter), 0)
            swapped = swapped & here | equal & ~here
            less = less & get((i - 1, letter), 0) | equal
            more = (more | equal) & get((i + 1, letter), 0)
            equal &= here
        size, n = self.long, len(word)
        return swapped & size.get(n, 0) | less & size.get(n - 1, 0) | (more | equal) & size.get(n + 1, 0)


def near_pairs(words: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """``word``, ``near``, ``near_n``: every ordered pair of near words once."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def batch_of(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
        a, b, n = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())],
                                          names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            group = list(group)
            if len(group) < 2:
                continue
            index, m = Index([r[2] for r in group]), group[0][1]
            for _, _, word, _ in group:
                # Two longer words meet in the shards of their own length.
                hits = index.near(word) & (index.every if len(word) == m else index.long[m])
                while hits:
                    low = hits & -hits
                    hits ^= low
                    out.append((word, *group[low.bit_length() - 1][2:]))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    dealt = shards(words, limit).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last of a chain of forms.  Each step is
    ``FORM_FACTOR`` times as frequent, so chains are short and have no cycle;
    every round doubles how far a word looks."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        looked = cut(roots.join(ahead, "root", "left"))
        if looked.where("next IS NOT NULL").isEmpty():
            return roots
        roots = looked.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None,
             limit: int = SHARD_LIMIT) -> DataFrame:
    """One row per word of the vocabulary: ``word``, ``form`` (its most frequent
    near word, of equal ones the first in code-point order, if that is
    ``FORM_FACTOR`` times as frequent, else null), ``root`` (the last of the chain of
    forms, the word itself without one), ``n``, ``n_near``, ``form_n``."""
    words = written(word_counts(docs, id_col, text_col, drop_every), "vocabulary")
    best = near_pairs(words, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("first"))
    rated = words.join(best, "word", "left")
    strong = -F.col("first.rank") >= FORM_FACTOR * F.col("n")
    rated = written(rated.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("first.near")).alias("form"),
        F.when(strong, -F.col("first.rank")).alias("form_n")), "variants")
    roots = _roots(rated.where("form IS NOT NULL").select("word", "form"))
    return rated.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
