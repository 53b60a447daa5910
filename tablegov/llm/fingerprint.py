"""Homomorphic multiset hashes of documents, in DataFrame functions only.

A document is the multiset of its paragraphs.  A paragraph is hashed to a wide
vector of ``LANES`` bits, from three salted XXH64 values, and the vectors are
added lane by lane modulo 2^31: two lanes share one 64-bit word, each with a
spare bit, so no lane ever carries into another.  The sum does not depend on the
order; a paragraph is inserted or deleted by adding or subtracting its vector
(``combine``).  Two documents have the same fingerprint when they hold the same
paragraphs equally often; for different multisets all lanes agree with a chance
of about 2^-192.

The lanes also tell how alike two documents are: with the bits read as +1 and
-1, the product of two sums is on average the number of shared paragraphs, so
``2 a.b / (a.a + b.b)`` estimates the share of common paragraphs.

The paragraphs are spread to rows and summed by a hash aggregation that needs no
exchange: documents already lie by ranges of ids, which ``with_next`` makes.

Nulls: a null text is an empty one, and an empty text has no paragraphs: all
lanes are zero, and two such texts are alike (1.0).  Any length of text is
hashed whole: a text has fewer than 2^31 paragraphs, so its counters never wrap.
``sum_paragraphs`` over a key with more fails with an overflow error.  Ids must be integers; null ids come last, and equal ids follow
their text hash.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A paragraph ends with a line or a sentence; it keeps its end, so the pieces spell the text.
PARAGRAPH = r"(?<=\n)|(?<=[.!?][ ])"

_SALTS, _SHIFTS = 3, 32
WORDS = _SALTS * _SHIFTS
LANES = 2 * WORDS
# Bits i and i + 32 of a hash value, and the two counters of a word.
_TWO = 1 | 1 << 32
_LANE = (1 << 31) - 1

# Documents of one range of ids; a range is sorted by one task.
ROWS_PER_RANGE = 50_000


def sum_paragraphs(pieces: DataFrame, keys: list[str], name: str = "lanes", piece: str = "piece") -> DataFrame:
    """The sum of the vectors of ``piece`` for each of ``keys``: ``name``, an
    array of ``WORDS`` words and the number of paragraphs.  Empty pieces, which
    stand for documents without paragraphs, count nothing."""
    pieces = pieces.where(F.col(piece).isNotNull()).withColumns(
        {f"_h{s}": F.xxhash64(F.lit(s), piece) for s in range(_SALTS)})
    there = (F.length(piece) > 0).cast("long")
    pieces = pieces.withColumn("_there", there)
    mask = F.lit(_TWO) * F.col("_there")
    sums = [F.sum(F.shiftrightunsigned(f"_h{s}", j).bitwiseAND(mask)).alias(f"_w{s}_{j}")
            for s in range(_SALTS) for j in range(_SHIFTS)]
    summed = pieces.groupBy(*keys).agg(*sums, F.sum("_there").alias("_n"))
    return summed.select(*keys, F.array(*[f"_w{s}_{j}" for s in range(_SALTS) for j in range(_SHIFTS)], "_n").alias(name))


def _lane(word: Column, i: int) -> Column:
    return F.shiftrightunsigned(word, 32 * i).bitwiseAND(F.lit(_LANE))


def combine(lanes: Column, change: Column, sign: int = 1) -> Column:
    """Lanes after inserting (or, with -1, deleting) what ``change`` sums up."""
    def add(a: Column, b: Column) -> Column:
        low, high = [(_lane(a, i) + F.lit(sign) * _lane(b, i)).bitwiseAND(F.lit(_LANE)) for i in range(2)]
        return F.shiftleft(high, 32).bitwiseOR(low)

    words = F.zip_with(F.slice(lanes, 1, WORDS), F.slice(change, 1, WORDS), add)
    n = F.get(lanes, F.lit(WORDS)) + F.lit(sign) * F.get(change, F.lit(WORDS))
    return F.concat(words, F.array(n))


def fingerprint_of(lanes: Column) -> Column:
    """The words as hexadecimal text, 16 digits each."""
    return F.lower(F.array_join(F.transform(lanes, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs, 0 to 1; 1 for equal sums."""
    def product(x: Column, y: Column) -> Column:
        n, m = F.get(x, F.lit(WORDS)), F.get(y, F.lit(WORDS))

        def word(p: Column, q: Column) -> Column:
            return sum((_lane(p, i) * 2 - n).cast("double") * (_lane(q, i) * 2 - m) for i in range(2))

        return F.aggregate(F.zip_with(F.slice(x, 1, WORDS), F.slice(y, 1, WORDS), word), F.lit(0.0), lambda t, v: t + v)

    shared, size = product(a, b), product(a, a) + product(b, b)
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(
        F.least(F.greatest(2 * shared / size, F.lit(0.0)), F.lit(1.0)))


def _by_id() -> list[Column]:
    return [F.col("guest"), F.col("id").desc_nulls_last(), F.col("text_hash")]


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Every row of ``docs`` (``id``, ``text``) with ``next``, the text of the
    row that follows in descending id; the last one's is the first.

    The ids are cut into ranges (``block``) by their own quantiles, so a text is
    exchanged once.  A row whose id is a bound is also sent, as a guest, to the
    range before it, whose last row needs it.  Guests stay in the result
    (``guest`` 1), so that later steps can look ahead in the same way."""
    spark = docs.sparkSession
    ids = docs.select("id")
    ranges = max(math.ceil(ids.count() / rows_per_range), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Shares and bounds are one text literal each, whatever their number.
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    bounds, top = ids.agg(F.percentile_approx("id", shares, F.lit(20 * ranges)), F.max("id")).first()
    bounds = sorted(set(bounds or []))
    at = F.col("id")
    edges = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    block = F.coalesce(F.aggregate(F.array(*map(F.lit, steps)).cast("array<int>"), F.lit(0), lambda n, s: F.when(
        (n + s <= len(bounds)) & (F.get(edges, n + s - 1) < at), n + s).otherwise(n)) if bounds else F.lit(0), F.lit(0))
    homes = [F.struct(F.col("own").alias("block"), F.lit(0).alias("guest"))]
    if bounds:
        homes.append(F.when(F.get(edges, F.col("own")) == at, F.struct((F.col("own") + 1).alias("block"),
                                                                       F.lit(1).alias("guest"))))
    # The first of all follows the last; without any id, one range follows itself.
    first = F.lit(True) if top is None else at == F.lit(top).cast("long")
    homes.append(F.when(first, F.struct(F.lit(0).alias("block"), F.lit(1).alias("guest"))))
    sent = docs.withColumn("own", block).withColumn("text_hash", F.xxhash64("text")).select(
        "id", "text", "text_hash", F.explode(F.array_compact(F.array(*homes))).alias("home"))
    sent = sent.select("id", "text", "text_hash", "home.*").repartition("block")
    return sent.withColumn("next", F.lead("text").over(Window.partitionBy("block").orderBy(*_by_id())))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = PARAGRAPH) -> DataFrame:
    """One row per document: ``id_col``, ``n_chars``, ``edited_sha256`` (of the
    text whose last half is replaced by as many first characters of the next
    document), and the sums ``lanes``, ``edited_lanes`` and ``next_lanes``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(rows).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half),
                       F.substring("next", F.lit(1), half))
    both = paired.withColumn("row", F.monotonically_increasing_id()).withColumn("edited", F.when(
        F.col("guest") == 0, changed)).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["block", "guest", "row", "id", "text_hash", "n_chars", "edited_sha256", "which"]
    versions = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
                                 F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))))
    pieces = both.select(*keys[:-1], versions.alias("v")).select(*keys[:-1], "v.which", F.explode(
        F.split("v.t", pattern)).alias("piece"))
    summed = sum_paragraphs(pieces, keys)
    # In the order of the ids: a text, its edited form, then the next text.
    order = Window.partitionBy("block").orderBy(*_by_id(), "row", "which")
    placed = summed.withColumns({"edited_lanes": F.lead("lanes").over(order), "next_lanes": F.lead("lanes", 2).over(order)})
    return placed.where("guest = 0 AND which = 0").select(
        F.col("id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "lanes",
        "edited_lanes", "next_lanes")
