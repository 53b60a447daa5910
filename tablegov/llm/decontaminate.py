"""Benchmark windows in documents: a prefix-filtered containment join.

A window is ``size`` consecutive words of a benchmark item (a shorter item is
one window).  Its tokens are its shingles of up to three words, ordered by how
rare they are in the documents.  Containment is complete, so the prefix that
must be joined is one token, the rarest.  A window whose rarest shingle occurs
nowhere is dropped at once.  Document positions are tested against a bitmap of
the prefix tokens (fixed size whatever the benchmark; a false positive costs a
join row, nothing else), joined with the windows by token, bounded by position
and length, and verified word by word on the context that travels with the
candidate.  The text itself is never shuffled.

Nulls: a null text has no words; a null id is carried along.  Repeated document
rows are rated one by one; repeated items and windows count once.  Empty tables
give an empty result or documents without hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import lower_ascii, written

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3

# Bits of the prefix bitmap: 64 for each token, within these bounds.
_LEAST_BITS, _MOST_BITS = 1 << 12, 1 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + i) for i in range(k)])


def _positions(words: Column, k: int) -> Column:
    """0-based starts of all runs of ``k`` words."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(
        F.array().cast("array<int>"))


def windows_of(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: ``win`` (words), ``len``, ``items`` (ids as strings)."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    cut = F.when(F.size("w") >= size, F.transform(_positions(F.col("w"), size), lambda i: F.slice("w", i + 1, size)))
    return words.where(F.size("w") > 0).select(
        "item", F.explode(F.coalesce(cut, F.array("w"))).alias("win"),
    ).groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("win"))


def _tokens(windows: DataFrame) -> DataFrame:
    """Every shingle of every window: ``win``, ``h``, ``k`` and its first offset."""
    parts = []
    for k in range(1, SHINGLE + 1):
        of = windows.where((F.col("len") >= SHINGLE) if k == SHINGLE else (F.col("len") == k))
        parts.append(of.select("win", "len", "items", F.lit(k).alias("k"), F.explode(F.transform(
            _positions(F.col("win"), k), lambda o: F.struct(_hash(F.col("win"), o, k).alias("h"), o.alias("off"))
        )).alias("s")).select("win", "len", "items", "k", "s.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bitmap(tokens: DataFrame, count: int) -> tuple[Column, int]:
    """A literal bit array with a bit for each ``h``, and its number of bits."""
    bits = _LEAST_BITS
    while bits < min(64 * count, _MOST_BITS):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = [0] * (bits // 64)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    for cell, value in tokens.select(F.shiftright(at, 6).alias("c"), one.alias("v")).groupBy("c").agg(
            F.bit_or("v")).collect():  # at most _MOST_BITS / 64 rows
        cells[cell] = value
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>"), bits


def _in_bitmap(h: Column, bitmap: Column, bits: int) -> Column:
    at = h.bitwiseAND(F.lit(bits - 1))
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _candidates(words: Column, tokens: DataFrame) -> Column | None:
    """(``pos``, ``h``, ``k``) of the document shingles that may be tokens."""
    found = None
    for k, count in sorted(tokens.groupBy("k").agg(F.countDistinct("h")).collect()):
        part = _matches(words, k, *_bitmap(tokens.where(F.col("k") == k), count))
        found = part if found is None else F.concat(found, part)
    return found


def _matches(words: Column, k: int, bitmap: Column, bits: int) -> Column:
    kept = F.filter(_positions(words, k), lambda i: _in_bitmap(_hash(words, i, k), bitmap, bits))
    return F.transform(kept, lambda i: F.struct(i.alias("pos"), _hash(words, i, k).alias("h"), F.lit(k).alias("k")))


def prefix_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, item_col: str = "item_id",
                   bench_text: str = "text", text_col: str = "text") -> DataFrame:
    """The windows that can occur at all, each with the one token to join on:
    ``win``, ``len``, ``items``, ``h``, ``k``, ``off``."""
    tokens = written(_tokens(windows_of(benchmark, size, item_col, bench_text)), "windows")
    words = docs.select(words_of(F.col(text_col)).alias("w"))
    found = _candidates(F.col("w"), tokens)
    if found is None:
        return tokens
    seen = words.select(F.explode(found).alias("s")).groupBy("s.h", "s.k").count()
    rarest = tokens.join(seen, ["h", "k"], "left").groupBy("win").agg(
        F.first("len").alias("len"), F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "h", "off", "k")).alias("t"))
    return written(rarest.where("t.n > 0").select("win", "len", "items", "t.h", "t.k", "t.off"), "prefixes")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """One row per document row: ``id_col``, ``text_hash`` (XXH64), ``n_words``,
    ``hits`` (sorted hit word positions) and ``items`` (sorted ids as strings)."""
    windows = prefix_windows(docs, benchmark, size, item_col, bench_text, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    kind = "struct<pos:int,h:bigint,k:int>"
    found = _candidates(F.col("w"), windows)
    before = size - 1
    # The words around a candidate: all that any window through it can cover.
    around = F.transform(found if found is not None else F.array().cast(f"array<{kind}>"), lambda c: F.struct(
        c["pos"].alias("pos"), c["h"].alias("h"), c["k"].alias("k"), F.least(c["pos"], F.lit(before)).alias("lead"),
        F.slice("w", F.greatest(c["pos"] - before, F.lit(0)) + 1, 2 * size + SHINGLE).alias("ctx")))
    spread = rows.select("rid", "id", "text_hash", F.size("w").alias("n_words"), F.explode_outer(around).alias("c"))
    spread = spread.select("rid", "id", "text_hash", "n_words", "c.pos", "c.k", "c.lead", "c.ctx",
                           # Rows without a candidate get a key of their own, so that they do not meet in one task.
                           F.coalesce("c.h", F.xxhash64("rid")).alias("h"))
    right = windows.select(F.col("h").alias("wh"), F.col("k").alias("wk"), "off", "len", "win", "items")
    start = F.col("pos") - F.col("off")
    joined = spread.join(right, (F.col("h") == F.col("wh")) & (F.col("k") == F.col("wk")) & (start >= 0)
                         & (start + F.col("len") <= F.col("n_words"))
                         & (F.col("lead") >= F.col("off"))
                         & (F.slice("ctx", F.col("lead") - F.col("off") + 1, F.col("len")) == F.col("win")), "left")
    runs = F.when(F.col("win").isNotNull(), F.struct(start.alias("at"), F.col("len").alias("n")))
    each = joined.groupBy("rid", "id", "text_hash", "n_words").agg(
        F.collect_set(runs).alias("runs"), F.flatten(F.collect_set("items")).alias("all_items"))
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))
    return each.select(F.col("id").alias(id_col), "text_hash", F.col("n_words").cast("long").alias("n_words"),
                       F.array_sort(F.array_distinct(covered)).alias("hits"),
                       F.array_sort(F.array_distinct("all_items")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window.  Whether a row
    goes depends on its text alone, so id and text hash identify it."""
    marked = scan(docs, benchmark, size, id_col, text_col).where(F.size("hits") > 0)
    bad = marked.select(F.col(id_col).alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    return docs.join(bad, F.xxhash64(docs[text_col]).eqNullSafe(F.col("__bad_hash"))
                     & docs[id_col].eqNullSafe(F.col("__bad_id")), "left_anti")
