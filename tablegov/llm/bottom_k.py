"""Near-duplicate classes from bottom-k sketches of one hash function.

A document's set holds its distinct four-word shingles; two documents are
linked when intersection / union is at least ``NUM / DEN``, and classes are the
components of the links.

One hash function orders all shingles.  A sketch keeps the ``K`` smallest values
of a set, so a set of at most ``K`` is kept whole.  Of the union of two sets,
the ``K`` smallest values are known from both sketches, and the share of them
that is in both estimates the similarity without bias.

1. Inverted lists: every retained value lists the texts that keep it.  Values of
   one text only go.  A text then needs a number of shared values: ``NUM/DEN`` of
   its size where all its partners are kept whole, else the number that a pair
   of similarity ``NUM/DEN`` falls short of with a probability below ``RISK``.
   Texts with fewer have no partner.  The others need only those of their
   rarest shared values that cannot all be missing from a partner.
2. Texts that share such a value are a cluster.  Clusters come with their texts
   to a task, in blocks: a cluster of more than ``BLOCK`` texts is cut by size
   of set, where only neighbouring sizes can be similar, and by hash, and every
   two blocks that can hold a link meet.  No pair of a cluster is ever a row.
3. In a block the inverted lists of a text's values count its overlap with all
   others.  Size, overlap and the union sketch filter, then full sets decide
   between texts that are not connected yet.  A block returns one link per text.

Steps 1 and 2 lose a link with a probability of at most ``RISK`` and only where
sets exceed 0.8 ``K``; every link is confirmed on full sets of 64-bit hashes.
A cluster beyond one block costs the square of its texts of like size, in tasks
of bounded memory (``BLOCK`` texts a side, of which the sets are held).

Nulls: a null text has no words, like an empty one: size zero, linked with
nothing, its component is its own id.  A text of fewer than four words is one
shingle.  A null id keeps its row, is never kept, and names no class that has
another id.  Repeated rows stay repeated.  Other columns of the input are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches, written
from tablegov.llm.simhash import components

SHINGLE = 4
NUM, DEN = 4, 5       # least similarity, in whole numbers
K = 64                # retained values of a sketch
RISK = 1e-9           # of losing one link between sets that are not kept whole
BLOCK = 1_024         # texts of one side of a block, if they are not longer than
SHINGLES_PER_TEXT = 2_048  # shingles on average

_SEED = 42
_PAIRS_AT_ONCE = 16_384


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of one UTF-8 text, in order."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, _SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    hashes = [digest(joined[a:b], _SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())]
    return np.unique(np.array(hashes, np.uint64))


@cache
def least_common(kept: int) -> int:
    """Of ``kept`` smallest values of a union, the number that both sets have
    unless an event of probability ``RISK`` happens, at similarity NUM/DEN."""
    p, chance, total = NUM / DEN, (1 - NUM / DEN) ** kept, 0.0
    for hits in range(kept + 1):
        total += chance
        if total > RISK:
            return hits
        chance *= (kept - hits) / (hits + 1) * p / (1 - p)
    return kept


def least_shared(size: int, k: int) -> int:
    """Retained values that a set of this size has in common with any partner."""
    if size * DEN <= k * NUM:  # partners are at most DEN/NUM as large and kept whole
        return -(-NUM * size // DEN)
    return max(1, least_common(min(size, k)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
             set_of: Callable[[bytes | None], np.ndarray] = shingles) -> DataFrame:
    """One row per input row: ``id``, ``node`` (hash of the text), ``n`` (size of its set),
    ``least`` (common values it needs) and ``sketch`` (its ``k`` smallest values, signed, in order)."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [set_of(t) for t in batch.column(2).to_pylist()]
            kept = [s[:k].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([least_shared(len(s), k) for s in sets], pa.int32()), pa.array(kept, pa.list_(pa.int64()))],
                names=["id", "node", "n", "least", "sketch"])

    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col).cast("binary")).mapInArrow(
        run, f"id {kind}, node bigint, n bigint, least int, sketch array<bigint>")


def clusters(sketched: DataFrame) -> DataFrame:
    """``node``, ``label`` of the texts that may have a partner; partners have the same label."""
    unlike = sketched.select("node", "least", "sketch").dropDuplicates(["node"])
    posts = unlike.select("node", "least", F.explode("sketch").alias("v"))
    lists = posts.groupBy("v").agg(F.count("*").alias("many")).where("many > 1")
    shared = posts.join(lists, "v").groupBy("node").agg(
        F.first("least").alias("least"), F.array_sort(F.collect_list(F.struct("many", "v"))).alias("shared"))
    # A text has at most k shared values, the rarest first.
    needed = written(shared.where(F.size("shared") >= F.col("least")).select(
        "node", F.explode(F.expr("slice(shared.v, 1, size(shared) - least + 1)")).alias("v")), "shared-values")
    first = needed.groupBy("v").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("v", "b")
    return components(needed.join(first, "v").where("node <> b").select(F.col("node").alias("a"), "b"))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """``node`` of ``members`` (``label``, ``n``) with ``key`` and ``side``: rows of one key
    are compared, side 0 with side 1 where that is there, else all with each other."""
    # A block holds at most so many texts, and where they are long so many shingles.
    weight = F.greatest(F.count("*"), F.sum("n") / F.lit(SHINGLES_PER_TEXT))
    sizes = members.groupBy("label").agg(weight.alias("many"))
    # Similar sets are at most DEN/NUM apart in size: their bands are neighbours at most.
    banded = members.join(sizes, "label").withColumn(
        "band", F.when(F.col("many") <= block, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM + 1e-9)))))
    parts = banded.groupBy("label", "band").agg(F.ceil(weight / F.lit(block)).alias("parts"))
    above = parts.select("label", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_above"))
    below = parts.select("label", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_below"))
    parts = parts.join(above, ["label", "band"], "left").join(below, ["label", "band"], "left")
    own = banded.join(parts, ["label", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # Meetings of a block: itself, later and earlier blocks of its band, all blocks of the bands beside it.
    meets = F.expr("""concat(
        transform(sequence(0L, parts - 1), x -> struct(band AS band, least(x, part) AS i, band AS other, greatest(x, part) AS j, int(x < part) AS side)),
        if(parts_above IS NULL, array(), transform(sequence(0L, parts_above - 1),
            x -> struct(band AS band, part AS i, band + 1 AS other, x AS j, 0 AS side))),
        if(parts_below IS NULL, array(), transform(sequence(0L, parts_below - 1),
            x -> struct(band - 1 AS band, x AS i, band AS other, part AS j, 1 AS side))))""")
    met = own.select("node", "n", "label", F.explode(meets).alias("m"))
    return met.select("node", "n", F.xxhash64("label", "m.band", "m.i", "m.other", "m.j").alias("key"), F.col("m.side").alias("side"))


def merge(label: np.ndarray, a: int, b: int) -> None:
    """Joins the classes of ``a`` and ``b``; a label is the smallest member."""
    x, y = label[a], label[b]
    if x != y:
        label[label == max(x, y)] = min(x, y)


def block_links(sets: list[np.ndarray], side: np.ndarray, k: int) -> np.ndarray:
    """Labels of the texts of one block after all its links are made."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    kept = [s[:k] for s in sets]
    count = np.array([len(s) for s in kept])
    column = np.unique(np.concatenate(kept), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    members = np.repeat(np.arange(len(sets)), count)[order]          # the inverted lists, one after another
    edge = np.searchsorted(column[order], np.arange(column.max() + 2))
    begin = np.cumsum(count) - count
    padded = np.full((len(sets), k), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(kept):
        padded[i, :len(s)] = s
    need = np.array([least_common(m) for m in range(k + 1)])
    two = side.any()
    known = Lookup(sets)
    for i in range(len(sets) - 1):
        if two and side[i]:
            continue
        rest = np.flatnonzero(side == 1) if two else np.arange(i + 1, len(sets))
        fits = sizes_fit(size[rest], size[i]) & (label[rest] != label[i])
        rest = rest[fits]
        if not len(rest):
            continue
        lists = [members[edge[v]:edge[v + 1]] for v in column[begin[i]:begin[i] + count[i]]]
        overlap = np.bincount(np.concatenate(lists), minlength=len(sets))[rest]
        rest = rest[overlap >= need[np.minimum(k, np.maximum(size[rest], size[i]))]]
        for at in range(0, len(rest), _PAIRS_AT_ONCE):
            some = rest[at:at + _PAIRS_AT_ONCE]
            some = some[_estimate(padded[i], padded[some], k, need)]
            for j in known.similar(i, some):
                merge(label, i, j)
    return label


def _estimate(one: np.ndarray, others: np.ndarray, k: int, need: np.ndarray) -> np.ndarray:
    """Whether the union sketch of ``one`` and each of ``others`` allows a link."""
    both = np.sort(np.concatenate((np.broadcast_to(one, others.shape), others), axis=1), axis=1)
    real = both < np.iinfo(np.uint64).max
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    order = np.cumsum(new & real, axis=1)           # place of a value in the union
    hits = (~new & real & (order <= k)).sum(axis=1)  # in both, and among the k smallest
    return hits >= need[np.minimum(order[:, -1], k)]


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


class Lookup:
    """Sizes of intersections with full sets, one row at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        values, self.number = np.unique(every, return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.end = np.cumsum(self.size)

    def _of(self, i: int) -> np.ndarray:
        return self.number[self.end[i] - self.size[i]:self.end[i]]

    def similar(self, i: int, others: np.ndarray) -> list[int]:
        if not len(others):
            return []
        self.mark[own := self._of(i)] = True
        found = []
        for j in others.tolist():
            common = int(np.count_nonzero(self.mark[self._of(j)]))
            if DEN * common >= NUM * (self.size[i] + self.size[j] - common):
                found.append(j)
        self.mark[own] = False
        return found


def links(docs: DataFrame, sketched: DataFrame, text_col: str = "text", k: int = K, block: int = BLOCK,
          set_of: Callable[[bytes | None], np.ndarray] = shingles,
          solve: Callable[[list[np.ndarray], np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(``a``, ``b``): links between texts whose closure gives the classes.  ``solve``
    labels the texts of one block, by default ``block_links``."""
    solve = solve or block_links
    candidates = written(clusters(sketched), "clusters")
    members = sketched.select("node", "n").distinct().join(candidates, "node")
    dealt = _blocks(members, block)
    # Copies of a text meet before the shuffle, in the aggregation.
    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).cast("binary").alias("t")).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in range(4)))

        for _, group in groupby(rows(), key=lambda r: r[0]):
            side, node, sets = [], [], []
            for _, s, x, text in group:  # of a text only its set is held
                side.append(s)
                node.append(x)
                sets.append(set_of(text))
            if len(sets) > 1:
                label = solve(sets, np.array(side), k)
                at = np.flatnonzero(label != np.arange(len(sets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[i] for i in at], pa.int64()), pa.array([node[i] for i in label[at]], pa.int64())], names=["a", "b"])

    met = dealt.join(texts, "node").select("key", "side", "node", "t")
    return met.repartition("key").sortWithinPartitions("key", "side", "node").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, block: int = BLOCK,
                    set_of: Callable[[bytes | None], np.ndarray] = shingles,
                    solve: Callable[[list[np.ndarray], np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (the
    smallest id that links reach) and ``kept`` (whether that is the row's own)."""
    sketched = written(sketches(docs, id_col, text_col, k, set_of), "sketches")
    label = components(written(links(docs, sketched, text_col, k, block, set_of, solve), "links"))
    first = sketched.groupBy("node").agg(F.min("id").alias("first_id"))
    named = written(first.join(label, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), "first_id"), "bottom-k-labels")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_text = named.join(smallest, "label").select("node", "component_id")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return sketched.select("id", "node", "n").join(of_text, "node").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
