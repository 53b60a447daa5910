"""SimHash fingerprints and near-duplicate classes found with BK-trees.

A fingerprint has a bit set when more than half of the shingle hashes have it.
Two fingerprints that differ in at most ``radius`` bits agree in at least one of
``radius + 1`` blocks of bits, so the distinct fingerprints are dealt into
shards by (block, value of the block).  Every shard becomes a BK-tree: a child
hangs below its parent under their integer Hamming distance, and a search at
distance d from a node follows only the edges d - radius .. d + radius.  A task
builds the trees of all its shards at once with numpy, and a shard gives at
most one link per member (a spanning forest), never its pairs.  Links between
distinct fingerprints lose nothing; equal texts are equal fingerprints and are
one node from the start.

A shard with more than ``shard_limit`` members is cut again by blocks of its
remaining bits, which keeps the search exact, until no bits are left to cut.

Nulls: a null text has no words, hence fingerprint zero, like an empty one.  A
null id keeps its row but never names a class that has another id.  Repeated
rows stay repeated.  An empty table gives an empty result.  Other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches, written
from tablegov.session import cut

# Members of one shard's trees that a task handles before the shard is cut again.
SHARD_LIMIT = 16_384

_SEED = 42
# Tree nodes that the searches of one step may meet together at most.
_VISITS_AT_ONCE = 4_000_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], _SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    votes = np.zeros(64, np.int64)
    every = np.array(hashes, dtype=">u8")
    for at in range(0, len(every), 65_536):
        part = every[at:at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, the signed 64-bit SimHash of every row."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"`{id_col}` {kind}, fp bigint")


class Forest:
    """BK-trees over all shards of one chunk.  ``shard`` must be sorted; the
    values within a shard are distinct."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        self.value = value
        self.root = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(len(value)), 0))
        at, left = self.root.copy(), np.flatnonzero(self.root != np.arange(len(value)))
        slots, children = [], []
        while len(left):  # one level of all trees per round
            slot = at[left] * 65 + np.bitwise_count(value[left] ^ value[at[left]])
            new, first, which = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(new)
            children.append(left[first])
            at[left] = left[first][which]
            left = left[at[left] != left]
        self.slot = np.concatenate(slots) if slots else np.empty(0, np.int64)
        self.child = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.slot, kind="stable")
        self.slot, self.child = self.slot[order], self.child[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) within ``radius``, each pair from one side only."""
        found_q, found_n = [], []
        q, node = queries, self.root[queries]
        while len(q):
            distance = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (distance <= radius) & (node < q)
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.slot, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.slot, node * 65 + np.minimum(distance + radius, 64), side="right")
            many = high - low
            q = np.repeat(q, many)
            node = self.child[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(q))]
        return np.concatenate(found_q), np.concatenate(found_n)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining ``a`` and ``b``; a label is the smallest member."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, again := label[label]):
            label = again
    return label


def shard_links(shard: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted shards of a chunk: (value, value of its local class's
    first member) for every member that is not the first."""
    forest = Forest(shard, value)
    label = np.arange(len(value))
    # Roots without children have nothing to find.  A search meets the nodes of its own shard at most.
    members = np.bincount(forest.root, minlength=len(value))[forest.root]
    queries = np.flatnonzero(members > 1)
    step = np.cumsum(members[queries]) // _VISITS_AT_ONCE
    for part in np.split(queries, np.flatnonzero(np.diff(step)) + 1) if len(queries) else []:
        label = _merge(label, *forest.near(part, radius))
    linked = np.flatnonzero(label != np.arange(len(value)))
    return value[linked], value[label[linked]]


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _block(bits: list[int]):
    """Value of a run of neighbouring bits of ``fp``."""
    return F.shiftrightunsigned("fp", bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def _dealt(fps: DataFrame, radius: int, limit: int) -> DataFrame:
    """(``shard``, ``fp``): every fingerprint once for each block of its bits;
    shards above ``limit`` cut again by their remaining bits."""
    def deal(df: DataFrame, key, bits: list[int]) -> list[tuple[DataFrame, list[int]]]:
        out = []
        for no, run in enumerate(_cuts(bits, radius + 1)):
            rest = [b for b in bits if b not in run]
            out.append((df.select(F.xxhash64(key, F.lit(no), _block(run)).alias("shard"), "fp"), rest))
        return out

    done: list[DataFrame] = []
    todo = [(fps, F.lit(0).cast("long"), [list(range(64))])]
    while todo:
        df, key, (bits, *_) = todo.pop()
        for part, rest in deal(df, key, bits):
            # A run of the rest must be of neighbouring bits: the longer side of the gap goes on.
            gap = next((i for i in range(1, len(rest)) if rest[i] != rest[i - 1] + 1), len(rest))
            longer = max(rest[:gap], rest[gap:], key=len)
            big = part.groupBy("shard").count().where(F.col("count") > limit).select("shard")
            if len(longer) < 2 * (radius + 1) or big.isEmpty():
                done.append(part)
                continue
            big = cut(big)
            done.append(part.join(big, "shard", "left_anti"))
            todo.append((part.join(big, "shard", "left_semi"), F.col("shard"), [longer]))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def links(fps: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(``a``, ``b``) with ``a`` > ``b`` in some order: links between the distinct
    values of ``fps.fp`` whose closure joins exactly the values that chains of at
    most ``radius`` differing bits connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def solve(shard, value):
            a, b = shard_links(shard, value.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=["a", "b"])

        for batch in batches:
            shard, value = (batch.column(i).to_numpy() for i in (0, 1))
            kept.append((shard, value))
            last = np.flatnonzero(shard != shard[-1])
            if len(last) and sum(len(s) for s, _ in kept) >= 50_000:
                end = last[-1] + 1  # the last shard may go on in the next batch
                whole = [np.concatenate(x) for x in zip(*kept[:-1], (shard[:end], value[:end]))]
                kept = [(shard[end:], value[end:])]
                yield solve(*whole)
        if kept:
            yield solve(*[np.concatenate(x) for x in zip(*kept)])

    shards = _dealt(fps.select("fp").distinct(), radius, shard_limit)
    return shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(
        run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``label``) of every node of ``edges`` (``a``, ``b``): the label
    is the smallest node that can be reached.  Large-star and small-star rounds
    hang every node below ever smaller neighbours until nothing changes; each
    round is checkpointed, and no component is ever gathered."""
    edges = cut(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    size = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
    state = edges.select(size).first()
    for _ in range(max_rounds):
        if not state[0]["n"]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct())
        now = edges.select(size).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` and ``component_id``, the
    smallest id among all rows whose fingerprints chains of links reach."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first_id"))
    label = components(links(prints, radius, shard_limit)).select(F.col("node").alias("fp"), "label")
    linked = cut(label.join(first, "fp"))
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    joined = linked.join(smallest, "label").select("fp", "component_id")
    classes = first.join(joined, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               radius: int = 3) -> DataFrame:
    """``docs`` with one row of every class: the one of smallest id.  Rows that
    repeat both id and text are reduced to one; rows without an id stay."""
    return first_rows(docs, lambda rows, key: near_duplicates(rows, key, text_col, shingle, radius), id_col, text_col)


def first_rows(docs: DataFrame, classes: Callable[[DataFrame, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The first row of every class of ``classes(rows, key)``, and the rows without an
    id.  The key is id and hash of the text, so rows of one id and unlike texts are apart."""
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")))
    keyed = docs.withColumn("__key", key)
    first = classes(keyed, "__key").where("__key = component_id").select("__key").distinct()
    # The joined rows lie by key already: reducing repeated rows moves nothing.
    kept = keyed.join(first, "__key").dropDuplicates(["__key"]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
