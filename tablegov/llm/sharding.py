"""Balanced shards by histogram sort.

Rows are ordered by a hash of their group (equal texts), then by a hash of their
id.  The shard boundaries are found on counts alone: each round cuts the open
key intervals into 4,096 probes and adds up the exact bytes below each probe
over all partitions; a boundary settles when a probe meets its target within the
tolerance, else the interval that holds the target is cut again.  Group hashes
come first, so a group is only cut when it is larger than the tolerance allows.
Once all splitters are known, the rows are exchanged once, by ranges of the
order, and numbered without gaps: each range counts by itself, and a small table
of range totals carries the offsets.

Nulls: a null group is a group of its own, a null id sorts by the hash of
nothing, a null size counts zero.  Rows that repeat group and id cannot be told
apart by the order and share a shard.  Other columns are kept; names that begin
with two underscores are this module's, and an input that has ``shard`` or ``slot``
already is refused.  An empty table gives an empty result;
fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegov.llm.common import written

# How far a boundary may lie from its target, as a share of the mean shard.
TOLERANCE = 0.005
_BITS = 12
_LEVELS = (12, 24, 36, 48, 60, 64)


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits)


class _Open:
    """A boundary that is still searched: the interval's prefix, the bytes
    before the interval, and the target."""
    def __init__(self, target: int):
        self.target, self.prefix, self.below, self.group = target, None, 0, None


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """Boundaries (``__group``, ``__tie``), each the first key of its shard, and
    the number of counting rounds.  ``rows`` has ``__group``, ``__tie``, ``__size``."""
    total = rows.agg(F.sum("__size")).first()[0]
    if total is None:
        return [], 0
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    waiting = {i: _Open(total * i // shards) for i in range(1, shards)}
    rounds = 0
    for column in ("__group", "__tie"):
        before = None
        for bits in _LEVELS:
            if not waiting:
                break
            rounds += 1
            part = rows
            if column == "__tie":
                part = part.where(F.col("__group").isin(sorted({o.group for o in waiting.values()})))
            if before is not None:
                part = part.where(_prefix(F.col(column), before).isin(sorted({o.prefix for o in waiting.values()})))
            owner = F.col("__group") if column == "__tie" else F.lit(0).cast("long")
            counted = part.groupBy(owner.alias("g"), _prefix(F.col(column), bits).alias("p")).agg(
                F.sum("__size").alias("b")).collect()  # at most 4,096 rows for each open boundary
            histogram: dict[tuple, list[tuple[int, int]]] = {}
            for g, p, b in sorted(map(tuple, counted)):
                parent = None if before is None else p >> (bits - before)
                histogram.setdefault((g, parent), []).append((p, b))
            for i, o in list(waiting.items()):
                below = o.below
                cells = histogram[(o.group if column == "__tie" else 0, o.prefix)]
                for p, b in cells:
                    if below + b > o.target:
                        break
                    below += b
                edges = [(abs(below - o.target), p, 0), (abs(below + b - o.target), p, 1)]
                distance, at, side = min(edges)
                last = bits == 64 and (column == "__tie" or b == 0)
                if distance <= slack or last:
                    edge = (at + side) << (64 - bits)
                    if edge >= 1 << 63:  # beyond the last key of this column
                        edge = None
                    if column == "__group":
                        found[i] = (edge, -(1 << 63)) if edge is not None else ((1 << 63) - 1, (1 << 63) - 1)
                    else:
                        found[i] = (o.group, edge if edge is not None else (1 << 63) - 1)
                    del waiting[i]
                else:
                    o.prefix, o.below = p, below
            before = bits
        for o in waiting.values():  # one group alone holds the boundary: cut it by its ids
            o.group, o.prefix = o.prefix, None
    return [found[i] for i in sorted(found)], rounds


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the key of a row, by binary search."""
    if not bounds:
        return F.lit(0)
    groups, ties = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(n: Column, s: Column) -> Column:
        group, tie = F.get(groups, n + s - 1), F.get(ties, n + s - 1)
        reached = (group < F.col("__group")) | ((group == F.col("__group")) & (tie <= F.col("__tie")))
        return F.when((n + s <= len(bounds)) & reached, n + s).otherwise(n)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def histogram_shards(rows: DataFrame, shards: int, id_col: str, size_col: str, group_col: str,
                     tolerance: float = TOLERANCE, rows_per_range: int = 200_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``.  ``rows`` is read several times, so
    give a stored frame; ``group_col`` must already be a hash (a long)."""
    if taken := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows have columns that the result adds: {sorted(taken)}")
    keyed = rows.withColumns({
        "__group": F.coalesce(F.col(group_col), F.lit(0)).cast("long"), "__tie": F.xxhash64(id_col),
        "__size": F.coalesce(F.col(size_col), F.lit(0))})
    bounds, _ = splitters(keyed, shards, tolerance)
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // rows_per_range))
    placed = keyed.withColumn("shard", shard_of(bounds)).repartitionByRange(ranges, "__group", "__tie")
    placed = written(placed.sortWithinPartitions("__group", "__tie").withColumn(
        "__at", F.monotonically_increasing_id()), "shards")
    ranged = placed.withColumn("__range", F.shiftright("__at", 33))
    # One row for each range and shard: as many as there are ranges, and shards, together.
    parts = ranged.groupBy("shard", "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(
        "shard", "__range", "__first", "__before")
    slot = F.col("__at") - F.col("__first") + F.col("__before")
    return ranged.join(parts, ["shard", "__range"]).withColumn("slot", slot).select(*rows.columns, "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
