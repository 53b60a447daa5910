"""Periodic runs of words inside documents: stretches that repeat themselves.

A run is a maximal stretch of consecutive words whose smallest period is q and
whose length is at least ``max(MIN_LENGTH, MIN_TURNS * q)``.  Seed and extend
along diagonals: words i and i + q of a run are equal for at least
``max(MIN_LENGTH - q, (MIN_TURNS - 1) * q)`` positions in a row, the guaranteed
overlap of lag q.  Lags are taken in levels.  A level indexes the k-grams of
the document, k being the overlap that its smallest lag guarantees; because
its largest lag is k, a gram comes again inside a run exactly one period later,
so the pairs of neighbouring occurrences seed every run of the level and a
document has at most one seed per word and level.  A seed is extended along
its diagonal unless the table of furthest covered positions, one entry per
lag, says that this was done.  Levels grow threefold and end when no gram of a
level comes twice, so most documents need one or two.

One document is one row and is searched by one task, in time proportional to
its words and the logarithm of its length; nothing is shuffled.  Nulls: a null
text has no words, like an empty one, and no runs; a null id keeps its row.
Repeated rows stay repeated.  Other columns of the input are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches

MIN_LENGTH, MIN_TURNS = 6, 4

_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def overlap(lag: int) -> int:
    """Equal positions in a row that a run of this period has at least."""
    return max(MIN_LENGTH - lag, (MIN_TURNS - 1) * lag)


def _end(ids: np.ndarray, at: int, lag: int) -> int:
    """First position from ``at`` on whose word differs from the one ``lag`` later."""
    last, step = len(ids) - lag, 64
    while at < last:
        to = min(at + step, last)
        unlike = ids[at:to] != ids[at + lag:to + lag]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = to, 2 * step
    return last


def _start(ids: np.ndarray, at: int, lag: int) -> int:
    """First position of the stretch of equal words that holds ``at``."""
    step = 64
    while at:
        low = max(at - step, 0)
        unlike = (ids[low:at] != ids[low + lag:at + lag])[::-1]
        if unlike.any():
            return at - int(unlike.argmax())
        at, step = low, 2 * step
    return 0


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers."""
    found, n = [], len(ids)
    least, k = 1, min(overlap(1), overlap(2))
    rank, size = ids, 1          # rank: a number for each gram of ``size`` words
    while MIN_TURNS * least <= n and MIN_LENGTH <= n:
        while 2 * size <= k:
            pair = rank[:-size] * (rank.max() + 1) + rank[size:]
            rank, size = np.unique(pair, return_inverse=True)[1], 2 * size
        gram = rank[:n - k + 1] * (rank.max() + 1) + rank[k - size:n - size + 1]
        order = np.argsort(gram, kind="stable")
        again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
        if not len(again):
            break
        seed = order[again]
        lag = order[again + 1] - seed
        mine = (lag >= least) & (lag <= k)
        seed, lag = seed[mine], lag[mine]
        furthest: dict[int, int] = {}
        for at in np.argsort(seed, kind="stable").tolist():
            i, q = int(seed[at]), int(lag[at])
            if i < furthest.get(q, 0):
                continue
            first, furthest[q] = _start(ids, i, q), _end(ids, i + k, q)
            length = furthest[q] - first + q
            if length >= max(MIN_LENGTH, MIN_TURNS * q):
                found.append((first, length, q))
        least = k + 1
        k = overlap(least)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run, or in the first period of all their runs."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``runs`` (array of start,
    length, period, by start and period) and ``collapsed``, the text without the
    repeated turns of its runs, words joined by one space."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, spans, kept = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                number: dict[bytes, int] = {}
                found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                many.append(len(words))
                spans.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                kept.append(collapse(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(many, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
                names=[id_col, "n_words", "runs", "collapsed"])

    found = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
