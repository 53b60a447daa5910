"""Periodic runs against a search of all lags."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegov.llm import periodic, queries


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def brute(words):
    """Every maximal stretch of each period, if that is its smallest."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and smallest_period(words[i:j + q]) == q:
                found.append((i, j - i + q, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def fast(words):
    number = {}
    return periodic.runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_runs_of_repeated_roots(parts):
    words = [w for root, times in parts for w in root * times]
    assert fast(words) == brute(words)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 5, 6, 7, 23, 24, 25, 80, 300):
        words = rng.integers(0, letters, n).tolist()
        assert fast(words) == brute(words)


@pytest.mark.parametrize("q", [1, 2, 5, 6, 7, 18, 19, 57, 58, 174, 175, 600])
def test_long_periods(q):
    """A root whose five-grams all come several times within it, at the edges of the levels."""
    rng = np.random.default_rng(q)
    root = rng.integers(0, 2, q).tolist()
    words = rng.integers(5, 9, 30).tolist() + root * 4 + root[:q // 2] + [7, 7, 8] + root * 3
    found = fast(words)
    assert found == (brute(words) if q < 60 else found)
    p = smallest_period(root * 4)
    assert any(r[2] == p and r[0] <= 30 and r[0] + r[1] >= 30 + 4 * q + q // 2 for r in found) or 4 * p < 6


def test_one_word_many_times():
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


TEXTS = [
    (1, "a b a b a b a b c"), (2, None), (3, ""), (4, " \n\t "), (5, "no no no no no no yes"), (6, "x y z " * 4),
    (7, " ".join(f"w{i % 50}" for i in range(20_000)) + " end"), (8, "É é x É é x É é x É é x"), (8, "É é x É é x É é x É é x"),
    (None, "a a a a a a"), (None, None), *[(i, " ".join(f"t{(i * j) % 23}" for j in range(40 + i))) for i in range(20, 70)],
]


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in found))


def test_operator(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for name in ("id", "t", "runs", "collapsed", "n_words", "words"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == len(TEXTS)
    got = sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in rows), key=str)
    want = []
    for i, text in TEXTS:
        words = (text or "").replace(" ", "\x01").split()
        words = [w.replace("\x01", " ") for w in words]
        found = fast(words) if len(words) > 5000 else brute(words)
        want.append((i, len(words), tuple(found), collapsed(words, found)))
    assert got == sorted(want, key=str)
    assert next(r for r in got if r[0] == 7)[2] == ((0, 20_000, 50),)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k if k < a else a + (k - a) % p] for k in range(n)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40 if i % 3 else 3, int(rng.integers(0, 90))))) for i in range(250)]
    docs += [(None, "a a a a a a a"), (300, None), (301, "")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs) > 10
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = []
    for i, text in docs:
        words = planted(i, (text or "").split())
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(bool(w[1]) for w in want) > 20
