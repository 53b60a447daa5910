"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablegov.llm import spelling


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def counted(docs, drop_every=None):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 5}


def brute(docs, drop_every=None):
    n = counted(docs, drop_every)
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts():
    rng = np.random.default_rng(8)
    roots = ["".join(rng.choice(list("abcdeé"), int(rng.integers(6, 12)))) for _ in range(60)]
    words = []
    for root in roots:
        words += [root] * int(rng.integers(5, 400))
        for _ in range(6):
            at, c = int(rng.integers(0, len(root))), str(rng.choice(list("abcdeéß")))
            words += [[root[:at] + root[at + 1:], root[:at] + c + root[at:], root[:at] + c + root[at + 1:]][int(rng.integers(3))]] * int(
                rng.choice([1, 3, 5, 9, 30]))
    words += ["aaaaaa"] * 6 + ["aaaaaaa"] * 40 + ["aaaaaaaa"] * 300 + ["Aaaaaab"] * 6 + ["abababab"] * 50 + ["bababab"] * 9 + ["short"] * 50
    words += ["chained"] * 2000 + ["chaine"] * 0 + ["chainedd"] * 300 + ["chaineddd"] * 50 + ["chainedddd"] * 8
    words += ["tietie"] * 5 + ["tietia"] * 30 + ["tietib"] * 30
    rng.shuffle(words)
    docs = [(i, " ".join(words[a:a + 40])) for i, a in enumerate(range(0, len(words), 40))]
    return docs + [(None, "Nullid7nullid nullid-nullid_nullid"), (800, None), (801, ""), (802, "×÷ 12 ÀÀÀÀÀÀ ÀÀÀÀÀÀ àààààà"),
                   (803, "unseenx " * 2000), (803, "unseenx " * 3), (804, "unseen " * 20)]


@pytest.mark.parametrize("drop_every,limit", [(None, 8192), (7, 8192), (7, 2)])
def test_variants_equal_brute_force(spark, drop_every, limit):
    docs = texts()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for name in ("word", "n", "m", "key", "t", "near", "root", "form"):
        frame = frame.withColumn(name, F.lit("x"))
    got = spelling.variants(frame, drop_every=drop_every, limit=limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(docs, drop_every)
    assert sorted(map(tuple, got.collect())) == want
    if not drop_every:
        chain = {r[0]: r for r in want}
        assert chain["chainedddd"][1:3] == ("chaineddd", "chained") and chain["tietie"][1] == "tietia" and chain["nullid"][3] == 5
        assert sum(r[1] is not None for r in want) > 40


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@given(st.lists(st.text("abß", min_size=6, max_size=9), min_size=2, max_size=30, unique=True))
@settings(max_examples=150, deadline=None)
def test_bitsets_find_one_error(words):
    index = spelling.Index(words)
    for w in words:
        hits = index.near(w)
        assert [v for i, v in enumerate(words) if hits >> i & 1] == [v for v in words if one_error(w, v)]


def test_small_shards_lose_no_pair(spark):
    """With a limit of two words every shard is dealt down to one free letter."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("ab"), int(rng.integers(6, 9)))) for _ in range(300)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    want = sorted((a, b) for a in words for b in words if one_error(a, b))
    for limit in (2, 40, 8192):
        assert sorted((r[0], r[1]) for r in spelling.near_pairs(frame, limit).collect()) == want
