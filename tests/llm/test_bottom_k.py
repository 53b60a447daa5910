"""Bottom-k classes against the similarities of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegov.llm import bottom_k


def brute(docs):
    sets = []
    for _, text in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [j for (j, _), v in zip(docs, label) if v == label[k] and j is not None]
        least = (min(ids) if ids else None) if sets[k] else i
        out.append((i, len(sets[k]), least, i is not None and i == least))
    return out


def texts():
    rng = np.random.default_rng(11)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 3000, n)]

    def edited(words, at):
        words = list(words)
        for i in at:
            words[i] = f"x{rng.integers(1e9)}"
        return words

    docs, passage, line = [], prose(45), prose(6)
    for n in (9, 30, 60, 90, 200, 400):  # around the threshold, below and above the size of a sketch
        base = prose(n)
        docs += [base] + [edited(base, rng.choice(n, k, replace=False)) for k in range(1, 2 + n // 20) for _ in range(2)]
        docs += [base + prose(n // 5), base + prose(n // 4 + 1), base[:-(n // 5)], base[n // 6:]]
    base = prose(120)                     # a large group of near copies
    docs += [edited(base, rng.choice(120, int(rng.integers(1, 5)), replace=False)) for _ in range(60)]
    at = prose(150)                       # a chain: neighbours are alike, the ends are not
    for step in range(8):
        docs.append(at)
        at = edited(at, [step * 17 + 5, step * 17 + 12])
    docs += [prose(int(rng.integers(1, 30))) + passage for _ in range(40)]  # a frequent passage that fills most of the text
    docs += [line + prose(40) for _ in range(30)]
    docs += [[], ["one"], ["one"], ["one", "two", "three"], prose(4), prose(5)]
    docs = [" ".join(d) for d in docs]
    rng.shuffle(docs)
    odd = [(900, None), (901, None), (902, ""), (903, " \t\n"), (904, docs[3].upper()), (None, docs[4]), (None, "alone here"), (None, None),
           (5, docs[6]), (905, docs[7]), (905, docs[7]), (906, docs[8].replace(" ", " \n ")), (907, "Ünlike École a b c"),
           (908, "ünlike École A B C"), (909, " ".join(f"long{i}" for i in range(30_000))),
           (910, " ".join(f"long{i}" for i in range(27_000))), (911, " ".join(f"long{i}" for i in range(20_000)))]
    return [(i, t) for i, t in enumerate(docs)] + odd


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("k,block", [(64, 1024), (64, 7), (32, 16)])
def test_classes_equal_brute_force(spark, k, block):
    docs = texts()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for name in ("id", "node", "n", "sketch", "label", "key", "side", "many", "v", "t"):
        frame = frame.withColumn(name, F.lit("x"))
    got = bottom_k.near_duplicates(frame, k=k, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(docs)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert 60 < len({r[2] for r in want}) < len(docs) - 80


def test_nothing_and_other_id_types(spark):
    assert bottom_k.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = bottom_k.near_duplicates(spark.createDataFrame([("b", "x y z u v"), ("a", "X y z u v")], "name string, body string"),
                                    "name", "body").collect()
    assert sorted(map(tuple, rows)) == [("a", 2, "a", True), ("b", 2, "a", False)]


def test_least_common_is_a_quantile():
    """The bound is passed by fewer than RISK of the sketches, and is not idle."""
    for kept in (1, 10, 64, 128):
        n = bottom_k.least_common(kept)
        hits = np.random.default_rng(1).binomial(kept, 0.8, 200_000)
        assert (hits >= n).all() and n <= 0.8 * kept
    assert bottom_k.least_common(64) >= 30 and bottom_k.least_shared(51, 64) == 41 and bottom_k.least_shared(52, 64) < 41


def test_union_sketch_estimates_without_bias():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (900, 100, 130))
    one, two = (np.sort(np.concatenate((common, x))) for x in (a, b))
    need = np.arange(65)
    union = np.sort(np.unique(np.concatenate((one, two))))[:64]
    exact = int((np.isin(union, one) & np.isin(union, two)).sum())
    for hits in (exact, exact + 1):
        need[64] = hits
        assert bottom_k._estimate(one[:64], two[None, :64], 64, need)[0] == (hits <= exact)
