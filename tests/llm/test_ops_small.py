"""Each operator on a small frame with nulls, empty and long texts, ties, repeated
rows and extra columns, against brute force; and on an empty frame."""

import hashlib
import html
import math
import os
import re
import time
import tracemalloc
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tablegov.llm import (
    bpe, common, decontaminate, fingerprint, gru_lm, html_text, lm_score, perspectives, quality, sharding, simhash,
    training_order,
)
from tablegov.llm.common import written

LONG = " ".join(f"word{i % 700}. Next" for i in range(9_000))
TEXTS = [
    (1, "Alpha beta gamma. Delta epsilon!\nZeta eta theta iota kappa lambda mu nu xi"),
    (2, None), (3, ""), (4, "   "), (5, "one"), (6, "Alpha beta gamma. Delta epsilon!\nZeta eta theta iota kappa lambda mu nu xi"),
    (7, LONG), (8, "ÉCOLE École 東京 \x00 tab\tnew\nline"), (8, "ÉCOLE École 東京 \x00 tab\tnew\nline"),
    (None, "no id here"), (None, None), (9, "Zeta eta theta iota kappa lambda mu nu xi omicron pi rho"), (10, "one"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use inside."""
    df = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("id", "t", "w", "fp", "lanes", "rid", "lang", "source", "n_chars", "next", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_7(text):
    return (text or "").encode().lower().split()


# 1


def test_edited_texts(docs):
    got = fingerprint.edited(docs).collect()
    order = sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(order)
    # Rows without an id follow each other in the order of their hash; both orders are tried.
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    tails = [order[:-2] + order[-2:], order[:-2] + order[:-3:-1]]
    wanted = []
    for rows in tails:
        want = Counter()
        for k, (i, text) in enumerate(rows):
            half = len(text) // 2
            edited = text[:len(text) - half] + rows[(k + 1) % len(rows)][1][:half]
            want[i, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        wanted.append(want)
    assert found in wanted


def test_multiset_hash_is_homomorphic(spark):
    rows = [("a", "p"), ("a", "q"), ("a", "q"), ("b", "q"), ("b", "p"), ("b", "q"), ("c", "p"), ("c", "q"), ("d", "q"), ("e", "")]
    summed = fingerprint.sum_paragraphs(spark.createDataFrame(rows, "k string, piece string"), ["k"])
    lanes = {r["k"]: r["lanes"] for r in summed.collect()}
    assert lanes["a"] == lanes["b"] != lanes["c"]
    assert set(lanes["e"]) == {0}
    one = summed.alias("x").where("k = 'c'").join(summed.where("k = 'd'").select(F.col("lanes").alias("d")))
    assert one.select(fingerprint.combine(F.col("lanes"), F.col("d"))).first()[0] == lanes["a"]
    both = summed.where("k = 'a'").join(summed.where("k = 'd'").select(F.col("lanes").alias("d")))
    assert both.select(fingerprint.combine(F.col("lanes"), F.col("d"), -1)).first()[0] == lanes["c"]
    expected = [0] * (fingerprint.WORDS + 1)
    for piece in ("p", "q", "q"):
        for salt in range(3):
            h = xxhash.xxh64_intdigest(piece.encode(), xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), 42))
            for j in range(32):
                expected[salt * 32 + j] += h >> j & (1 | 1 << 32)
        expected[-1] += 1
    assert expected[-1] == lanes["a"][-1]
    alike = summed.where("k = 'a'").join(summed.select(F.col("lanes").alias("o"), F.col("k").alias("ok"))).select(
        "ok", fingerprint.likeness(F.col("lanes"), F.col("o")).alias("l"))
    likes = {r["ok"]: r["l"] for r in alike.collect()}
    assert likes["b"] == 1.0 and 0.5 < likes["c"] < 1.0 and likes["e"] == 0.0


def lanes_of(text):
    """Counters of every bit, paragraph by paragraph, and the number of paragraphs."""
    pieces = Counter(p for p in re.split(fingerprint.PARAGRAPH, text) if p)
    lanes = np.zeros(fingerprint.LANES, np.int64)
    for piece, n in pieces.items():
        bits = []
        for salt in range(3):
            h = xxhash.xxh64_intdigest(piece.encode(), xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), 42))
            bits += [h >> j & 1 for j in range(64)]
        lanes += n * np.array(bits)
    return lanes, sum(pieces.values())


def brute_likeness(a, b):
    (x, n), (y, m) = lanes_of(a), lanes_of(b)
    if n == m and (x == y).all():
        return 1.0
    x, y = (2 * x - n).astype(float), (2 * y - m).astype(float)
    size = x @ x + y @ y
    return min(max(2 * (x @ y) / size, 0.0), 1.0) if size else 0.0


def packed(text):
    lanes, n = lanes_of(text)
    return [int(lanes[64 * s + j] + (lanes[64 * s + 32 + j] << 32)) for s in range(3) for j in range(32)] + [n]


@pytest.mark.parametrize("texts", [
    [t for i, t in TEXTS if i and i not in (6, 8)],
    ["\n" * ((1 << 20) + 8), "\n" * ((1 << 20) + 7) + "x\n"]],
    ids=["small", "many paragraphs"])
def test_fingerprints_of_whole_texts(spark, texts):
    """Sums and both likenesses against counters kept one by one, also beyond 2^20 paragraphs."""
    rows = list(enumerate(texts, 1))
    own = fingerprint.edited(spark.createDataFrame(rows, SCHEMA)).select(
        "*", fingerprint.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        fingerprint.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"))
    got = {r["doc_id"]: r for r in own.collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text, following = text or "", texts[(i - 2) % len(texts)] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i]["lanes"] == packed(text) and got[i]["edited_lanes"] == packed(edited)
        assert got[i]["near_edited"] == pytest.approx(brute_likeness(text, edited), abs=1e-9)
        assert got[i]["near_next"] == pytest.approx(brute_likeness(text, following), abs=1e-9)


def test_sums_beyond_2_to_the_23(spark):
    """Counters neither carry nor overflow."""
    n = 9_000_000
    pieces = spark.range(n).select(F.lit("k").alias("k"), F.when(F.col("id") < 3, "x").otherwise("\n").alias("piece"))
    lanes = fingerprint.sum_paragraphs(pieces, ["k"]).first()["lanes"]
    assert lanes == [3 * a + (n - 3) * b for a, b in zip(packed("x"), packed("\n"))]


def test_edited_of_one_and_none(spark, nothing):
    assert fingerprint.edited(nothing).count() == 0
    row = fingerprint.edited(spark.createDataFrame([(5, "abcd")], SCHEMA)).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


# 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(spark, n):
    rows = spark.range(n).select(training_order.permuted(F.col("id"), n, 7).alias("a"),
                                 training_order.permuted(F.col("id"), n, 8).alias("b")).collect()
    assert sorted(r["a"] for r in rows) == sorted(r["b"] for r in rows) == list(range(n))
    if n > 90:
        assert [r["a"] for r in rows] != [r["b"] for r in rows] and [r["a"] for r in rows] != list(range(n))


def test_shards_hold_all_tokens(spark, docs, nothing, tmp_path):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    path = f"file://{tmp_path}/order"
    placed, _ = training_order.materialise(docs.repartition(3), vocabulary, public_tokenizers.PATTERN, 11, path, 16, 64)
    index = placed.orderBy("slot").collect()
    assert [r["slot"] for r in index] == list(range(len(index)))
    for r in index:
        file, = (tmp_path / "order" / f"shard={r['shard']}").glob("part-*")
        assert zlib.crc32(file.read_bytes()[r["byte_offset"]:][:32]) == r["crc32"]
    read = training_order.read_slots(spark, path, 60, 10, 16, 64).orderBy("slot").collect()
    assert [r["slot"] for r in read] == list(range(60, 70))
    ids = [r["ids"] for r in training_order.read_slots(spark, path, 0, len(index), 16, 64).orderBy("slot").collect()]
    assert [r["ids"] for r in read] == ids[60:70]
    # In packing order the sequences spell the documents, each with its end mark.
    flat = [x for r in sorted(index, key=lambda r: r["seq"]) for x in ids[r["slot"]][:r["n_tokens"]]]
    ranks = {t: r for r, t in enumerate(bpe.read_ranks(vocabulary))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found, doc = Counter(), []
    for x in flat:
        if x == 50_256:
            found[tuple(doc)] += 1
            doc = []
        else:
            doc.append(x)
    assert not doc and found == Counter(tuple(reference.encode_ordinary(t or "")) for _, t in TEXTS)
    assert training_order.materialise(nothing, vocabulary, public_tokenizers.PATTERN, 1)[0].count() == 0


# 3


def test_gradients_match_differences():
    spec = gru_lm.Spec(6, 2, 4, (0, 2, 6))
    model = gru_lm.Gru.start(spec, np.arange(9, 0, -1), seed=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, (5, 3)), rng.integers(0, 9, (5, 3))

    def loss():
        states = model.states(x, np.zeros((3, 4)))
        return -model.log_probs(states.reshape(-1, 4), y.ravel())[0].sum()

    keep, grads = {}, model.zero()
    states = model.states(x, np.zeros((3, 4)), keep)
    _, dh = model.log_probs(states.reshape(-1, 4), y.ravel(), grads)
    model.backward(x, keep, dh.reshape(states.shape), grads)
    rows = grads.pop("rows")
    full = np.zeros_like(model.w["inp"])
    full[rows] = grads["inp"]
    grads["inp"] = full
    for name, g in grads.items():
        w = model.w[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            before = w[at]
            w[at] = before + 1e-2
            up = loss()
            w[at] = before - 1e-2
            down = loss()
            w[at] = before
            assert abs((up - down) / 2e-2 - g[at]) < 2e-2 * max(1.0, abs(g[at])), name


def test_probabilities_sum_to_one_and_state_is_carried():
    spec = gru_lm.Spec(6, 2, 4, (0, 2, 6))
    model = gru_lm.Gru.start(spec, np.arange(9, 0, -1), seed=3)
    h = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    p = np.exp(model.log_probs(np.repeat(h, 9, 0), np.arange(9))[0])
    assert abs(p.sum() - 1) < 1e-5
    docs = [np.array([*np.random.default_rng(i).integers(0, 8, n), 8]) for i, n in enumerate((0, 1, 70, 3, 200))]
    whole = gru_lm.score(model, docs, lanes=2, steps=8)
    for doc, got in zip(docs, whole):
        state, total, before = np.zeros((1, 4), np.float32), 0.0, 8
        for token in doc:
            state = model.states(np.array([[before]]), state)[-1]
            total += float(model.log_probs(state, np.array([token]))[0][0])
            before = token
        assert abs(total - got) < 1e-3 * max(1, abs(got))


def test_scores(spark, docs, nothing):
    got = lm_score.score(docs).collect()
    train = [t for i, t in TEXTS if zlib.crc32(str("" if i is None else i).encode()) % 10]
    counts = Counter(w for t in train for w in words_7(t))
    total, types = sum(counts.values()) + len(train), len(counts) + 1
    z = total + 0.1 * (types + 1)
    want = Counter()
    for i, t in TEXTS:
        base = sum(math.log10((counts[w] + 0.1) / z) for w in words_7(t)) + math.log10((len(train) + 0.1) / z)
        held = zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
        want[i, held, len(words_7(t)) + 1, sum(counts[w] > 0 for w in words_7(t)) + 1, total, round(base, 4)] += 1
    assert want == Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.score(nothing).count() == 0
    held = spark.createDataFrame([(None, "a b"), (None, "")], SCHEMA)
    assert all(r["base_score"] == 0 and math.isfinite(r["score"]) for r in lm_score.score(held).collect())


# 4


def test_rotation(spark):
    rows = [("c", 0, "system", "Be kind"), ("c", 1, "ann", "Hi"), ("c", 2, "bob", None), ("c", 2, "ann", "Bye"),
            ("c", 300, None, "late"), (None, 0, "ann", "alone"), ("s", 0, "system", "only"), ("d", None, "ann", "x"), ("d", 0, "ann", "y")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("speaker", F.lit(1))
    got = {(r["conv_id"], r["speaker"], r["chunk"]): r for r in perspectives.rotate(df).collect()}
    assert set(got) == {*(("c", s, k) for s in ("ann", "bob", "unknown") for k in (0, 1)), (None, "ann", 0), ("d", "ann", 0)}
    ann = got["c", "ann", 0]
    assert ann["text"] == ("<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
                           "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n")
    assert [ann["text"][a:b] for a, b in ann["spans"]] == ["Hi<|im_end|>\n", "Bye<|im_end|>\n"]
    bob = got["c", "bob", 0]
    assert [bob["text"][a:b] for a, b in bob["spans"]] == ["<|im_end|>\n"] and bob["n_trained"] == 11
    assert got["c", "ann", 1]["spans"] == [] and got["d", "ann", 0]["n_turns"] == 2
    assert perspectives.rotate(df.limit(0)).count() == 0


# 5


def brute_kneser_ney(train, docs):
    """Interpolated modified Kneser-Ney, order three, with dictionaries."""
    def padded(t):
        return ["<s>", "<s>", *quality.words_of(t.encode()), "</s>"]
    tri = Counter(g for t in train for w in [padded(t)] for g in zip(w, w[1:], w[2:]))
    bi_raw = Counter()
    for g, n in tri.items():
        bi_raw[g[1:]] += n
    bi = Counter(g[1:] for g in tri)
    bi = Counter({g: bi_raw[g] if g[0] == "<s>" else n for g, n in bi.items()})
    uni = Counter(g[1:] for g in bi)
    vocabulary = {w for t in train for w in quality.words_of(t.encode())}

    def level(table):
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            d = (0.5, 0.75, 0.75)
        else:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            d = tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))
        total, left = Counter(), Counter()
        for g, c in table.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        def p(g, lower):
            if not total[g[:-1]]:
                return lower
            own = (table[g] - d[min(table[g], 3) - 1]) / total[g[:-1]] if g in table else 0.0
            return own + left[g[:-1]] / total[g[:-1]] * lower
        return p

    p3, p2, p1 = level(tri), level(bi), level(uni)
    out = []
    for t in docs:
        w, s = padded(t), 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            s += math.log10(p3((a, b, c), p2((b, c), p1((c,), 1 / (len(vocabulary) + 2)))))
        out.append(10 ** (-s / (len(w) - 2)))
    return out


def test_kneser_ney(spark):
    rng = np.random.default_rng(5)
    train = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 40) % 60) for _ in range(30)]
    other = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 25) % 90) for _ in range(10)] + ["", "Unseen WORDS, here."]
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), shards=3)
    rows = spark.createDataFrame(list(enumerate(other)), "i int, text string")
    got = [r["perplexity"] for r in quality.perplexities(rows, model).orderBy("i").collect()]
    assert np.allclose(got, brute_kneser_ney(train, other), rtol=1e-6)


@pytest.mark.parametrize("frequent,shards", [(4, 9), (40, 5), (0, 2)])
def test_kneser_ney_over_shards(spark, monkeypatch, frequent, shards):
    """Words without a number, and middle words dealt over several shards, have the same figures."""
    monkeypatch.setattr(quality, "FREQUENT", frequent)
    rng = np.random.default_rng(7)
    train = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) % 70) for _ in range(40)] + ["", "w1"]
    other = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 25) % 99) for _ in range(12)] + ["", "Unseen unseen WORDS."]
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), shards=shards)
    assert (model.dealing.spread > 1).any() == (frequent > 0)
    rows = spark.createDataFrame(list(enumerate(other * 2)), "i int, text string")
    got = [r["perplexity"] for r in quality.perplexities(rows, model).orderBy("i").collect()]
    assert np.allclose(got, brute_kneser_ney(train, other) * 2, rtol=1e-6)


def test_kneser_ney_in_rounds(spark, monkeypatch):
    """No round sends the n-grams of all documents, and its sums have left the disk at its end."""
    rng = np.random.default_rng(9)
    train = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60) for _ in range(30)]
    other = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 25) % 90) for _ in range(40)]
    model = quality.fit(spark.createDataFrame([(t,) for t in train], "text string"), shards=3)
    sent, sums, scored = [], [], quality._scored
    lent = quality.lent

    def counted(parcels, *shared):
        sent.append(parcels.where(F.col("kind") == quality._DOCS).agg(F.sum("n")).first()[0] or 0)
        return scored(parcels, *shared)

    @contextmanager
    def watched(df, name):
        with lent(df, name) as frame:
            sums.append((frame, frame.inputFiles(), frame.count()))
            yield frame

    monkeypatch.setattr(quality, "_scored", counted)
    monkeypatch.setattr(quality, "lent", watched)
    rows = spark.createDataFrame(list(enumerate(other)), "i int, text string")
    got = [r["perplexity"] for r in quality.perplexities(rows, model).orderBy("i").collect()]
    assert np.allclose(got, brute_kneser_ney(train, other), rtol=1e-6)
    assert sum(sent) == len(other) and len(sent) == quality.ROUNDS and max(sent) < 0.6 * len(other)
    assert any(n for _, _, n in sums)
    assert not any(os.path.exists(f.removeprefix("file://")) for _, files, _ in sums for f in files)


def test_kneser_ney_shard_fits_a_worker():
    """A shard's counts and tables take at most three times their n-grams at any moment; arrays that
    are not let go took more than four times as much."""
    rng = np.random.default_rng(3)
    many, each = 20, 10_000
    def words():
        w = rng.zipf(1.25, each) % 100_000
        return np.where(w < 60_000, w + 2, w - (1 << 62))
    rows = [quality._pack((words(), words(), words()), np.zeros(each, np.int64)) for _ in range(many)]
    dealing = quality.Dealing({}, np.ones(60_002, np.int64), 1)
    weights = quality.Weights((0.5, 0.75, 0.75), (0.5, 0.75, 0.75), np.full(60_002, 1e-5), 1e-7)
    tracemalloc.start()
    try:
        before, peaks = tracemalloc.get_traced_memory()[0], []
        counts = quality._Counts(rows)
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
        tracemalloc.reset_peak()
        tables = quality._Tables(counts, [], [], dealing, weights)
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
    finally:
        tracemalloc.stop()
    assert max(peaks) < 3 * 24 * many * each and len(tables.tri_log) == len(tables.tri) > many * each / 2


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    frame, key = spark.range(0, 200, 1, 1).select(F.expr("repeat('x', 10000)")), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.small_batches(spark):
        got = [r["n"] for r in frame.mapInArrow(sizes, "n bigint").collect()]
    assert max(got) < 300_000 and sum(got) >= 2_000_000 and spark.conf.get(key) == before


def test_written_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}
    before = shuffled()
    frame = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # they go in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and frame.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_quality_fits_every_trusted_document(spark):
    """The model counts all documents of its half, however many there are."""
    def half(i):
        return xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) % 2
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 4) % 50), "a") for i in range(5000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id bigint, quality int, toxic int")
    train = [t for i, t, _ in rows if not half(i)]
    assert len(train) > 2300
    got = quality.score(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels)
    got = {r["doc_id"]: r["perplexity"] for r in got.where("doc_id < 50").collect()}
    assert np.allclose([got[i] for i in range(50)], brute_kneser_ney(train, [t for _, t, _ in rows[:50]]), rtol=1e-6)


def test_quality_keeps_trusted_and_drops_noise(spark, docs, nothing):
    rng = np.random.default_rng(6)
    good = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 80), "a" if i % 2 else None) for i in range(200)]
    bad = [(1000 + i, " ".join(f"##{x}" for x in rng.integers(0, 1e6, 60)), "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(good + bad + [(5000, None, "a"), (None, good[0][1], "a")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, None if i % 3 else 0) for i, _, _ in good] + [(None, 1, 0), (3, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(df.withColumn("id", F.lit(1)), labels).collect()}
    assert not kept & {i for i, _, _ in bad} and 5000 not in kept
    assert len(kept & {i for i, _, _ in good}) >= 198 and None in kept
    # Without trusted documents nothing is judged; only rows without words go.
    assert quality.keep_good(docs.drop("lang").withColumn("lang", F.lit(None).cast("string")), labels.limit(0)).count() == sum(
        bool(words_7(t)) for _, t in TEXTS)
    assert quality.score(nothing.withColumn("lang", F.lit("a")), labels).count() == 0


# 6


def test_histogram_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(s), int(g)) for i, (s, g) in enumerate(zip(rng.integers(17, 400, 3000), rng.integers(-1 << 62, 1 << 62, 3000)))]
    hot = [(10_000 + i, 100, 42) for i in range(1500)]  # a third of the rows in one group
    same = [(7, 50, 99)] * 5 + [(None, 60, None), (None, None, None)]
    df = spark.createDataFrame(rows + hot + same, "doc_id bigint, size bigint, g bigint").withColumn("_x", F.lit(1)).cache()
    out = sharding.histogram_shards(df, 20, "doc_id", "size", "g", rows_per_range=500).toPandas()
    assert len(out) == len(rows + hot + same) and set(out.columns) == {"doc_id", "size", "g", "_x", "shard", "slot"}
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 20 and sizes.max() < 1.03 * sizes.mean() and sizes.min() > 0.97 * sizes.mean()
    split = out.groupby("g").shard.nunique()
    assert set(split[split > 1].index) == {42}
    assert sharding.histogram_shards(df.limit(0), 20, "doc_id", "size", "g").count() == 0
    few = sharding.histogram_shards(spark.createDataFrame([(1, 5, 5)], "doc_id bigint, size bigint, g bigint"), 4, "doc_id", "size", "g")
    assert few.count() == 1


def test_shards_keep_columns_of_any_name(spark):
    names = ("_group", "_tie", "_size", "_at", "_range", "_first", "_n", "_before")
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(3).alias("size"), F.xxhash64("id").alias("g"),
                                *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names])
    rows = sharding.histogram_shards(df, 4, "doc_id", "size", "g").collect()
    assert len(rows) == 50 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    for taken in ("shard", "SLOT"):
        with pytest.raises(ValueError, match=taken.lower()):
            sharding.histogram_shards(df.withColumn(taken, F.lit(1)), 4, "doc_id", "size", "g")


# 7


def brute_simhash(text):
    w = words_7(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, radius=3):
    label = list(range(len(ids)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                label[find(a)] = find(b)
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in m if ids[k] is not None), default=None) for m in members.values() for i in m}


def test_simhash_classes(docs, nothing):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [brute_simhash(t) for _, t in TEXTS]
    classes = brute_classes([i for i, _ in TEXTS], prints)
    assert got == Counter((TEXTS[k][0], prints[k], classes[k]) for k in range(len(TEXTS)))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 5, 7, 8, 9]
    assert kept.where("doc_id IS NULL").count() == 2 and kept.columns == docs.columns


@pytest.mark.parametrize("limit", [simhash.SHARD_LIMIT, 20])
def test_links_of_clusters(spark, limit):
    """Chains and balls of near fingerprints, also when shards are cut again."""
    rng = np.random.default_rng(9)
    values = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for seed in values[:6]:
        near = seed
        for _ in range(40):
            near ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5)))
            values.append(near)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, shard_limit=limit)).collect()}
    want = brute_classes(signed, values)
    assert {v: label.get(v, v) for v in signed} == {signed[k]: c for k, c in want.items()}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    far = spark.createDataFrame([(1000, 2000), (1000, 3000), (5, 5)], "a bigint, b bigint")
    label = {r["node"]: r["label"] for r in simhash.components(chain.unionByName(far)).collect()}
    assert set(label) == {*range(301), 1000, 2000, 3000}
    assert {label[i] for i in range(301)} == {0} and label[3000] == 1000


# 8


def test_bpe_round_trip(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: r for r, t in enumerate(bpe.read_ranks(path))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["text"]), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0
    encoder = bpe.Encoder(bpe.model_proto(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    for text in ("▁ <unk></s>", " " * 3000, "a" * 4000, "\x00\x01", "🙂🙃" * 40, "don't  stop\n\n now"):
        assert encoder.ids(text) == reference.encode_ordinary(text)


# 9


def brute_windows(docs, items, size=10):
    def words(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[k:k + size]), set()).add(str(item))
    out = Counter()
    for i, t in docs:
        w, hits, names = words(t), set(), set()
        for window, owners in windows.items():
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) == window:
                    hits |= set(range(k, k + n))
                    names |= {o for o in owners if o != "None"}
        out[i, len(w), tuple(sorted(hits)), tuple(sorted(names))] += 1
    return out


def test_windows(spark, docs, nothing):
    items = [(1, "zeta eta theta iota kappa lambda mu nu xi OMICRON pi rho"), (2, "ONE"), (12, "gamma delta"), (3, None), (4, "!!"),
             (5, "epsilon zeta eta"), (6, "ÉCOLE École"), (6, "ÉCOLE École"), (7, "école"), (8, " ".join(LONG.split()[500:520]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("win", F.lit(0))
    got = Counter((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in decontaminate.scan(docs, bench).collect())
    assert got == brute_windows(TEXTS, items)
    assert decontaminate.scan(nothing, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = Counter()
    for (i, _, hits, _), n in brute_windows(TEXTS, items).items():
        clean[i] += n * (not hits)
    assert Counter(r["doc_id"] for r in kept.collect()) == +clean


# 10


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1>"
     "<p><b>First,\n part.<br>more</b><p>Second &lt;part&gt;.</article><div class='ad'>Buy now, cheap.</div><footer>&copy; me</footer>",
     "A & B First, part. more Second <part>."),
    (None, ""), ("", ""), ("<p", ""), ("just text", "just text"), ("<script>var a='<p>no</p>'</script>", ""),
    ("<body><header>Site name</header><div id='menu'><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div>"
     "<div class='post'><p>A sentence, with marks; and some more of it. It goes on.</p><p>Short.</p></div>"
     "<aside>Other posts</aside><form><label>Mail</label><input></form><div class='comments'><p>I agree, fully.</p></div>",
     "A sentence, with marks; and some more of it. It goes on. Short."),
    ("<article><p>" + "long text, " * 5000 + "</p></article>", ("long text, " * 5000).strip()),
]


def test_main_text(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0]), (0, "u0", PAGES[0][0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = Counter(tuple(r) for r in html_text.extract(df).collect())
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)]
    assert got == Counter(want + [(None, None, PAGES[0][1], len(PAGES[0][1])), want[0]])
    assert html_text.extract(df.limit(0)).count() == 0
    assert html.unescape("&amp") == html_text.main_text("<article>&amp</article>")
