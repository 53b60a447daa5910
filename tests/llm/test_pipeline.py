"""The pipeline against a brute-force version, and the driver's entry module
with and without this subpackage."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tablegov.llm import bpe, quality
from tests.llm.test_ops_small import brute_classes, brute_kneser_ney, brute_simhash, brute_windows

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables():
    rng = np.random.default_rng(12)

    def prose(n, words=60):
        return " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % words) + "."

    good = [(i, prose(80), "en" if i % 2 else "de") for i in range(60)]
    noise = [(100 + i, " ".join(f"@{x}@" for x in rng.integers(0, 1e6, 40)), "en") for i in range(6)]
    passage = " ".join(f"w{int(x)}" for x in rng.integers(0, 40, 14))
    leaked = [(200 + i, prose(30) + " " + passage + " " + prose(20), "de") for i in range(3)]
    copies = [(300 + i, good[3][1], "en") for i in range(4)] + [(2000, good[5][1], None)]
    odd = [(400, None, "en"), (401, "", "de"), (402, "w1 w2", None), (402, "w1 w2", None), (None, prose(60), "en")]
    long = [(500, " ".join(prose(50) for _ in range(400)), "de")]
    docs = good + noise + leaked + copies + odd + long
    labels = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in noise] + [(70, 1, 1), (None, 1, 0)]
    items = [(1, passage), (2, None), (3, "never seen in any of the documents at all here")]
    return docs, labels, items


def brute(docs, labels, items):
    def half(i):
        return xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) % 2
    trusted = {i for i, q, t in labels if i is not None and q == 1 and not t}
    train = [t for i, t, _ in docs if i in trusted and not half(i)]
    rated = brute_kneser_ney(train, [t or "" for _, t, _ in docs])
    bounds = {}
    for (i, t, lang), p in zip(docs, rated):
        if i in trusted and half(i):
            for key in (lang, "all"):
                bounds[key] = max(bounds.get(key, 0), p)
    docs = [d for d, p in zip(docs, rated) if quality.words_of((d[1] or "").encode()) and p <= bounds.get(d[2], bounds["all"])]
    classes = brute_classes([i for i, _, _ in docs], [brute_simhash(t) for _, t, _ in docs])
    docs = list(dict.fromkeys(d for k, d in enumerate(docs) if d[0] is not None and d[0] == classes[k])) + [
        d for d in docs if d[0] is None]
    hits = {(i, h) for i, _, h, _ in brute_windows([(i, t) for i, t, _ in docs], items) if h}
    return [d for d in docs if d[0] not in {i for i, _ in hits}]


def test_pipeline(spark, tmp_path):
    docs, labels, items = tables()
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, labels, items)
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in rows) == Counter(want)
    assert len(want) < len(docs) - 10 and all(i in {w[0] for w in want} for i in (500, None, 1))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks={t: r for r, t in enumerate(bpe.read_ranks(path))})
    assert all(r["exact"] and r["ids"] == reference.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                         ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("with_llm", [True, False])
def test_entry_module(tmp_path, with_llm):
    """A copy without the subpackage still registers every other query."""
    copy = tmp_path / "copy"
    leave = [] if with_llm else ["llm", "corpus_pipeline.py"]
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *leave))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    total, ops, pipeline = out.stdout.split()
    assert (int(ops), pipeline) == ((13, "True") if with_llm else (0, "False")) and int(total) > 200
