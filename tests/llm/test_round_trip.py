"""Ids and decoded bytes from one pass equal those of two."""

import public_tokenizers

from tablegov.llm import bpe


def test_one_pass_equals_two(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, "Hello  world\n", "a"), (2, None, None), (3, "", "b"), (4, "naïve \U0001f600 你好 1234567", "c"), (4, "x" * 5_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    for some in (docs, docs.limit(0)):
        one = bpe.encode(some, path, public_tokenizers.PATTERN, keep=["text"], with_decoded=True)
        two = bpe.decode(bpe.encode(some, path, public_tokenizers.PATTERN, keep=["text"]), path)
        assert one.schema == two.schema
        got = sorted(one.collect(), key=str)
        assert got == sorted(two.collect(), key=str)
        assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)
