"""Conversations without usable turn numbers are cut by position."""

import random

import pytest

from tablegov.llm import perspectives

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows, size):
    """Every part of every chunk from every speaker, with lists."""
    groups, speakers = {}, {}
    for conv, turn, role, text in rows:
        turn, who = -1 if turn is None else turn, "unknown" if role is None else role
        groups.setdefault((conv, max(turn // size, 0)), []).append((turn, text or "", who))
        speakers.setdefault(conv, set()).add(who)
    out = {}
    for (conv, chunk), turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        for part in range(-(-len(turns) // size)):
            for speaker in speakers[conv] - {"system"}:
                text, spans = "", []
                for _, said, who in turns[part * size:(part + 1) * size]:
                    text += "<|im_start|>" + ("system" if who == "system" else "assistant" if who == speaker
                                              else "user name=" + who) + "\n"
                    if who == speaker:
                        spans.append((len(text), len(text) + len(said + "<|im_end|>\n")))
                    text += said + "<|im_end|>\n"
                out[conv, speaker, chunk, part] = text, spans
    return out


@pytest.mark.parametrize("small_rows", [None, 5])
def test_parts_equal_lists(spark, small_rows):
    """Null, negative, repeated and regular numbers, null ids, equal rows in
    great numbers; with one task a conversation and with ranges."""
    rng = random.Random(3)
    rows = [(None, None, rng.choice(["ann", "bob", None, "system"]), rng.choice("xyz") * rng.randrange(5)) for _ in range(300)]
    rows += [(1, None, "ann", "same")] * 70 + [(1, None, "bob", "same")] * 3
    rows += [(2, rng.choice([-3, -1, 0, 0, 1]), rng.choice(["ann", "bob"]), rng.choice(["a", "\u00e9", "\U0001f600", None, "p" * 300, "p" * 299 + "q"]))
             for _ in range(200)]
    rows += [(3, i, ("ann", "bob")[i % 2], f"turn {i}") for i in range(40)]
    rows += [(4, 0, "system", "only")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = perspectives.rotate(df, chunk_turns=16, small_rows=small_rows).collect()
    want = brute(rows, 16)
    assert len(got) == len(want)
    for r in got:
        text, spans = want[r["conv_id"], r["speaker"], r["chunk"], r["part"]]
        assert r["text"] == text and [tuple(s) for s in r["spans"]] == spans
        assert r["n_turns"] <= 16 and r["n_trained"] == sum(b - a for a, b in spans)


def test_regular_numbers_have_one_part(spark):
    df = spark.createDataFrame([(1, i, "ann", "x") for i in range(600)], SCHEMA)
    got = sorted((r["chunk"], r["part"], r["n_turns"]) for r in perspectives.rotate(df).collect())
    assert got == [(0, 0, 256), (1, 0, 256), (2, 0, 88)]
