"""Every token of the training documents gives a gradient."""

import numpy as np

from tablegov.llm import gru_lm, lm_score


def spec_and_docs():
    rng = np.random.default_rng(2)
    return gru_lm.Spec(6, 2, 4, (0, 2, 6)), [np.array([*rng.integers(0, 8, n), 8], np.int32) for n in (0, 3, 15, 16, 50, 100, 300)]


def test_all_tokens_train():
    spec, docs = spec_and_docs()
    for some in (docs, docs[:1], docs[4:6]):
        model = gru_lm.Gru.start(spec, np.arange(9, 0, -1))
        memory = {k: np.full_like(v, 1e-8) for k, v in model.w.items()}
        assert gru_lm.train(model, some, memory, 0.1) == sum(map(len, some))


def test_later_windows_of_a_short_document_train(spark):
    """The weights after a round depend on what stands in any window."""
    spec, docs = spec_and_docs()
    start = gru_lm.Gru.start(spec, np.arange(9, 0, -1)).flat()
    got = []
    for at in (None, 5, 40, 70, 98):
        doc = docs[5].astype("<u2")
        if at is not None:
            doc[at] = (doc[at] + 1) % 8
        frame = spark.createDataFrame([(bytearray(doc.tobytes()),)], "ids binary")
        got.append(lm_score.train_round(frame, spec, start, 0.1))
    assert all(np.abs(got[0] - other).max() > 1e-4 for other in got[1:])


def test_score_equals_scalar_steps():
    """Log-likelihoods against the formulas, one document, step and unit at a time."""
    spec, docs = spec_and_docs()
    model = gru_lm.Gru.start(spec, np.arange(9, 0, -1), seed=5)
    model.w["rec"] *= 3
    w, n = {k: v.astype(float).tolist() for k, v in model.w.items()}, spec.hidden
    bounds = spec.bounds

    def step(token, h):
        if token == spec.end:
            h = [0.0] * n
        gate = w["inp"][token]
        u = [sum(h[i] * w["rec"][i][j] for i in range(n)) for j in range(3 * n)]
        z, r = ([1 / (1 + np.exp(-(gate[o + j] + u[o + j]))) for j in range(n)] for o in (0, n))
        cand = [np.tanh(gate[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
        return [h[j] + z[j] * (cand[j] - h[j]) for j in range(n)]

    def log_p(token, h):
        c = next(k for k in range(spec.classes) if bounds[k] <= token < bounds[k + 1])
        outer = [sum(h[i] * w["out_c"][i][k] for i in range(n)) + w["bias_c"][k] for k in range(spec.classes)]
        inner = {t: sum(h[i] * w["out_w"][t][i] for i in range(n)) + w["bias_w"][t] for t in range(bounds[c], bounds[c + 1])}
        return outer[c] - np.log(sum(map(np.exp, outer))) + inner[token] - np.log(sum(map(np.exp, inner.values())))

    for doc, got in zip(docs, gru_lm.score(model, docs, lanes=3, steps=16)):
        h, before, total = [0.0] * n, spec.end, 0.0
        for token in doc.tolist():
            h = step(before, h)
            total += log_p(token, h)
            before = token
        assert abs(total - got) < 1e-4 * max(1, abs(total))


def test_classes_cover_all_tokens():
    spec = gru_lm.Spec(100, 20, 4, gru_lm.word_classes(np.arange(100, 0, -1), 5))
    assert spec.bounds[0] == 0 and spec.bounds[-2:] == (120, 121) and {100, 108, 116} <= set(spec.bounds)
    c = spec.class_of()
    assert (np.diff(c) >= 0).all() and c[-1] == spec.classes - 1 and len(set(c)) == spec.classes
    empty = gru_lm.Spec(0, 3, 4, (0,))
    assert empty.bounds == (0, 3, 4) and empty.class_of().tolist() == [0, 0, 0, 1]


def test_windows_hold_every_token_once():
    """Also beside a text much longer than the others, whose windows grow."""
    rng = np.random.default_rng(4)
    docs = [np.array([*rng.integers(0, 8, n), 8], np.int32) for n in (0, 5, 3_000, 40, 40, 41, 7, 0)]
    for lanes, steps in ((1, 4), (3, 4), (8, 16), (50, 8)):
        plan = gru_lm.windows(docs, 8, lanes, steps)
        order, flat = next(plan)
        assert sorted(order) == list(range(len(docs))) and (flat == np.concatenate([docs[d] for d in order])).all()
        seen, longest, full = np.zeros(len(flat), int), 0, min(lanes, len(docs)) * steps
        for x, y, there, place in plan:
            np.add.at(seen, place[there], 1)
            assert (y[there] == flat[place[there]]).all()
            at = place[there]
            starts = x[there] == 8
            assert (x[there][~starts] == flat[at[~starts] - 1]).all()
            assert ((at[starts] == 0) | (flat[at[starts] - 1] == 8)).all()
            assert x.size <= full
            longest = max(longest, len(x))
        assert (seen == 1).all() and longest <= gru_lm.LONG * steps
        assert lanes == 1 or longest > steps


def test_a_long_text_beside_many_short_ones_takes_memory_by_tokens():
    import tracemalloc
    docs = [np.zeros(300_000, np.int32)] + [np.zeros(2, np.int32)] * 400
    tracemalloc.start()
    for _ in gru_lm.windows(docs, 8, 384, 16):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, docs))  # a frame of lanes and steps would take 384 x 4 bytes a token
