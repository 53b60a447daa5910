"""A gated recurrent language model with a class-factored softmax.

``Spec`` fixes the sizes and the partition of tokens into classes, ``Gru`` holds
the weights and does the numpy arithmetic; ``lm_score`` spreads both over Spark.

Tokens 0 .. words - 1 are the most frequent words, then come ``buckets`` tokens
that each stand for a set of rarer words, and last the end mark.  Frequent words
are cut into classes of about equal square-root mass, buckets into classes of
``BUCKETS_PER_CLASS``; the end mark is a class of its own.  P(token) = P(class | state) P(token | class,
state), and a rarer word takes its share of its bucket from counts.

Documents lie end to end in ``lanes``.  The state is carried from window to
window and reset after an end mark, so that a document of any length is scored
as one sequence.  Training goes through all windows in the same way, and
back-propagates (truncated to the window) in each of them.  A window holds about
the same number of tokens whether many lanes are live or only that of one long
document, and lanes are cut window by window, so that memory follows the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

F4 = np.float32
BUCKETS_PER_CLASS = 8
LONG = 16


@dataclass(frozen=True)
class Spec:
    words: int
    buckets: int
    hidden: int
    starts: tuple[int, ...]  # first word of each word class, and ``words`` at the end

    @property
    def tokens(self) -> int:
        return self.words + self.buckets + 1

    @property
    def end(self) -> int:
        return self.tokens - 1

    @property
    def bounds(self) -> tuple[int, ...]:
        """First token of each class, and ``tokens`` at the end."""
        groups = range(self.words, self.end, BUCKETS_PER_CLASS)
        return tuple(dict.fromkeys((*self.starts[:-1], *groups, self.end, self.tokens)))

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1

    def class_of(self) -> np.ndarray:
        return np.searchsorted(np.array(self.bounds[1:]), np.arange(self.tokens), side="right").astype(np.uint16)


def word_classes(counts: np.ndarray, classes: int) -> tuple[int, ...]:
    """Bounds that give every class about the same sum of square roots of counts."""
    mass = np.cumsum(np.sqrt(counts.astype(float)))
    if not len(mass):
        return (0,)
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return tuple(int(x) for x in np.unique(np.r_[0, np.minimum(cuts, len(counts)), len(counts)]))


def _with_bias(out: np.ndarray, bias: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of ``out`` with ``bias`` as one more column.  Each group of rows (from
    its start on) is lowered so that no score can overflow: states lie between
    -1 and 1, so a score is at most its bias and the sum of its weights."""
    both = np.empty((len(out), out.shape[1] + 1), F4)
    both[:, :-1] = out
    most = np.maximum.reduceat(np.abs(out).sum(axis=1) + bias, starts)
    both[:, -1] = bias - np.repeat(np.maximum(most - F4(60.0), F4(0.0)), np.diff(np.r_[starts, len(out)]))
    return both


class Gru:
    """Weights: ``inp`` (a vector per token for the three gates), ``rec``,
    ``out_c``/``bias_c`` (classes), ``out_w``/``bias_w`` (tokens within classes)."""

    NAMES = ("inp", "rec", "out_c", "bias_c", "out_w", "bias_w")

    def __init__(self, spec: Spec, weights: dict[str, np.ndarray]):
        self.spec = spec
        self.w = weights
        self.class_of = spec.class_of()

    @classmethod
    def shapes(cls, spec: Spec) -> list[tuple[int, ...]]:
        h = spec.hidden
        return [(spec.tokens, 3 * h), (h, 3 * h), (h, spec.classes), (spec.classes,), (spec.tokens, h), (spec.tokens,)]

    @classmethod
    def start(cls, spec: Spec, counts: np.ndarray, seed: int = 0) -> Gru:
        """Small random weights; the biases reproduce the token frequencies."""
        rng = np.random.default_rng(seed)
        shapes = cls.shapes(spec)
        w = {n: np.zeros(s, F4) for n, s in zip(cls.NAMES, shapes)}
        w["inp"][:] = rng.normal(0, 0.3, shapes[0])
        w["inp"][:, :spec.hidden] += 0.5  # open update gates: quick to take in the first words
        w["rec"][:] = rng.normal(0, 0.5 / np.sqrt(spec.hidden), shapes[1])
        w["out_c"][:] = rng.normal(0, 0.05, shapes[2])
        w["out_w"][:] = rng.normal(0, 0.05, shapes[4])
        smooth = counts.astype(float) + 0.1
        mass = np.bincount(spec.class_of(), weights=smooth, minlength=spec.classes)
        w["bias_c"][:] = np.log(mass / mass.sum())
        w["bias_w"][:] = np.log(smooth)
        return cls(spec, w)

    # Weights as one vector, for averaging.

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.NAMES])

    @classmethod
    def from_flat(cls, spec: Spec, vector: np.ndarray) -> Gru:
        w, at = {}, 0
        for name, shape in zip(cls.NAMES, cls.shapes(spec)):
            size = int(np.prod(shape))
            w[name] = vector[at:at + size].reshape(shape).astype(F4)
            at += size
        return cls(spec, w)

    # One window.

    def states(self, x: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """States after each step of a window of input tokens ``x`` (steps, lanes)."""
        n, end, rec = self.spec.hidden, self.spec.end, self.w["rec"]
        steps, lanes = x.shape
        gate = self.w["inp"][x.ravel()].reshape(steps, lanes, 3 * n)
        fresh = (x != end).astype(F4)[:, :, None]
        out = np.empty((steps, lanes, n), F4)
        if keep is not None:
            keep.update(before=np.empty_like(out), zr=np.empty((steps, lanes, 2 * n), F4),
                        cand=np.empty_like(out), un=np.empty_like(out), fresh=fresh)
        for t in range(steps):
            h = h * fresh[t]
            u = h @ rec
            zr = gate[t, :, :2 * n] + u[:, :2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            cand = np.tanh(gate[t, :, 2 * n:] + zr[:, n:] * u[:, 2 * n:])
            if keep is not None:
                keep["before"][t], keep["zr"][t], keep["cand"][t], keep["un"][t] = h, zr, cand, u[:, 2 * n:]
            h = h + zr[:, :n] * (cand - h)
            out[t] = h
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of tokens ``y`` (n,) in states ``h`` (n, hidden);
        with ``grads``, also adds to them and returns the gradient of the states.

        Rows are put in the order of their class, so that those of a class are a
        slice.  A softmax gradient is (scores - total at the token) / total; the
        division is left to the narrow side of the products."""
        w, spec = self.w, self.spec
        units, bounds = spec.hidden, np.array(spec.bounds)
        order = np.argsort(self.class_of[y], kind="stable")
        y = y[order]
        c = self.class_of[y]
        rows = np.arange(len(y))
        edges = np.searchsorted(c, np.arange(len(bounds)))
        state = np.empty((len(y), units + 1), F4)
        state[:, :units] = h[order]
        state[:, units] = 1
        outer = _with_bias(w["out_c"].T, w["bias_c"], np.zeros(1, np.int64))
        words = _with_bias(w["out_w"], w["bias_w"], bounds[:-1])
        ones = np.ones(max(spec.classes, int(np.diff(bounds).max())), F4)
        score = state @ outer.T
        log_p = score[rows, c]
        np.exp(score, out=score)
        total = score @ ones[:spec.classes]
        log_p -= np.log(total)
        dh = None
        if grads is not None:
            score[rows, c] -= total
            part = 1 / total[:, None]
            g = (state * part).T @ score
            grads["out_c"] += g[:units]
            grads["bias_c"] += g[units]
            dh = score @ outer[:, :units]
            dh *= part
        for k, (a, b) in enumerate(zip(spec.bounds, spec.bounds[1:])):
            i, j = edges[k], edges[k + 1]
            if b - a < 2 or i == j:
                continue
            inner = state[i:j] @ words[a:b].T
            own, at = rows[:j - i], y[i:j] - a
            top = inner[own, at]
            np.exp(inner, out=inner)
            sums = inner @ ones[:b - a]
            log_p[i:j] += top - np.log(sums)
            if grads is not None:
                inner[own, at] -= sums
                part = 1 / sums[:, None]
                g = inner.T @ (state[i:j] * part)
                grads["out_w"][a:b] += g[:, :units]
                grads["bias_w"][a:b] += g[:, units]
                dh[i:j] += (inner @ words[a:b, :units]) * part
        back = np.empty_like(log_p)
        back[order] = log_p
        if dh is None:
            return back, None
        dh_back = np.empty_like(dh)
        dh_back[order] = dh
        return back, dh_back

    def backward(self, x: np.ndarray, keep: dict, dh_out: np.ndarray, grads: dict) -> None:
        """Back-propagation through the steps of one window."""
        n, rec = self.spec.hidden, self.w["rec"]
        steps, lanes = x.shape
        zr, cand, before = keep["zr"], keep["cand"], keep["before"]
        z, r = zr[:, :, :n], zr[:, :, n:]
        rest = 1 - z
        to_cand = z * (1 - cand * cand)
        to_gates = np.concatenate([(cand - before) * z * rest, to_cand * keep["un"] * r * (1 - r), to_cand * r], axis=2)
        d_rec = np.empty((steps, lanes, 3, n), F4)   # of what the state adds to the gates
        by_gate = to_gates.reshape(steps, lanes, 3, n)
        kept = np.empty((steps, lanes, n), F4)
        dh = np.zeros((lanes, n), F4)
        for t in reversed(range(steps)):
            dh += dh_out[t]
            kept[t] = dh
            np.multiply(dh[:, None, :], by_gate[t], out=d_rec[t])
            dh *= rest[t]
            dh += d_rec[t].reshape(lanes, 3 * n) @ rec.T
            dh *= keep["fresh"][t]
        d_rec = d_rec.reshape(steps * lanes, 3 * n)
        grads["rec"] += before.reshape(-1, n).T @ d_rec
        d_gate = d_rec
        d_gate[:, 2 * n:] = (kept * to_cand).reshape(-1, n)
        token = x.ravel().astype(np.uint16)  # a radix sort
        order = np.argsort(token, kind="stable")
        token = token[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        grads["rows"] = token[first]
        grads["inp"] = np.add.reduceat(d_gate[order], first)

    def zero(self) -> dict[str, np.ndarray]:
        """Empty gradients; ``backward`` gives those of ``inp`` for the ``rows`` it met."""
        return {n: np.zeros_like(v) for n, v in self.w.items() if n != "inp"}


def lay_out(docs: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Documents of each lane, longest first onto the shortest lane; lanes are
    returned longest first."""
    import heapq
    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, i) for i in range(lanes)]
    rows: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, lane = heapq.heappop(heap)
        rows[lane].append(d)
        heapq.heappush(heap, (size + len(docs[d]), lane))
    return [rows[lane] for _, lane in sorted(heap, reverse=True)]


def windows(docs: list[np.ndarray], end: int, lanes: int, steps: int) -> Iterator[tuple]:
    """First the documents in the order of the lanes and their tokens as one
    array; then of each window the inputs, the targets, where a lane still has
    tokens, all (steps, live lanes), and the places of the targets in the array.
    Where many lanes have run out, windows get longer, up to ``LONG`` times."""
    rows = lay_out(docs, lanes)
    order = [d for row in rows for d in row]
    flat = np.concatenate([docs[d] for d in order])
    size = np.array([sum(len(docs[d]) for d in row) for row in rows])
    first = np.cumsum(size) - size
    yield order, flat
    at = 0
    while at < size[0]:
        live = int((size > at).sum())
        span = steps
        while span < LONG * steps and 2 * span * live <= len(rows) * steps:
            span *= 2
        t = np.arange(at, min(at + span, int(size[0])))[:, None]
        place = first[:live] + np.minimum(t, size[:live] - 1)
        yield np.where(t > 0, flat[np.maximum(place - 1, 0)], end), flat[place], t < size[:live], place
        at += span


def score(model: Gru, docs: list[np.ndarray], lanes: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each document, a token array with its end mark."""
    if not docs:
        return np.empty(0)
    plan = windows(docs, model.spec.end, lanes, steps)
    order, flat = next(plan)
    log_p = np.empty(len(flat), np.float64)
    h = np.zeros((min(lanes, len(docs)), model.spec.hidden), F4)
    for x, y, there, place in plan:
        states = model.states(x, h[:x.shape[1]])
        h = states[-1]
        log_p[place[there]] = model.log_probs(states[there], y[there])[0]
    sizes = np.array([len(docs[d]) for d in order])
    out = np.empty(len(docs))
    out[order] = np.add.reduceat(log_p, np.cumsum(sizes) - sizes)
    return out


def train(model: Gru, docs: list[np.ndarray], memory: dict, rate: float, lanes: int = 384, steps: int = 16,
          clip: float = 5.0) -> int:
    """One pass over ``docs``; ``memory`` holds the squared gradients of the
    step-size rule.  Returns the number of tokens that gave gradients."""
    if not docs:
        return 0
    plan = windows(docs, model.spec.end, lanes, steps)
    next(plan)
    h = np.zeros((min(lanes, len(docs)), model.spec.hidden), F4)
    trained = 0
    for x, y, there, _ in plan:
        keep: dict = {}
        grads = model.zero()
        states = model.states(x, h[:x.shape[1]], keep)
        h = states[-1]
        _, d = model.log_probs(states[there], y[there], grads)
        dh = np.zeros_like(states)
        dh[there] = d
        model.backward(x, keep, dh, grads)
        n = int(there.sum())
        trained += n
        rows = grads.pop("rows")
        for name, g in grads.items():
            g *= 1.0 / n
            if name == "rec":
                g *= min(1.0, clip / (float(np.sqrt((g * g).sum())) + 1e-12))
            at = rows if name == "inp" else slice(None)
            seen = memory[name][at] + g * g
            memory[name][at] = seen
            model.w[name][at] -= rate * g / (np.sqrt(seen) + 1e-6)
    return trained
