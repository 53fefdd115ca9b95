"""A small causal self-attention model over subword ids, in numpy.

One layer: an id's embedding and its place in the context window give query, key and value; what a place attends to is
added to its embedding. From that a first softmax gives the group of the next id, a second one, of that group, its class
there. The probability of an id is that of its class times its share of the class, taken from the counts of all training
texts. Each of the most frequent ids is a class of its own, the others fall into classes of about equal frequency, so
every id has a probability and they sum to one.

A text is read as END, its ids, END. Windows of CONTEXT places start every STRIDE places; each predicts what follows
its places, but only those that no earlier window predicted count, so each id is scored once, with at least
CONTEXT - STRIDE places before it (or all there are).

``train`` makes start values from a few texts. A ``Learner`` goes on from given weights over any stream of texts, long
ones included, and reads each id once; ``merged`` puts the weights of many learners together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

VOCABULARY, END = 50_257, 50_256
CONTEXT, STRIDE, WIDTH, GROUPS, IN_GROUP, SINGLE = 32, 26, 32, 32, 32, 960
BATCH, STEPS, RATE = 256, 800, 5e-3
#: Rate of the learners that go on from the start values, and the steps over which it rises.
LEARNER_RATE, LEARNER_WARM = 2e-3, 20
SMOOTHING = 0.5


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id, and log10 of every id's share of its class."""
    total = GROUPS * IN_GROUP
    smooth = counts + SMOOTHING
    order = np.argsort(-smooth, kind="stable")
    group = np.empty(len(counts), np.int64)
    group[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    mass = np.cumsum(smooth[rest])
    group[rest] = SINGLE + np.minimum((mass / mass[-1] * (total - SINGLE)).astype(int), total - SINGLE - 1)
    return group, np.log10(smooth / np.bincount(group, smooth, minlength=total)[group])


#: exp by the bits of a float32: the number of this slope and offset, read as bits, is near exp(x) and grows with x, so
#: shares of sums of such values are probabilities as those of exp are. Beyond LOW..HIGH it is held.
_SLOPE, _OFFSET, _LOW, _HIGH = np.float32(12102203.16), np.float32(1064866805), np.float32(1e7), np.float32(2.1e9)


def _from_bits(y: np.ndarray) -> np.ndarray:
    np.clip(y, _LOW, _HIGH, out=y)
    return y.astype(np.int32).view(np.float32)


@dataclass
class Model:
    embed: np.ndarray
    place: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    read: np.ndarray
    bias: np.ndarray
    group: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    share: np.ndarray = field(default_factory=lambda: np.empty(0))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.qkv, self.out, self.top, self.top_bias, self.read, self.bias]


def fresh(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    d = WIDTH
    return Model(f(VOCABULARY, d), f(CONTEXT, d), f(d, 3 * d, scale=d ** -0.5), f(d, d, scale=d ** -0.5), f(d, GROUPS),
                 np.zeros(GROUPS, np.float32), f(GROUPS, d, IN_GROUP), np.zeros((GROUPS, IN_GROUP), np.float32))


def by_group(group: np.ndarray):
    """Rows of each group that has some, group by group."""
    order = np.argsort(group.astype(np.uint8), kind="stable")  # small integers are sorted by their digits
    edge = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))])
    for g in range(GROUPS):
        if edge[g + 1] > edge[g]:
            yield g, order[edge[g]:edge[g + 1]]


def windows(ids: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text's ids (without END): context places, what follows each, and which of these count (n x CONTEXT)."""
    stream = np.concatenate([[END], ids, [END]]).astype(np.int64)
    n = len(stream) - 1
    starts = np.arange(0, max(n - CONTEXT, 0) + stride, stride) if n > CONTEXT else np.zeros(1, np.int64)
    at = starts[:, None] + np.arange(CONTEXT)
    ok = at < n
    counts = ok & ((np.arange(CONTEXT) >= CONTEXT - stride) | (starts[:, None] == 0))
    at = np.minimum(at, n - 1)
    return stream[at], stream[at + 1], counts


_SEEN = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
#: Values up to this size need no shift before exp.
_PLAIN = 60.0


def _softmax(z: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Softmax of the last axis, in the place of ``z``; of the places in ``seen`` alone if given."""
    if not (z.max(initial=0) < _PLAIN and z.min(initial=0) > -_PLAIN):
        if seen is not None:
            z += (seen - 1) * np.float32(1e4)
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    if seen is not None:
        z *= seen
    z /= z @ np.ones((z.shape[-1], 1), np.float32)
    return z


def gradients(m: Model, ids: np.ndarray, counted: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids used, and the gradient of each parameter (of the embeddings: the rows of those ids); ``target``: the classes."""
    d = WIDTH
    weight = (counted.reshape(-1, 1) / max(counted.sum(), 1)).astype(np.float32)
    scale = np.concatenate([np.full(d, d ** -0.5, np.float32), np.ones(2 * d, np.float32)])  # of the queries, kept in their weights
    qkv = m.qkv * scale
    x = m.embed[ids]
    x += m.place
    q, k, v = np.split((x.reshape(-1, d) @ qkv).reshape(len(x), CONTEXT, 3 * d), 3, axis=2)
    p = _softmax(np.matmul(q, k.transpose(0, 2, 1)), _SEEN)
    a = np.matmul(p, v)
    h = a.reshape(-1, d) @ m.out
    h += x.reshape(-1, d)
    # Places of one group of the next id side by side, from here to the gradient of the states.
    of_group = target // IN_GROUP
    order = np.argsort(of_group.astype(np.uint8), kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(of_group, minlength=GROUPS))]).tolist()
    h, goal, weight, place = h[order], (target % IN_GROUP)[order], weight[order], np.arange(len(h))
    g = _softmax(h @ m.top + m.top_bias)
    g[place, of_group[order]] -= 1
    g *= weight
    g_top, g_top_bias, g_sorted = h.T @ g, g.sum(0), g @ m.top.T
    g_read, g_bias = np.zeros_like(m.read), np.zeros_like(m.bias)
    for group in range(GROUPS):
        rows = slice(edge[group], edge[group + 1])
        if rows.start < rows.stop:
            e = h[rows] @ m.read[group]
            e += m.bias[group]
            e = _softmax(e)
            e[place[:len(e)], goal[rows]] -= 1
            e *= weight[rows]
            g_read[group], g_bias[group] = h[rows].T @ e, e.sum(0)
            g_sorted[rows] += e @ m.read[group].T
    g_h = np.empty_like(g_sorted)
    g_h[order] = g_sorted
    g_out = a.reshape(-1, d).T @ g_h
    g_a = (g_h @ m.out.T).reshape(x.shape)
    g_all = np.empty((len(x), CONTEXT, 3 * d), np.float32)
    np.matmul(p.transpose(0, 2, 1), g_a, out=g_all[:, :, 2 * d:])
    g_s = np.matmul(g_a, v.transpose(0, 2, 1))
    g_s -= np.einsum("ijk,ijk->ij", g_a, a)[:, :, None]  # the mean of g_s by p, as a is that of v
    g_s *= p
    np.matmul(g_s, k, out=g_all[:, :, :d])
    np.matmul(g_s.transpose(0, 2, 1), q, out=g_all[:, :, d:2 * d])
    g_all = g_all.reshape(-1, 3 * d)
    g_qkv = (x.reshape(-1, d).T @ g_all) * scale
    g_x = g_all @ qkv.T
    g_x += g_h
    flat = ids.reshape(-1)
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    flat = flat[order]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    g_embed = np.add.reduceat(g_x[order], edge, axis=0)
    return flat[edge], [g_embed, g_x.reshape(x.shape).sum(0), g_qkv, g_out, g_top, g_top_bias, g_read, g_bias]


class _Adam:
    def __init__(self, params: list[np.ndarray]):
        self.params, self.step = params, 0
        self.moment, self.square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def move(self, used: np.ndarray, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for i, (param, moment, square, grad) in enumerate(zip(self.params, self.moment, self.square, grads, strict=True)):
            where = used if i == 0 else slice(None)  # of the embeddings those that were used
            m, s = 0.9 * moment[where] + 0.1 * grad, 0.99 * square[where] + 0.01 * grad * grad
            moment[where], square[where] = m, s
            param[where] -= (rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(s / (1 - 0.99 ** self.step)) + 1e-8)).astype(np.float32)


def train(samples: list[np.ndarray], counts: np.ndarray, steps: int | None = None, seed: int = 11) -> Model:
    """Adam on random batches of windows of the samples (ids of texts); classes and shares come from ``counts``."""
    m, steps = fresh(seed), steps or STEPS
    m.group, m.share = classes(counts)
    mass = np.bincount(m.group, counts + SMOOTHING, minlength=GROUPS * IN_GROUP).reshape(GROUPS, IN_GROUP) + 1e-9
    m.top_bias[:] = np.log(mass.sum(1) / mass.sum())
    m.bias[:] = np.log(mass / mass.sum(1, keepdims=True))
    made = [windows(s) for s in samples]
    if not made:
        return m
    seen, nxt, use = (np.concatenate(part) for part in zip(*made, strict=True))
    goal = m.group[nxt]
    adam, rng = _Adam(m.parameters()), np.random.default_rng(seed + 1)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(seen), min(BATCH, len(seen)))
        rate = RATE * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        adam.move(*gradients(m, seen[pick], use[pick], goal[pick].reshape(-1)), rate)
    return m


def in_rows(m: Model) -> np.ndarray:
    """All weights as rows of WIDTH, the embeddings first."""
    return np.vstack([p.reshape(-1, WIDTH) for p in m.parameters()])


def from_rows(m: Model, rows: np.ndarray) -> Model:
    """``m`` with the weights of ``rows``."""
    flat, at, params = rows.astype(np.float32).reshape(-1), 0, []
    for p in m.parameters():
        params.append(flat[at:at + p.size].reshape(p.shape).copy())
        at += p.size
    return Model(*params, m.group, m.share)


class Learner:
    """Goes on from a model's weights, one step for BATCH windows, each window once; the model is left as it is."""

    def __init__(self, m: Model, seed: int = 11):
        self.start = in_rows(m)
        self.m = from_rows(m, self.start)
        self.adam, self.rng = _Adam(self.m.parameters()), np.random.default_rng(seed)
        #: How many places each row of weights served.
        self.uses = np.zeros(len(self.start))
        self.left: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def read(self, texts: list[np.ndarray]) -> None:
        """Windows of CONTEXT places side by side; what does not fill a step waits for more."""
        for ids in texts:
            self.left.append(windows(ids, CONTEXT))
            self.waiting += len(self.left[-1][0])
        if self.waiting >= 8 * BATCH:
            self._steps(self.waiting // BATCH * BATCH)

    def _steps(self, take: int) -> None:
        seen, nxt, use = (np.concatenate(part) for part in zip(*self.left, strict=True))
        order = self.rng.permutation(len(seen))
        for at in range(0, take, BATCH):
            pick = order[at:min(at + BATCH, take)]
            used, grads = gradients(self.m, seen[pick], use[pick], self.m.group[nxt[pick]].reshape(-1))
            self.adam.move(used, grads, LEARNER_RATE * min(1.0, (self.adam.step + 1) / LEARNER_WARM))
            self.uses[:VOCABULARY] += np.bincount(seen[pick][use[pick]], minlength=VOCABULARY)
            self.uses[VOCABULARY:] += use[pick].sum()
        rest = order[take:]
        self.left, self.waiting = [(seen[rest], nxt[rest], use[rest])], len(rest)

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """How far each row of weights moved, times its uses; and the uses."""
        if self.waiting:
            self._steps(self.waiting)
        return (in_rows(self.m) - self.start) * self.uses[:, None], self.uses


def merged(m: Model, moved: np.ndarray, uses: np.ndarray) -> Model:
    """The mean of many learners that began with ``m``, each row weighted by its uses, from the sums of what they moved."""
    return from_rows(m, in_rows(m) + moved / np.maximum(uses, 1)[:, None])


class Scorer:
    """A model made ready for scoring: query, key and value of every id by table, the stand-in for exp in the weights."""

    def __init__(self, m: Model):
        self.m = m
        scale = np.concatenate([np.full(WIDTH, _SLOPE * np.float32(WIDTH ** -0.5), np.float32), np.ones(2 * WIDTH, np.float32)])
        # beside them the embedding itself, so one look-up gives all
        self.by_id = np.hstack([(m.embed @ m.qkv) * scale, m.embed])
        self.by_place = np.hstack([(m.place @ m.qkv) * scale, m.place])
        self.top = self._ready(m.top, m.top_bias)
        self.read = [self._ready(m.read[g], m.bias[g]) for g in range(GROUPS)]
        self.of_group, self.in_group = m.group // IN_GROUP, m.group % IN_GROUP

    @staticmethod
    def _ready(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        both = np.vstack([weights, bias]) * _SLOPE
        both[-1] += _OFFSET
        return both.astype(np.float32)

    def states(self, ids: np.ndarray, counted: np.ndarray, batch: int) -> np.ndarray:
        """What the places that count end with after attention, and a column of ones."""
        d, out = WIDTH, np.ones((int(counted.sum()), WIDTH + 1), np.float32)
        done = 0
        for at in range(0, len(ids), batch):
            chosen = np.flatnonzero(counted[at:at + batch])
            x = self.by_id[ids[at:at + batch]]
            x += self.by_place
            weight = np.matmul(x[:, :, :d], x[:, :, d:2 * d].transpose(0, 2, 1))
            weight += _OFFSET
            weight = _from_bits(weight)
            weight *= _SEEN
            a = np.matmul(weight, x[:, :, 2 * d:3 * d]).reshape(-1, d)[chosen]
            a /= weight.sum(2).reshape(-1, 1)[chosen]
            h = out[done:done + len(chosen), :d]
            np.add(a @ self.m.out, x.reshape(-1, 4 * d)[chosen, 3 * d:], out=h)
            done += len(chosen)
        return out

    def log10_probability(self, texts: list[np.ndarray], batch: int = 128, together: int = 2048) -> np.ndarray:
        """log10 probability of each text's ids and its END."""
        made = [windows(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w[0]) for w in made])
        out = np.zeros(len(texts))
        if not made:
            return out
        seen, nxt, use = (np.concatenate(part) for part in zip(*made, strict=True))
        for at in range(0, len(seen), together):
            counted = use[at:at + together]
            goal = nxt[at:at + together][counted]
            h = self.states(seen[at:at + together], counted, batch)
            group = self.of_group[goal]
            e = _from_bits(h @ self.top)
            p = e[np.arange(len(goal)), group] / e.sum(1)
            for g, rows in by_group(group):
                e = _from_bits(h[rows] @ self.read[g])
                p[rows] *= e[np.arange(len(rows)), self.in_group[goal[rows]]] / e.sum(1)
            value = np.log10(p) + self.m.share[goal]
            out += np.bincount(np.repeat(owner[at:at + together], counted.sum(1)), value, minlength=len(texts))
        return out


def log10_probability(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    return Scorer(m).log10_probability(texts)
