"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of three letters, each weighted by DECAY to the power of the stretch it takes in
either string, up to SPAN letters: letters put into an insult or left between its letters lower the value, but do not
end it. A unit is a window of WINDOW symbols (letters; any run of other characters is one symbol). Landmarks are words;
the Nyström map turns kernel values against them into features, in which a support vector machine is trained.

Labels come by document. Sentences of clean documents are negative; of a toxic document those are positive that hold
a witness, a word with letter 4-grams that many toxic and hardly any clean documents have. The machine is retrained a
few times, with the worst windows of clean sentences added. A text's margin is that of its best window.

In the kernel's own space the trained machine is one weight per letter triple, so scoring a text is a sum of table
entries over its stretches. Only the labelled sample is bounded: SAMPLE rows per class, ordered by a hash of doc_id,
texts of at most SAMPLE_CHARS characters. All of every text is scored.

Null texts count as empty and are scored like them. Without toxic and clean labelled rows all scores are 0. Rows with
a null doc_id are not held out. Repeated rows are scored each; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as X

SAMPLE, SAMPLE_CHARS = 2500, 20_000
DECAY, SPAN, WINDOW = 0.6, 6, 12
LANDMARKS, TURNS = 300, 5
SUPPORT, LEAST_ODDS = 0.04, 3.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
_BITS, _VOID = 6, 63
_SENTENCE = re.compile(r"[.!?\n]+")


def _symbol_table() -> np.ndarray:
    """Code points to symbols: 0 for what is no letter, 1-26 for a-z, then Latin letters, the others spread over the rest."""
    points = np.arange(0x3000)
    table = np.where([chr(p).isalpha() for p in points], 27 + points % 36, 0)
    table[97:123] = np.arange(1, 27)
    return table.astype(np.uint8)


_SYMBOLS = _symbol_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < len(_SYMBOLS), _SYMBOLS[np.minimum(points, len(_SYMBOLS) - 1)], 27 + points % 36).astype(np.int32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
    return np.concatenate([[0], out[keep], [0]]).astype(np.int32)


def triples(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.float32]]:
    """(d, index of the triple that ends at each position from d on, weight of its stretch)."""
    n = len(x)
    high, mid = x << (2 * _BITS), x << _BITS
    for d in range(2, SPAN):
        for e in range(1, d):
            yield d, high[:n - d] | mid[d - e:n - e] | x[d:], np.float32(DECAY ** (d + 1))


def subsequences(x: np.ndarray) -> dict[int, float]:
    """The kernel's features of one string."""
    out: Counter = Counter()
    for d, index, weight in triples(x):
        for i in index.tolist() if len(x) > d else []:
            out[i] += float(weight)
    return out


def kernel(a: str, b: str) -> float:
    left, right = subsequences(symbols(a)), subsequences(symbols(b))
    return sum(v * right.get(k, 0.0) for k, v in left.items())


@dataclass
class Model:
    index: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    slope: float = 0.0
    offset: float = -np.inf

    def table(self) -> np.ndarray:
        out = np.zeros(1 << (3 * _BITS), np.float32)
        out[self.index] = self.weight
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.offset):
            return np.zeros(len(margin))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def window_values(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Value of the window that ends at each position."""
    gain = np.zeros(len(x), np.float32)
    for d, index, weight in triples(x):
        if len(index):
            gain[d:] += weight * np.take(table, index)
    total = np.concatenate([np.zeros(WINDOW), np.cumsum(gain, dtype=np.float64)])
    # triples that begin before the window count with it when they end in it
    return total[WINDOW:] - total[:-WINDOW]


def laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings one after another, parted so that no window meets two; and where each begins."""
    gap = np.full(WINDOW + SPAN, _VOID, np.int32)
    at = np.cumsum([0] + [len(p) + len(gap) for p in parts])
    return np.concatenate([y for p in parts for y in (p, gap)]) if parts else gap[:0], at[:-1]


def margins(texts: list[str], table: np.ndarray) -> np.ndarray:
    if not texts:
        return np.empty(0)
    x, at = laid_out([symbols(t) for t in texts])
    return np.maximum.reduceat(window_values(x, table), at)


# --- training, on the driver, from the bounded sample ---

def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def _grams(word: str) -> set[str]:
    w = f" {word} "
    return {w[i:i + 4] for i in range(max(1, len(w) - 3))}


def _witnesses(toxic: list[str], clean: list[str]) -> list[tuple[str, str]]:
    """(sentence, word) for the telling words of toxic texts: those with letter 4-grams that a share SUPPORT of toxic
    texts have and hardly a clean one. Texts without such a word (labels can be wrong) give none."""
    counts = []
    for texts in (toxic, clean):
        seen: Counter = Counter()
        for t in texts:
            seen.update({g for w in set(_words(t)) for g in _grams(w)})
        counts.append(seen)
    odds = {g: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((counts[1][g] + 0.5) / (len(clean) + 1))
            for g, n in counts[0].items() if n >= max(3, SUPPORT * len(toxic))}
    telling = {g for g, v in odds.items() if v > LEAST_ODDS}
    return [(s, w) for t in toxic for s in _SENTENCE.split(t) for w in dict.fromkeys(_words(s)) if _grams(w) & telling]


def _landmarks(found: list[tuple[str, str]], clean: list[str], most: int) -> list[str]:
    telling = [w for w, _ in Counter(w for _, w in found).most_common(most // 2)]
    plain = [w for w, _ in Counter(w for t in clean[:500] for w in _words(t) if len(w) > 2).most_common(most - len(telling))]
    return [w for w in dict.fromkeys(telling + plain)]


def _machine(positive: np.ndarray, negative: np.ndarray, cost: float = 1000.0) -> np.ndarray:
    """Squared-hinge support vector machine by Newton's method; the last weight is the bias. Classes weigh the same."""
    width = positive.shape[1]
    w = np.zeros(width + 1)
    for _ in range(40):
        left, right = np.eye(width + 1), np.zeros(width + 1)
        left[-1, -1] = 1e-6
        for z, y in ((positive, 1.0), (negative, -1.0)):
            near = z[y * (z @ w[:-1] + w[-1]) < 1].astype(np.float64)
            near = np.hstack([near, np.ones((len(near), 1))])
            share = 0.5 * cost / max(len(z), 1)
            left += share * near.T @ near
            right += share * y * near.sum(0)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _pieces(strings: list[np.ndarray], most: int = 300_000) -> Iterator[list[np.ndarray]]:
    part, size = [], 0
    for x in strings:
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(rows: list[tuple[int, str]]) -> Model:
    """A model from (label, text) rows."""
    toxic, clean = [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]
    if not toxic or not clean:
        return Model()
    # every fourth text of a class is kept for the calibration of scores
    fit = [[t for k, t in enumerate(side) if k % 4] or side for side in (toxic, clean)]
    found = _witnesses(*fit)
    if not found:
        return Model()
    marks = [subsequences(symbols(w)) for w in _landmarks(found, fit[1], LANDMARKS)]
    index = np.array(sorted({i for m in marks for i in m}), np.int64)
    place = {i: k for k, i in enumerate(index.tolist())}
    base = np.zeros((len(index), len(marks)))
    for k, m in enumerate(marks):
        for i, v in m.items():
            base[place[i], k] = v
    base /= np.linalg.norm(base, axis=0)
    values, vectors = np.linalg.eigh(base.T @ base)
    use = values > 1e-6
    to_feature = base @ (vectors[:, use] / np.sqrt(values[use]))  # triples -> Nyström features

    row_of = np.full(1 << (3 * _BITS), -1, np.int64)
    row_of[index] = np.arange(len(index))

    def features(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ends), to_feature.shape[1]), np.float32)
        for d, triple, weight in triples(x):
            for back in range(WINDOW):
                at = ends - back - d
                rows_at = np.where(at >= 0, row_of[triple[np.maximum(at, 0)]], -1)
                hit = np.flatnonzero(rows_at >= 0)
                out[hit] += weight * to_feature[rows_at[hit]]
        return out

    # Positive windows end where a witness does; negative ones are spread over the clean texts at first.
    px, p_at = laid_out([symbols(s) for s, _ in found])
    ends = []
    for (s, w), at in zip(found, p_at, strict=True):
        x, y = symbols(s), symbols(w)[1:-1]
        grid = np.lib.stride_tricks.sliding_window_view(x, len(y)) if 0 < len(y) <= len(x) else np.empty((0, 1))
        ends += [at + i + len(y) for i in np.flatnonzero((grid == y).all(1))[:1]]
    positive = features(px, np.array(ends, np.int64))
    parts = [laid_out(p) for p in _pieces([symbols(t) for t in fit[1]])]  # so that memory does not follow the sample
    rng = np.random.default_rng(5)
    negative = [features(x, rng.integers(0, len(x), 2 * len(at))) for x, at in parts]
    for _ in range(TURNS):
        weights = _machine(positive, np.vstack(negative))
        table = np.zeros(1 << (3 * _BITS), np.float32)
        table[index] = to_feature @ weights[:-1]
        for x, at in parts:  # the windows of each clean text that look worst come in next time
            worst = window_values(x, table)
            hard = [a + np.argpartition(worst[a:b], -2)[-2:] for a, b in zip(at, [*at[1:], len(x)], strict=True)]
            negative.append(features(x, np.concatenate(hard)))
    held = [[t for k, t in enumerate(side) if not k % 4] for side in (toxic, clean)]
    m = np.concatenate([margins(side, table) for side in held])
    slope, offset = _calibrated(m, np.repeat([1.0, 0.0], [len(s) for s in held]))
    return Model(index, table[index], slope, offset)


def _calibrated(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton's method, with his smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(np.abs(m).max(), 1e-9)
    z = np.stack([m / scale, np.ones(len(m))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), z.T @ (p - goal) + 1e-4 * w)
        w -= np.clip(step, -5, 5)
    return float(w[0] / scale), float(w[1])


# --- Spark ---

def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> list[tuple[int, str]]:
    """At most SAMPLE labelled rows of each class, none of them held out."""
    marked = labels.select(labels["doc_id"].cast("long").alias("i"), labels["toxic"].cast("int").alias("y")).where(
        "i IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("i")))
    picked = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).groupBy("i").agg(F.first("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    rows = (texts.join(F.broadcast(picked), "i").where(F.length("t") <= SAMPLE_CHARS).dropDuplicates(["i", "y"])
            .select("y", "t", "i").collect())
    return [(r["y"], r["t"]) for r in sorted(rows, key=lambda r: (r["i"], r["y"]))]


def _scored(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            at, _ = X.text_bytes(batch.column(0))
            for a, b in X.slices(at, X.CHUNK_BYTES // 2):
                part = batch.slice(a, b - a)
                score = model.probability(margins([t or "" for t in part.column(0).to_pylist()], table))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score, pa.float64())],
                                                 names=[*part.schema.names[1:], "score"])
    return work


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns renamed x0, x1, ... and ``score``."""
    plain = docs.toDF(*[f"x{k}" for k in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    text = plain[f"x{docs.columns.index(text_col)}"]
    return plain.select(text.alias("t"), *plain.columns).mapInArrow(_scored(model), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    model = train(sample(docs, labels, id_col, text_col))
    rows = with_scores(docs.select(id_col, text_col), model, text_col) if id_col != text_col else None
    doc_id = F.col("x0").cast("long")
    return rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, whole and unchanged."""
    model = train(sample(docs, labels, id_col, text_col))
    kept = with_scores(docs, model, text_col).where(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(docs.columns)])
