"""Mixing sources to target weights with soft membership.

A classifier trained on labelled documents (naive Bayes over hashed words, its evidence limited to EVIDENCE words so
that mixed texts stay mixed) gives each document a posterior over domains. With t tokens and posterior p, a document
used at rate r adds r * t * p to the domain totals. Rates >= ``least`` are fitted by projected gradient steps on the
squares of what the totals miss, each over its target: from rates of 1, each round adds p . v to a rate and lifts it to
``least`` where it fell below. The K numbers v are the misses, scaled by the inverse of the K x K moments of the rows (sum
of t * p * p), so a step does not depend on the rarest domain. Rows held at ``least`` do not move, so the moments of the
others are tried first, then those of all rows, then the plain gradient over the greatest moment, with which the squares
cannot rise; the first for which they fall is taken. A rate is thus a function of the posterior and of K numbers a round, and is never stored; where no rate is held, the rates are those nearest to 1 (in
squares, weighted by t) that meet the targets. A round is one aggregation over a narrow table (tokens, posterior), from
which some K * K numbers come back.

Rounds go on until each domain's miss, relative to its target, is below CLOSE. Where the squares fall by less than
STALLED a round (or after ROUNDS), steps end: the targets are out of the posteriors' reach, or nearly so. The rates of
the best round are used, which need not be the nearest of all; a warning gives the gaps that stay, and the result has
them too. Domains without labelled rows have no target, as nothing is known of them: a
warning names them, and the others have their shares among themselves. A domain that is rare in ``docs`` has high rates.

Unless a total is given, it is the least at which no domain need be thinned. If also no rate may be below 1, only the
first round has that total and then it follows the rates, as texts that stand between domains may need a larger one;
where the shares are not met so, the rates are those for the least total. ``applied`` takes a rate of 2.3 as two copies
and a third for the share 0.3 of documents whose hash says so.

Null texts count as empty: no tokens, posterior is the prior. Repeated rows each have a rate. Labelled rows with a
null domain teach nothing. Empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words as X
from .exact import stored

#: Domains and their shares of all tokens in the mix.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
SAMPLE = 8000
CELLS = 1 << 14
EVIDENCE = 20.0
ROUNDS, CLOSE, STALLED = 40, 1e-3, 0.01


@dataclass
class Classifier:
    """Log weights (cells x domains), log priors, and which domains have labelled rows."""

    domains: list[str]
    weights: np.ndarray
    prior: np.ndarray
    known: np.ndarray | None = None

    def posterior(self, c: X.Chunk) -> np.ndarray:
        n = np.diff(c.first)
        value = self.weights[(c.hashes() % np.uint64(CELLS)).astype(np.intp)]
        total = np.zeros((c.texts, len(self.domains)))
        has = np.flatnonzero(n)
        if len(has):
            total[has] = np.add.reduceat(value, c.first[:-1][has], axis=0)
        z = self.prior + total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _cells(domains: list[str]):
    """(domain number, text) -> how often each cell of words stands, summed over the task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(domains), CELLS + 1), np.int64)
        for batch in batches:
            number = batch.column(0).to_numpy()
            for c in X.chunks(batch.column(1)):
                own = number[c.row:c.row + c.texts]
                np.add.at(counts, (own, CELLS), 1)
                cell = (c.hashes() % np.uint64(CELLS)).astype(np.int64)
                flat = own[c.owner()] * (CELLS + 1) + cell
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        k, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[k, cell])],
                                         names=["k", "cell", "n"])
    return work


def train(labelled: DataFrame, domains: list[str], text_col: str = "text", domain_col: str = "domain") -> Classifier:
    """From labelled rows (text, domain); cells are counted by Spark, a table of domains x CELLS comes back."""
    number = F.element_at(F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))]), labelled[domain_col])
    rows = labelled.select(number.alias("k"), F.coalesce(labelled[text_col], F.lit("")).alias("t")).where("k IS NOT NULL")
    counts = np.zeros((len(domains), CELLS + 1))
    for r in rows.mapInArrow(_cells(domains), "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["k"], r["cell"]] = r["n"]
    words = counts[:, :CELLS] + 0.1
    texts = counts[:, CELLS] + 1.0
    return Classifier(list(domains), np.ascontiguousarray(np.log(words / words.sum(1, keepdims=True)).T, np.float32), np.log(texts / texts.sum()),
                      counts[:, CELLS] > 0)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  domain_col: str = "lang") -> DataFrame:
    """(text, domain) of at most SAMPLE labelled documents, the first by a hash of doc_id."""
    ids = (labels.select(labels["doc_id"].cast("long").alias("i")).where("i IS NOT NULL").distinct()
           .orderBy(F.xxhash64("i"), "i").limit(SAMPLE))
    rows = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].alias("text"), docs[domain_col].alias("domain"))
    return rows.join(F.broadcast(ids), "i").select("text", "domain")


def _posteriors(model: Classifier):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column(0)):
                p = model.posterior(c)
                own = batch.slice(c.row, c.texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(c.texts + 1) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(np.diff(c.first), pa.int64()), lists],
                                                 names=[*own.schema.names[1:], "tokens", "posterior"])
    return work


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with columns renamed x0, x1, ..., and tokens and posterior."""
    plain = docs.toDF(*[f"x{k}" for k in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("tokens", T.LongType()),
                           T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return plain.select(plain[f"x{docs.columns.index(text_col)}"].alias("t"), *plain.columns).mapInArrow(_posteriors(model), schema)


@dataclass
class Mix:
    """Rates as a function of the posterior, and how well the totals meet the targets (-1: nothing known of a domain)."""

    least: float
    steps: list[np.ndarray] = field(default_factory=list)
    gaps: np.ndarray | None = None
    rounds: int = 0

    def rate(self) -> Column:
        least, rate = F.lit(float(self.least)), F.lit(float(max(self.least, 1)))
        for step in self.steps:
            rate = F.greatest(least, rate + sum((F.col("posterior")[k] * F.lit(float(v)) for k, v in enumerate(step)), F.lit(0.0)))
        return rate


def _look(narrow: DataFrame, mix: Mix, k: int, held: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the domains at ``mix``, and the moments of the rows (``held``: of those whose rate is above the least)."""
    t, p = F.col("tokens"), [F.col("posterior")[i] for i in range(k)]
    moves = F.when(F.col("r") > F.lit(float(mix.least)), t).otherwise(0) if held else t
    row = narrow.withColumn("r", mix.rate()).agg(
        *[F.sum(F.col("r") * t * p[i]).alias(f"s{i}") for i in range(k)],
        *[F.sum(moves * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    moment = [[row[f"m{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), np.array(moment)


def _descend(narrow: DataFrame, mix: Mix, every: np.ndarray, share: np.ndarray, whole: float, use: np.ndarray,
             free: bool, most: int = ROUNDS) -> tuple[Mix, bool]:
    """Rounds that go on from ``mix``, and whether the targets were met; ``every``: moments of all rows, a ``free`` total follows the rates."""
    have, moving = _look(narrow, mix, len(use))
    # Misses are counted in square roots of their targets; at a free total only the shares can miss.
    view = (np.eye(len(share)) - (share[:, None] if free else 0.0)) / np.sqrt(share * whole)[:, None]

    def scaled(moment: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(view @ moment[np.ix_(use, use)] @ view.T, rcond=1e-9, hermitian=True)

    def misses(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gaps, what is missed, and its squares."""
        gaps, goal = np.full(len(use), -1.0), share * (totals[use].sum() if free else whole)
        gaps[use] = totals[use] / goal - 1
        miss = -view @ totals[use] + (0.0 if free else np.sqrt(share * whole))
        return gaps, miss, float(miss @ miss)

    plain = np.eye(len(share)) / np.linalg.eigvalsh(view @ every[np.ix_(use, use)] @ view.T).max()
    mix, last = Mix(mix.least, mix.steps, rounds=mix.rounds), mix.rounds + most
    mix.gaps, miss, squares = misses(have)
    while np.abs(mix.gaps[use]).max() >= CLOSE:
        if mix.rounds >= last:
            return mix, False
        before = squares
        for matrix, part in [(scaled(moving), 1.0), (scaled(moving), 0.25)] * bool(mix.steps) + [(scaled(every), 1.0), (plain, 1.0)]:
            step = np.zeros(len(use))
            step[use] = part * (view.T @ (matrix @ miss))
            new = Mix(mix.least, [*mix.steps, step], rounds=mix.rounds + 1)
            have, others = _look(narrow, new, len(use))
            new.gaps, missed, squares = misses(have)
            if squares < before * (1 - STALLED):
                break
        else:
            return (new if squares < before else mix), False
        mix, miss, moving = new, missed, others
    return mix, True


def fit(narrow: DataFrame, targets: list[float], least: float = 0.0, total: float | None = None,
        known: np.ndarray | None = None) -> Mix:
    """``narrow`` has (tokens, posterior) and is read once or a few times a round; without ``known`` all domains are."""
    k = len(targets)
    use = np.ones(k, bool) if known is None else known
    mix = Mix(least)
    have, every = _look(narrow, mix, k, held=False)
    if not have.sum():
        return mix
    if not use.any():
        return Mix(least, gaps=np.full(k, -1.0))
    share = np.array(targets)[use] / np.array(targets)[use].sum()
    whole = total if total is not None else (have[use] / share).max()
    met = False
    if total is None and least >= 1:
        begun, met = _descend(narrow, mix, every, share, whole, use, False, 1)
        found, met = (begun, True) if met else _descend(narrow, begun, every, share, whole, use, True)
    if not met:
        found, met = _descend(narrow, mix, every, share, whole, use, False)
    if not met:
        warnings.warn(f"targets not met, gaps relative to them: {[round(float(g), 4) for g in found.gaps]}", stacklevel=2)
    return found


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies of a document at ``rate``."""
    share = F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (share < rate - F.floor(rate)).cast("long")).cast("long")


def _fitted(docs, labels, id_col, text_col, domain_col, targets, least) -> tuple[DataFrame, Mix]:
    model = train(labelled_rows(docs, labels, id_col, text_col, domain_col), list(targets))
    scored = with_posteriors(docs, model, text_col)
    narrow = stored(scored.select("tokens", "posterior"), "posteriors")
    if not model.known.all():
        warnings.warn(f"no labelled rows, so no target: {[d for d, k in zip(targets, model.known, strict=True) if not k]}", stacklevel=3)
    return scored, fit(narrow, list(targets.values()), least, known=model.known)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id",
          text_col: str = "text", domain_col: str = "lang", least: float = 0.0) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies, gap_<domain>...), one row per row of ``docs``; gaps are of the whole mix."""
    scored, mix = _fitted(docs.select(id_col, text_col, domain_col), labels, id_col, text_col, domain_col, targets, least)
    rows = scored.select(F.col("x0").cast("long").alias("doc_id"), "tokens", "posterior").withColumn("rate", mix.rate())
    return rows.select("doc_id", "tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(targets)], "rate",
                       copies(F.col("rate"), F.col("doc_id")).alias("copies"),
                       *[F.lit(None if mix.gaps is None else float(mix.gaps[k])).cast("double").alias(f"gap_{d}") for k, d in enumerate(targets)])


def applied(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id",
            text_col: str = "text", domain_col: str = "lang", least: float = 1.0) -> DataFrame:
    """The rows of ``docs``, whole, each as many times as its rate says."""
    scored, mix = _fitted(docs, labels, id_col, text_col, domain_col, targets, least)
    times = copies(mix.rate(), F.col(f"x{docs.columns.index(id_col)}").cast("long"))
    many = scored.withColumn("n", times).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return many.select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(docs.columns)])
