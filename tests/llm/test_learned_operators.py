"""Toxicity, mixing, packing and language-model scores."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import attention, mixing, packing, scoring, toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def marked(spark):
    """Sentences of made-up words; toxic ones hold an insult, in the held-out part often with characters put in."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "su", "me"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        w = [word() for _ in range(rng.randrange(8, 60))]
        if toxic:
            insult = rng.choice(["grobian", "pfuscher", "dummkopf"])
            if crc(i) % 3 == 1 and i % 2:
                insult = insult[:3] + "-" + insult[3:]
            w[rng.randrange(len(w))] = insult
        rows.append((i, " ".join(w) + ".", "t", 1.0))
        labels.append((i, 1, toxic))
    rows += [(900, None, None, None), (901, "", None, None), (3, rows[3][1], None, None), (None, "su me grobian", None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, t string, score double").repartition(3),
            spark.createDataFrame(labels + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int"), dict((i, y) for i, _, y in labels))


def test_kernel_counts_gapped_subsequences():
    assert toxicity.kernel("abc", "abc") > toxicity.kernel("abc", "abxc") > toxicity.kernel("abc", "axbxc") > toxicity.kernel("abc", "xyz") == 0
    x = toxicity.symbols("abcd")
    plain = Counter()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                plain[(int(x[i]) << 12) | (int(x[j]) << 6) | int(x[k])] += toxicity.DECAY ** (k - i + 1)
    got = toxicity.subsequences(x)
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-6 for k in plain)


def test_toxicity_on_held_out_rows(marked):
    frame, labels, truth = marked
    rows = toxicity.toxicity(frame, labels).collect()
    assert len(rows) == frame.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    found = [r["predicted"] for r in held if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not truth[r["doc_id"]]]
    assert np.mean(found) > 0.9 and np.mean(wrong) < 0.02
    kept = toxicity.clean_only(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


def test_toxicity_without_labels_or_rows(marked):
    frame, labels, _ = marked
    assert {r["score"] for r in toxicity.toxicity(frame, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(frame.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    speech = {"en": "the of and to in that it is".split(), "de": "der die und das nicht ein ist".split(),
              "fr": "le la et les des une est".split(), "es": "el los y una que por con".split()}
    rows = []
    for i in range(400):
        lang = rng.choice(["en"] * 6 + ["de", "fr", "es"])
        text = " ".join(rng.choice(speech[lang]) if rng.random() < 0.6 else f"x{rng.randrange(99)}" for _ in range(rng.randrange(5, 90)))
        rows.append((i, text, lang, 5, "p"))
    rows += [(400, None, "en", None, None), (401, "", None, None, None), (2, rows[2][1], "de", 1, "q"), (None, "le la et", "fr", None, None)]
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(None, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, tokens long, posterior string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_mix_meets_targets(spoken):
    frame, labels = spoken
    rows = mixing.mixed(frame, labels).collect()
    assert len(rows) == frame.count() and all(r["rate"] >= 0 and math.isfinite(r["rate"]) for r in rows)
    total = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
    whole = sum(total.values())
    assert all(abs(total[d] / whole - w) < 0.01 for d, w in mixing.TARGETS.items())
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.TARGETS) - 1) < 1e-9 for r in rows)
    right = [max(mixing.TARGETS, key=lambda d: r[f"p_{d}"]) for r in rows if r["tokens"] > 20 and r["doc_id"] not in (2, None)]
    truth = {r["doc_id"]: r["lang"] for r in frame.collect()}
    known = [truth[r["doc_id"]] for r in rows if r["tokens"] > 20 and r["doc_id"] not in (2, None)]
    assert np.mean([a == b for a, b in zip(right, known, strict=True)]) > 0.97


def test_mix_that_thins_and_the_applied_one(spoken):
    frame, labels = spoken
    model = mixing.train(mixing.labelled_rows(frame, labels), list(mixing.TARGETS))
    narrow = mixing.with_posteriors(frame, model).select("tokens", "posterior").cache()
    mix = mixing.fit(narrow, list(mixing.TARGETS.values()), 0.0, 1000.0)
    assert np.abs(mix.gaps).max() < 0.01
    assert narrow.select(mix.rate().alias("r")).agg({"r": "min"}).first()[0] >= 0
    many = mixing.applied(frame, labels)
    assert many.columns == frame.columns
    have, all_ids = Counter(r["doc_id"] for r in many.collect()), {r["doc_id"] for r in frame.collect()}
    assert set(have) == all_ids  # repeated, never dropped
    assert mixing.mixed(frame.limit(0), labels).count() == 0 and mixing.applied(frame.limit(0), labels).count() == 0


def mixing_table(spark, seed, n=300, sharp=3.0, weights=(0.95, 0.03, 0.015, 0.005)):
    rng = np.random.default_rng(seed)
    logits = np.log(np.array(weights)) + rng.gumbel(size=(n, len(weights)))
    p = np.exp(sharp * logits)
    p /= p.sum(1, keepdims=True)
    t = rng.integers(0, 400, n)
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>")
    return frame.repartition(3), t.astype(float), p


def rates_of(frame, mix):
    return {(r["tokens"], tuple(r["posterior"])): r["r"] for r in frame.withColumn("r", mix.rate()).collect()}


def test_rates_equal_the_dense_solution_where_none_is_held(spark):
    frame, t, p = mixing_table(spark, 4, weights=(0.4, 0.3, 0.2, 0.1))
    targets, total = np.array([0.35, 0.3, 0.22, 0.13]), 1.1 * t.sum()
    mix = mixing.fit(frame, list(targets), 0.0, total)
    # the least change, weighted by tokens, that meets the totals: a dense least squares over all rates
    root = np.sqrt(t)
    change = np.linalg.lstsq(p.T * root, targets * total - t @ p, rcond=None)[0]
    dense = 1 + np.divide(change, root, out=np.zeros_like(change), where=root > 0)
    assert dense.min() > 0
    got = rates_of(frame, mix)
    assert all(abs(got[(int(a), tuple(b))] - d) < 1e-3 for a, b, d in zip(t, p.tolist(), dense, strict=True) if a)


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rare_domains_are_met_and_rates_not_below_the_least(spark, least):
    frame, t, p = mixing_table(spark, 1, n=2000)
    targets = np.array(list(mixing.TARGETS.values()))
    mix = mixing.fit(frame, list(targets), least)
    assert np.abs(mix.gaps).max() < mixing.CLOSE and mix.rounds < mixing.ROUNDS
    found = rates_of(frame, mix)
    rates = np.array([found[(int(a), tuple(b))] for a, b in zip(t, p.tolist(), strict=True)])
    have = (rates * t) @ p
    assert rates.min() >= least and np.abs(have / have.sum() / targets - 1).max() < 2 * mixing.CLOSE


def test_targets_out_of_reach_give_a_warning_true_gaps_and_smaller_squares(spark):
    frame, t, p = mixing_table(spark, 3, n=200, sharp=0.2, weights=(0.4, 0.3, 0.2, 0.1))  # no text is far from the middle
    goal = np.array([0.7, 0.1, 0.1, 0.1]) * t.sum()
    with pytest.warns(UserWarning, match="targets not met"):
        mix = mixing.fit(frame, [0.7, 0.1, 0.1, 0.1], 0.0, t.sum())
    found = rates_of(frame, mix)
    have = (np.array([found[(int(a), tuple(b))] for a, b in zip(t, p.tolist(), strict=True)]) * t) @ p
    assert np.allclose(have / goal - 1, mix.gaps) and mix.rounds <= mixing.ROUNDS and min(found.values()) >= 0
    squares = lambda have: ((goal - have) ** 2 / goal).sum()
    rate, plain = np.ones(len(t)), 1 / np.linalg.eigvalsh((p.T * t) @ p / np.sqrt(np.outer(goal, goal))).max()
    for _ in range(20_000):  # the same least squares over all rates at once
        rate = np.maximum(0, rate + plain * (p @ ((goal - (rate * t) @ p) / goal)))
    assert squares((rate * t) @ p) <= squares(have) * (1 + 1e-9) and squares(have) < squares(t @ p)


def plain_best(at, cost, window):
    best = [0.0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            size = int(at[j] - at[i])
            if size <= window:
                pad = 0 if size & (size - 1) == 0 else window - size
                best[j] = min(best[j], best[i] + pad + cost[j] + packing.SEQUENCE)
    return best[-1]


def test_cuts_cost_as_little_as_any():
    rng = np.random.default_rng(3)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 20, 60))])
        cost = rng.choice([0.0, packing.SENTENCE_CUT, packing.HARD_CUT], len(at))
        cuts = packing.best_cuts(at, cost, 64)
        place = {int(a): k for k, a in enumerate(at)}
        total = sum(packing.SEQUENCE + cost[place[b]] + (0 if (b - a) & (b - a - 1) == 0 else 64 - (b - a)) for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == at[-1] and abs(total - plain_best(at, cost, 64)) < 1e-9


def test_pieces_hold_every_id_once(docs, no_docs, corpus_rows, monkeypatch):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_IDS", 5000)
    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [tuple(r) for r in packing.pack(docs).collect()]
    want = Counter()
    for i, t in corpus_rows:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, len(ids))] += len(ids)
    got, sequences = Counter(), defaultdict(list)
    texts = defaultdict(list)
    for i, t in corpus_rows:
        texts[i].append(np.array(slow.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for doc_id, start, length, check, every, sequence, offset in rows:
        got[(doc_id, every)] += length
        sequences[sequence].append((offset, length))
        assert any(len(x) == every and zlib.crc32(x[start:start + length].tobytes()) == check for x in texts[doc_id])
    assert got == want
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    assert packing.pack(no_docs).count() == 0


def test_fast_ids_are_those_of_the_vocabulary_file():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode, _ = packing.encoder()
    slow = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in ["", " ", "a  b\n\n c", "it's we'll I'D", "été 12 ñandú…", "<|endoftext|>x", "x" * 5000, " " * 5000 + "y", "  z 中文 🙂"]:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_each_id_is_scored_once_and_probabilities_sum_to_one():
    for n in (0, 1, 31, 32, 33, 57, 200):
        ids = np.arange(n) + 5
        seen, nxt, use = attention.windows(ids)
        assert nxt[use].tolist() == [*ids.tolist(), attention.END]
    model = attention.fresh()
    model.group, model.share = attention.classes(np.random.default_rng(0).integers(0, 50, attention.VOCABULARY).astype(float))
    assert abs(np.bincount(model.group, 10 ** model.share).sum() - attention.GROUPS * attention.IN_GROUP) < 1e-6
    every = attention.Scorer(model)
    after = [10 ** (every.log10_probability([np.array([5, int(k)])])[0] - every.log10_probability([np.array([5, int(k), 9])])[0]) for k in (7, 8)]
    assert np.isfinite(after).all()
    one = np.array([attention.log10_probability(model, [np.array([5, k])])[0] - attention.log10_probability(model, [np.array([5])])[0] for k in (7, 9)])
    assert np.isfinite(one).all()


def test_training_lowers_the_loss():
    ids = [np.tile([11, 12, 13, 14], 40) for _ in range(20)]
    counts = np.bincount(np.concatenate(ids), minlength=attention.VOCABULARY).astype(float)
    short, long = (attention.log10_probability(attention.train(ids, counts, steps), ids[:1])[0] for steps in (2, 120))
    assert long > short and long > -30  # 161 ids, next to certain


@pytest.mark.parametrize("size", [1, 400])
def test_shares_are_worked_out_in_place(size):
    """Plain and very large values, all places and those seen alone; no copy is made."""
    z = (np.random.default_rng(8).standard_normal((3, attention.CONTEXT, attention.CONTEXT)) * size).astype(np.float32)
    for seen in (None, np.tril(np.ones(z.shape[1:], np.float32))):
        e = np.exp(z.astype(float) - z.max(-1, keepdims=True) if seen is None else np.where(seen > 0, z, -np.inf) - np.where(seen > 0, z, -np.inf).max(-1, keepdims=True))
        given = z.copy()
        got = attention._softmax(given, seen) if seen is not None else attention._softmax(given)
        assert np.shares_memory(got, given) and np.abs(got - e / e.sum(-1, keepdims=True)).max() < 1e-5


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(9)
    m = attention.fresh()
    m.group, _ = attention.classes(rng.integers(0, 50, attention.VOCABULARY).astype(float))
    ids, use = rng.integers(0, 60, (6, attention.CONTEXT)), rng.random((6, attention.CONTEXT)) < 0.8
    goal = m.group[rng.integers(0, attention.VOCABULARY, ids.shape)].reshape(-1)

    def loss(embed, place, qkv, out, top, top_bias, read, bias):
        x = embed[ids] + place
        q, k, v = np.split(x @ qkv, 3, axis=2)
        z = np.where(np.tril(np.ones((attention.CONTEXT,) * 2)) > 0, q @ k.transpose(0, 2, 1) * attention.WIDTH ** -0.5, -np.inf)
        p = np.exp(z) / np.exp(z).sum(-1, keepdims=True)
        h = (x + p @ v @ out).reshape(-1, attention.WIDTH)
        first, second = h @ top + top_bias, np.einsum("ij,ijk->ik", h, read[goal // attention.IN_GROUP]) + bias[goal // attention.IN_GROUP]
        each = sum(z[np.arange(len(z)), at] - np.log(np.exp(z).sum(1)) for z, at in ((first, goal // attention.IN_GROUP), (second, goal % attention.IN_GROUP)))
        return -each[use.reshape(-1)].mean()

    used, grads = attention.gradients(m, ids, use, goal)
    params = [p.astype(float) for p in m.parameters()]
    for i, grad in enumerate(grads):
        way = rng.standard_normal(params[i].shape)
        along = [[p + s * 1e-4 * way if j == i else p for j, p in enumerate(params)] for s in (1, -1)]
        want = (loss(*along[0]) - loss(*along[1])) / 2e-4
        assert abs((grad * (way[used] if i == 0 else way)).sum() - want) < 1e-4 + 1e-3 * abs(want)


def test_scores_match_brute_force(docs, no_docs, corpus_rows, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 5)
    monkeypatch.setattr(scoring, "OWNER_BYTES", 40_000)
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 60_000)
    words = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + ["end"]
    held = lambda i: i is not None and crc(i) % 5 == 1
    c = Counter(w for i, t in corpus_rows if not held(i) for w in words(t))
    total = sum(c.values())
    below = math.log10(total + 0.5 * (len(c) + 1))
    want = Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), total,
                    round(sum(math.log10(c[w] + 0.5) - below for w in words(t)), 4)) for i, t in corpus_rows)
    rows = scoring.score(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert scoring.score(no_docs).count() == 0


def test_a_learner_reads_each_place_once():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 900, n) for n in (0, 1, 31, 32, 33, 200, 70_000)]
    counts = np.bincount(np.concatenate(texts), minlength=attention.VOCABULARY).astype(float)
    learner = attention.Learner(attention.train([], counts))
    for t in texts:
        learner.read([t])
    _, uses = learner.moved()
    assert uses[attention.END] == len(texts) and (uses[:attention.END] == counts[:attention.END]).all()
    assert set(uses[attention.VOCABULARY:]) == {sum(len(t) + 1 for t in texts)}


def test_texts_outside_the_sample_teach(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLE_IDS", 10)  # every text is longer
    rng = np.random.default_rng(6)
    texts = [np.tile(rng.permutation(40) + 100 * (i % 3), 75).astype("<u2") for i in range(60)]
    rows = [(i, False, i, i, bytearray(t.tobytes())) for i, t in enumerate(texts)] + [(99, True, 99, 99, bytearray(np.full(50, 700, "<u2").tobytes()))]
    encoded = spark.createDataFrame(rows, "doc_id long, held_out boolean, k1 long, k2 long, ids binary").repartition(3)
    counts = np.bincount(np.concatenate(texts), minlength=attention.VOCABULARY).astype(float)
    counts[attention.END] = len(texts)
    start, model = attention.train([], counts), scoring.train(encoded)
    moved = (model.embed != start.embed).any(1)
    assert moved[np.unique(np.concatenate(texts))].all() and not moved[700]
    assert attention.log10_probability(model, texts).sum() > attention.log10_probability(start, texts).sum() + 100


@pytest.mark.parametrize("least", [0.0, 1.0])
@pytest.mark.parametrize("tokens", [(900, 50, 40, 10), (9500, 300, 150, 50), (99_900, 50, 40, 10)])
def test_rare_domains_meet_their_targets(spark, tokens, least):
    sure = [(t // 5, [0.97 if i == k else 0.01 for i in range(4)]) for k, t in enumerate(tokens) for _ in range(5)]
    between = [(3, [0.6, 0.3, 0.05, 0.05]), (2, [0.25, 0.25, 0.25, 0.25]), (0, [0.1, 0.2, 0.3, 0.4])]
    narrow = spark.createDataFrame(sure + between, "tokens long, posterior array<double>").cache()
    targets = [0.5, 0.2, 0.2, 0.1]
    mix = mixing.fit(narrow, targets, least)
    rows = narrow.withColumn("rate", mix.rate()).collect()
    total = np.array([sum(r["rate"] * r["tokens"] * r["posterior"][k] for r in rows) for k in range(4)])
    assert min(r["rate"] for r in rows) >= least and np.abs(mix.gaps).max() < mixing.CLOSE
    assert np.abs(total / total.sum() / targets - 1).max() < 2 * mixing.CLOSE


def test_targets_that_cannot_be_met_are_told(spark):
    narrow = spark.createDataFrame([(50, [0.9, 0.1]), (70, [0.8, 0.2])], "tokens long, posterior array<double>").cache()
    for least in (0.0, 1.0):
        with pytest.warns(UserWarning, match="targets not met"):
            mix = mixing.fit(narrow, [0.5, 0.5], least)
        assert mix.gaps[1] < -0.1 and narrow.select(mix.rate().alias("r")).agg({"r": "max"}).first()[0] < 100
    assert mixing.fit(narrow, [0.5, 0.5], known=np.array([True, False])).gaps[1] == -1
