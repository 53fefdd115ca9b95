"""The index of a vocabulary table against all pairs, and deep mode with a large table."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.operators import vocabulary as V
from tabloom.operators.matching import segment_words, tokenise


def edited(rng, word, letters):
    out = list(word)
    for _ in range(rng.randint(0, 4)):
        i, kind = rng.randint(0, len(out)), rng.randint(0, 2)
        if kind == 0:
            out.insert(i, rng.choice(letters))
        elif i < len(out):
            out[i:i + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(out)


def frames(spark, words, pieces):
    return (spark.createDataFrame([(p,) for p in pieces], "piece string"),
            spark.createDataFrame(list(zip(words, range(len(words)), strict=True)), "word string, vocab_pos long"))


def by_all_pairs(pieces, known):
    near = F.abs(F.length("piece") - F.length("word")) <= X.VOCABULARY_GAP
    scored = pieces.crossJoin(known).where(near).withColumn("score", X.similarity(F.col("piece"), F.col("word"))).where(F.col("score") >= X.FUZZY_BAR)
    best = F.max(F.struct("score", (-F.col("vocab_pos")).alias("p"), "word")).alias("b")
    return {(r.piece, r.b.score, -r.b.p, r.b.word) for r in scored.groupBy("piece").agg(best).collect()}


def test_best_words_equal_all_pairs(spark):
    """Few letters, so that many pairs are near; words of up to 40 letters, some beyond LONG."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([*range(1, 17), 24, 33, 40]))) for _ in range(300)})
    pieces, known = frames(spark, words, sorted({edited(rng, rng.choice(words), "abc") for _ in range(800)} - {""}))
    got = {tuple(r) for r in V.best_words(pieces, known).collect()}
    assert got == by_all_pairs(pieces, known) and len(got) > 500


def test_keys_asked_for_often_are_spread(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT", 3)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([3, 6, 9, 12, 34]))) for _ in range(150)})
    pieces, known = frames(spark, words, sorted({edited(rng, rng.choice(words), "ab") for _ in range(400)} - {""}))
    got = {tuple(r) for r in V.best_words(pieces, known).collect()}
    assert got == by_all_pairs(pieces, known) and len(got) > 100


def test_slices_with_foreign_letters_ask_for_nothing(spark):
    """Numbers against letters: no slice is in reach, and no near one is lost."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcé𐐀") for _ in range(rng.choice([3, 5, 7, 10, 13, 40]))) for _ in range(150)})
    numbers = [str(10**k + rng.randrange(10**k)) for k in range(2, 9) for _ in range(20)]
    near = {edited(rng, rng.choice(words), "ab12𐐀") for _ in range(500)}
    pieces, known = frames(spark, words, sorted({*near, *numbers} - {""}))
    kept = V.in_reach(pieces, known)
    assert not {r.piece for r in kept.collect()} & set(numbers)
    got = {tuple(r) for r in V.best_words(kept, known).collect()}
    assert got == by_all_pairs(pieces, known) and len(got) > 100


def test_few_slices_leave_the_vocabulary_in_place(spark):
    """The keys of the vocabulary's words are not shuffled where little is asked for."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(50_000)})
    pieces, known = frames(spark, words, ["suppliernumber", words[7]])
    moved = V.near_pairs(pieces, V.stored(known, "words"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in moved and "hashpartitioning" not in moved


def test_large_vocabulary(spark):
    """100,000 words: same best words as all pairs, from few of the pairs."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 12))) for _ in range(100_000)})
    chosen = sorted({edited(rng, rng.choice(words), letters) for _ in range(40)} - {""})
    pieces, known = frames(spark, words, chosen)
    got = {tuple(r) for r in V.best_words(pieces, known).collect()}
    assert got == by_all_pairs(pieces, known) and len(got) > 10
    assert V.near_pairs(pieces, known).distinct().count() < len(words) * len(chosen) / 500


def test_segments_equal_the_literal_path(spark, lexicon):
    table = spark.createDataFrame([*enumerate(lexicon.vocabulary), (900, lexicon.vocabulary[0]), (901, None), (902, "")],
                                  "vocab_pos long, word string")
    texts = ["suppliernumber", "qqqqemail", "zz", "supplyernumbar", "a", "invoicedateinvoicedate", "x" * 60, "telephonenumbr"]
    words = spark.createDataFrame([(t,) for t in texts], "word string")
    want = {r.word: r.segments for r in segment_words(words, lexicon).collect()}
    assert {r.word: r.segments for r in V.segment_words(words, table).collect()} == want
    assert {r.word: r.segments for r in V.segment_words(words, table.limit(0)).collect()} == {t: [t] for t in texts}


def test_vocabulary_needs_deep_mode(header_rows, spark, lexicon):
    headers = header_rows({"f": ["suppliernumber"]}).select("source")
    table = spark.createDataFrame([(0, "supplier"), (1, "number")], "vocab_pos long, word string")
    with pytest.raises(ValueError):
        tokenise(headers, lexicon, "standard", table)
    assert tokenise(headers, lexicon, "deep", table).first().tokens == ["supplier", "number"]
