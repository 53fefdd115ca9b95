"""Deep segmentation against a vocabulary that is a table, however large.

The literal path (``functions.text.deep_move``) compares every slice of a word with every known word. Here both sides
are keyed so that only words within reach meet, by equality. The bar allows d edits for a slice and a word whose longer
one has L letters. Up to two edits, the two share a text that is left when letters are deleted from both. Beyond that
the word is cut into d // 2 + 1 parts; one of them has an edit at most, so that part, at one of the few places it can
have moved to, shares such a text with the slice. Hashes of these texts are compared, then ``levenshtein`` decides. Pairs
with more than LONG letters meet by their lengths alone.

Every letter of a slice that no known word has costs an edit, so slices with too many of them are left out first. What is
asked for is written before the join: Spark knows its size then, and where it is small the vocabulary's keys, some dozens a
word, are not shuffled. Only a key asked for by more than HOT slices is repeated, to spread them.

Null and empty words are left out; of a repeated word the first place counts. An empty vocabulary gives no moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from .common import computed_here, salted_lookup, stored

#: Slices that ask for one key in one task.
HOT = 4096
#: Longest texts, in letters, whose parts are keyed; it bounds the plan below.
LONG = 32
_PLAN = "n int, d int, part int, at int, len int, cuts int"


def edits_allowed(longer: int) -> int:
    """Most edits at which a pair whose longer text has ``longer`` letters reaches the bar."""
    return max(d for d in range(longer + 1) if 1.0 - d / longer >= X.FUZZY_BAR)


def parts_of(n: int, d: int) -> tuple[list[tuple[int, int]], int]:
    """Where the parts of a word of ``n`` letters begin and how long they are, and the edits one of them has at most."""
    if d <= 2:
        return [(0, n)], d
    k = d // 2 + 1
    edge = [p * n // k for p in range(k + 1)]
    return [(edge[p], edge[p + 1] - edge[p]) for p in range(k)], 1


def pairs_of(n: int, m: int) -> list[tuple[int, ...]]:
    """For a word of ``n`` and a slice of ``m`` letters, what meets: (d, part, word's place, length, letters deleted, the
    slice's place, length, letters deleted)."""
    if max(n, m) > LONG:
        return [(0, -1, 0, 0, 0, 0, 0, 0)]
    d, more = edits_allowed(max(n, m)), m - n
    if abs(more) > d:
        return []
    parts, most = parts_of(n, d)
    out = []
    for part, (start, size) in enumerate(parts):
        for e in range(-most, most + 1):
            for shift in range(-d, d + 1):
                at, wide, left = start + shift, size + e, max(size, size + e) - most
                inside = 0 <= at and at + wide <= m and (len(parts) > 1 or wide == m)
                if inside and abs(shift) + abs(e) + abs(more - shift - e) <= d:
                    out.append((d, part, start, size, size - left, at, wide, wide - left))
    return out


def _plans(spark: SparkSession, lengths: list[int], shortest: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``pairs_of`` by the word's length and by the slice's, for the word lengths there are."""
    words, slices = set(), set()
    for n in lengths:
        for m in range(max(shortest, n - X.VOCABULARY_GAP), n + X.VOCABULARY_GAP + 1):
            for d, part, start, size, cut, at, wide, cuts in pairs_of(n, m):
                words.add((n, n, d, part, start, size, cut))
                slices.add((m, n, d, part, at, wide, cuts))
    make = lambda rows: spark.createDataFrame(sorted(rows), "own int, " + _PLAN)
    return make(words), make(slices)


def _shortened(texts: Column) -> Column:
    """Every text with each of its letters deleted in turn."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))


def _keyed(rows: DataFrame, text: str, plan: DataFrame) -> DataFrame:
    """``rows`` with ``key``, one row for every text left of a part; a plan has some thousand rows, bounded by LONG."""
    met = rows.join(F.broadcast(plan), F.length(text) == F.col("own"))
    piece = F.array(F.substring(F.col(text), F.col("at") + 1, F.col("len")))
    left = F.when(F.col("cuts") == 0, piece).when(F.col("cuts") == 1, _shortened(piece)).otherwise(_shortened(_shortened(piece)))
    return met.select(*rows.columns, "n", "d", "part", F.explode(left).alias("_t")).select(
        *rows.columns, F.xxhash64("n", "d", "part", "_t").alias("key"))


def known_words(vocabulary: DataFrame) -> DataFrame:
    """(word, vocab_pos) of a vocabulary: each word once."""
    return vocabulary.where("word <> ''").groupBy("word").agg(F.min("vocab_pos").cast("long").alias("vocab_pos"))


def in_reach(slices: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose ``piece`` can reach the bar, by how many of its letters no known word has."""
    each = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), i, F.lit(1)))
    letters = sorted(r[0] for r in known.select(F.explode(each).alias("letter")).distinct().collect())  # an alphabet
    foreign = F.length(F.translate("piece", "".join(letters), ""))
    return slices.where(F.lit(1.0) - foreign / (F.length("piece") + X.VOCABULARY_GAP) >= X.FUZZY_BAR)


def near_pairs(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """(piece, word, vocab_pos) of all pairs that can reach the bar, some more than once; both sides distinct."""
    lengths = sorted(r[0] for r in known.select(F.length("word")).distinct().collect())  # a few numbers
    for_words, for_slices = _plans(pieces.sparkSession, lengths, 1)
    index = _keyed(known.select("word", "vocab_pos"), "word", for_words)
    asked, on = stored(_keyed(pieces.select("piece"), "piece", for_slices), "asked-keys"), ["key"]
    many = stored(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(
        "key", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "hot-keys")
    if not many.isEmpty():
        salts, on = F.coalesce("salts", F.lit(1)), ["key", "salt"]
        asked = stored(asked.join(many, "key", "left").select("piece", "key", F.pmod(F.xxhash64("piece"), salts).cast("int").alias("salt")), "asked-keys")
        index = index.join(many, "key", "left").select("word", "vocab_pos", "key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return asked.join(index, on).select("piece", "word", "vocab_pos")


def best_words(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """(piece, score, vocab_pos, token): the most similar word of each piece that has one at the bar, first in order."""
    score = X.similarity(F.col("piece"), F.col("word"))
    scored = near_pairs(pieces, known).withColumn("score", score).where(F.col("score") >= X.FUZZY_BAR)
    best = F.max(F.struct("score", (-F.col("vocab_pos")).alias("p"), F.col("word").alias("token"))).alias("b")
    return scored.groupBy("piece").agg(best).select("piece", "b.score", (-F.col("b.p")).alias("vocab_pos"), "b.token")


def word_moves(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, offset, taken, token) for distinct words: what ``deep_move`` does at each offset where it takes something."""
    return _moves(stored(words.select("word"), "deep-words"), vocabulary)


def _moves(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    known = stored(known_words(vocabulary), "vocabulary")
    longest = known.agg(F.max(F.length("word"))).first()[0] or 0
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("offset"))
    rest = F.least(F.length("word") - F.col("offset"), F.lit(longest + X.VOCABULARY_GAP))
    sizes = F.when(rest >= X.MIN_SLICE, F.sequence(F.lit(X.MIN_SLICE), rest))
    slices = in_reach(at.select("word", "offset", F.explode(sizes).alias("n")).withColumn(
        "piece", F.substring(F.col("word"), F.col("offset") + 1, F.col("n"))), known)
    spread = F.xxhash64("word", "offset")
    exact = stored(salted_lookup(slices, known.select(F.col("word").alias("piece")), "piece", spread, "inner")
                   .groupBy("word", "offset").agg(F.max("n").alias("taken")), "exact-moves")
    unknown = slices.join(exact.select("word", "offset"), ["word", "offset"], "left_anti")
    best = stored(best_words(unknown.select("piece").distinct(), known), "best-words")
    choice = F.max(F.struct("score", "n", (-F.col("vocab_pos")).alias("p"), "token")).alias("b")
    fuzzy = salted_lookup(unknown, best, "piece", spread, "inner").groupBy("word", "offset").agg(choice)
    return exact.select("word", "offset", "taken", F.substring(F.col("word"), F.col("offset") + 1, F.col("taken")).alias("token")).unionByName(
        fuzzy.select("word", "offset", F.col("b.n").alias("taken"), "b.token"))


def segment_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, segments): the deep segmentation of each distinct word, as ``matching.segment_words``."""
    words = stored(words.select("word"), "deep-words")
    listed = _moves(words, vocabulary).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(
        "offset", F.struct("taken", "token")))).alias("moves"))
    rows = words.join(listed, "word", "left")
    return computed_here(rows, "segments", X.segment_walk(F.col("word"), lambda at: F.try_element_at(F.col("moves"), at))).select("word", "segments")
