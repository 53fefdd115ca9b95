"""Header names against target signatures, and the one-to-one assignment per file.

Scoring depends on the header text alone, so it runs once per distinct text (most files share theirs) and is joined
back. The 26 signatures are literals, so "every header against every signature" is an expression and not a cross join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..functions.cells import bind
from ..lexicon import UNKNOWN_WEIGHT, Lexicon
from . import vocabulary as V
from .common import computed_here, range_rank, salt_count, salted_lookup

AMBIGUITY_GAP = 0.05
GRAMMAR_BONUS = 0.10
MODES = ("standard", "deep")


def distinct_words(sources: DataFrame, camel: bool) -> DataFrame:
    """Distinct words over all header texts."""
    return sources.select(F.explode_outer(X.words(F.col("source"), camel)).alias("word")).where("word is not null").distinct()


def segment_words(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, segments): the deep segmentation of each distinct word.

    A word without a letter of the lexicon's words, such as a number, is one segment and is not walked.
    """
    word = F.col("word")
    whole = (F.length(word) > 0) & ~X.shares_letters(word, lexicon.vocabulary)
    return computed_here(words.select("word"), "segments", F.when(whole, F.array(word)).otherwise(X.deep_segments(word, lexicon)))


def deep_tokens(sources: DataFrame, lexicon: Lexicon, vocabulary: DataFrame | None = None) -> DataFrame:
    """(source, tokens) for distinct texts; every distinct word is segmented once and joined back.

    With ``vocabulary`` (word, vocab_pos) words are cut by that table in place of the lexicon's words.
    """
    placed = sources.select("source", F.posexplode_outer(X.words(F.col("source"), camel=False)).alias("word_pos", "word"))
    distinct = placed.select("word").where("word is not null").distinct()
    segmented = segment_words(distinct, lexicon) if vocabulary is None else V.segment_words(distinct, vocabulary)
    found = salted_lookup(placed, segmented, "word", spread=F.col("source"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("segments").isNotNull(), F.struct("word_pos", "segments"))))
    return found.groupBy("source").agg(
        F.flatten(F.transform(ordered, lambda w: w["segments"])).alias("tokens"))


def tokenise(sources: DataFrame, lexicon: Lexicon, mode: str = "standard", vocabulary: DataFrame | None = None) -> DataFrame:
    """(source, tokens, lemmas, kept) for distinct header texts; a ``vocabulary`` table serves the deep mode only."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if vocabulary is not None and mode != "deep":
        raise ValueError("a vocabulary table needs mode deep")
    if mode == "deep":
        cut = deep_tokens(sources, lexicon, vocabulary)
    else:
        cut = computed_here(sources.select("source"), "tokens", X.standard_tokens(F.col("source"), lexicon))
    return (cut.withColumn("lemmas", X.lemmas(F.col("tokens"), lexicon))
            .withColumn("kept", X.without_stop_words(F.col("lemmas"), lexicon)))


def score_sources(sources: DataFrame, lexicon: Lexicon, mode: str = "standard", vocabulary: DataFrame | None = None) -> DataFrame:
    """(source, tokens, lemmas, kept, candidates): candidates are the (sig_pos, score) pairs above 0."""
    tokens = tokenise(sources.select("source").distinct(), lexicon, mode, vocabulary)
    # How a token fares against the signatures is worked out once per distinct token, headers then only add up. Tokens
    # that are noise to all signatures have no row: Spark may broadcast this table, and cannot tell how wide its rows are.
    names = ["tokens", "lemmas", "kept"]
    placed = tokens.select("source", *names, F.posexplode_outer("kept").alias("pos", "token"))
    distinct = computed_here(placed.select("token").where("token IS NOT NULL").distinct(), "meets", X.meets_signature(F.col("token"), lexicon))
    fares = computed_here(distinct.where("meets").select("token"), "fares", X.token_fares(F.col("token"), lexicon))
    found = salted_lookup(placed, fares, "token", spread=F.col("source"))
    none = F.expr("cast(array() as array<struct<sig_pos:int,matched:double,added:double>>)")
    listed = F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct(
        "pos", F.coalesce("fares.weight", F.lit(UNKNOWN_WEIGHT)).alias("weight"), F.coalesce("fares.hits", none).alias("hits")))))
    rows = found.groupBy("source").agg(*[F.first(n).alias(n) for n in names], listed.alias("_f"))
    return computed_here(rows, "candidates", X.summed_scores(F.col("_f"), lexicon)).drop("_f")


def file_sources(headers: DataFrame) -> DataFrame:
    """One row per (file, header text): first position and how often it occurs."""
    return headers.groupBy("file_id", "source").agg(
        F.min("src_pos").alias("src_pos"), F.count(F.lit(1)).alias("repeats"))


def placed_sources(headers: DataFrame, listed: DataFrame, *also: str) -> DataFrame:
    """``file_sources`` with what ``listed`` (one row per text) holds for the text, and columns ``also`` of the file.

    Rows move once, by text and a salt of the file, which serves both the count and the join; a text that stands in very
    many files is spread over as many tasks as there are salts.
    """
    salts, keys = salt_count(headers.sparkSession), ["source"]
    rows = headers.select("file_id", "source", "src_pos", *also)
    if salts > 1:
        keys = ["source", "_salt"]
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("file_id"), F.lit(salts)).cast("int"))
        listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counted = rows.repartition(*keys).groupBy(*keys, "file_id", *also).agg(
        F.min("src_pos").alias("src_pos"), F.count(F.lit(1)).alias("repeats"))
    return counted.join(listed, keys, "left").drop("_salt")


def pair_rows(headers: DataFrame, scored: DataFrame, lexicon: Lexicon, best: int | None = None) -> DataFrame:
    """Long form: (file_id, source, src_pos, repeats, sig_pos, target_id, score).

    With ``best`` only the best so many pairs of each header, with their ``place``; they depend on the text alone.
    """
    listed, place = scored.select("source", "candidates"), []
    if best is not None:
        listed = computed_here(listed, "top", F.slice(ranked_candidates(0.0), 1, best)).select("source", F.col("top").alias("candidates"))
        place = [(F.col("at") + 1).alias("place")]
    joined = placed_sources(headers, listed)
    ids = X.strings(list(lexicon.signatures))
    return joined.select("file_id", "source", "src_pos", "repeats", F.posexplode("candidates").alias("at", "c")).select(
        "file_id", "source", "src_pos", "repeats", F.col("c.sig_pos").alias("sig_pos"),
        F.get(ids, F.col("c.sig_pos")).alias("target_id"), F.col("c.score").alias("score"), *place)


def pair_ranks(pairs: DataFrame) -> DataFrame:
    """Rank of each pair in its file: score down, then source position, then signature order.

    Ranges of (file, score, position) are ranked in tasks of their own, so neither a file with very many headers nor one
    with very many equal scores is sorted in one task.
    """
    return range_rank(pairs, ["file_id"], [F.desc("score"), F.asc("src_pos"), F.asc("sig_pos")], "rank")


def ranked_candidates(threshold: float, *more: Callable[[Column], Column]) -> Column:
    """The candidates of a row at or above the threshold, the best first."""
    return F.sort_array(F.transform(F.filter("candidates", lambda c: c["score"] >= threshold), lambda c: F.struct(
        (-c["score"]).alias("minus"), c["sig_pos"].alias("sig_pos"), c["score"].alias("score"), *[m(c) for m in more])))


def mark_ambiguous(joined: DataFrame, threshold: float) -> DataFrame:
    """Keep candidates at or above the threshold; add the best of each source and whether it has a close rival.

    A repeated name is its own rival. Works on the candidate array of each row, so nothing moves.
    """
    return with_rivals(joined.withColumn("ranked", F.coalesce(
        ranked_candidates(threshold), F.array().cast("array<struct<minus:double,sig_pos:int,score:double>>"))))


def with_rivals(rows: DataFrame) -> DataFrame:
    """Add the best score of the ``ranked`` candidates and whether it has a close rival."""
    close = F.col("top") - F.get("ranked", F.lit(1))["score"] <= AMBIGUITY_GAP
    return (rows.withColumn("top", F.get("ranked", F.lit(0))["score"])
            .withColumn("ambiguous", (F.size("ranked") > 0) & ((F.col("repeats") > 1) | F.coalesce(close, F.lit(False)))))


def grammar_bonus(source: Column, sig_pos: Column, lexicon: Lexicon) -> Column:
    """Extra score for an ambiguous header: plural names lean to counts, singular ones to amounts."""
    def flags(found):
        return F.expr(f"array({', '.join(str(f).lower() for f in found)})")

    labels = {t.target_id: t.label.lower() for t in lexicon.targets}
    order = [labels[t] for t in lexicon.signatures]
    counts = flags(any(w in label for w in ("number", "count", "transaction")) for label in order)
    amounts = flags(any(w in label for w in ("amount", "value")) for label in order)
    plural = X.is_plural(source)
    fits = (plural & F.get(counts, sig_pos)) | (~plural & F.get(amounts, sig_pos))
    return F.when(~X.explicit_measure(source) & fits, F.lit(GRAMMAR_BONUS)).otherwise(F.lit(0.0))


def assign(headers: DataFrame, scored: DataFrame, lexicon: Lexicon, threshold: float = 0.5,
           filled: DataFrame | None = None, flags: bool = False) -> DataFrame:
    """One-to-one mapping per file: 26 rows per file (file_id, target_pos, target_id, sources, confidence).

    With ``flags`` there is one column more, ``ambiguous``: the source had a close rival target.
    ``filled`` (file_id, filled array<string>) names targets that are not on offer.
    """
    if filled is not None:
        ids = X.strings(list(lexicon.signatures))
        closed = F.transform("filled", lambda t: (F.array_position(ids, t) - 1).cast("int"))
        headers = salted_lookup(headers.select("file_id", "source", "src_pos"), filled.select("file_id", closed.alias("closed")),
                                "file_id", F.col("source"))
    return complete(taken_targets(headers, scored, lexicon, threshold), lexicon, ("ambiguous",) if flags else ())


def taken_targets(headers: DataFrame, scored: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """(file_id, taken), a row per file: the targets that got a source, as (sig_pos, source, score, ambiguous).

    Candidates are taken in one fixed order (clear sources by score; then each ambiguous source in the order of its
    best pair, by score with grammar bonus), skipping used sources and targets. At most 25 sources can be taken by other
    targets, so in that order only the first 26 sources of a target can ever win it: the rest are dropped before
    the per-file fold, which therefore sees at most 26 x 26 candidates however many headers a file has.

    Rows move twice: by text, where they meet their candidates, and by file, where candidates are ranked and folded. A
    column ``closed`` (array<int>) of the headers holds the signatures that are not on offer in the file.
    """
    n = len(lexicon.signatures)
    # Ranks and bonuses depend on the text alone, so they are worked out once per distinct text.
    ranked = computed_here(scored.select("source", "candidates"), "ranked", ranked_candidates(threshold, lambda c: (
        c["score"] + grammar_bonus(F.col("source"), c["sig_pos"], lexicon)).alias("raised"))).drop("candidates")
    also = [c for c in headers.columns if c == "closed"]
    joined = placed_sources(headers, ranked, *also)
    if also:
        joined = joined.withColumn("ranked", F.filter("ranked", lambda c: ~F.coalesce(F.array_contains("closed", c["sig_pos"]), F.lit(False))))
    none = F.array().cast("array<struct<minus:double,sig_pos:int,score:double,raised:double>>")
    rows = with_rivals(joined.withColumn("ranked", F.coalesce("ranked", none))).select(
        "file_id", "source", "src_pos", "ambiguous", "top", F.explode_outer("ranked").alias("c"))
    late = F.col("ambiguous")
    key = ["late", "lead", "src_pos", "adjusted", "minus", "sig_pos"]
    rows = rows.select(
        "file_id", F.when(F.col("c").isNotNull(), F.col("source")).alias("source"), "src_pos", late.alias("late"),
        F.col("c.sig_pos").alias("sig_pos"), F.col("c.minus").alias("minus"),
        F.when(late, -F.col("top")).otherwise(F.col("c.minus")).alias("lead"),
        F.when(late, -F.col("c.raised")).otherwise(F.lit(0.0)).alias("adjusted")).repartition("file_id")
    place = F.row_number().over(W.partitionBy("file_id", "sig_pos").orderBy(*key[:-1]))
    bounded = rows.withColumn("_place", place).where(F.col("_place") <= n)

    item = "struct<sig_pos:int,source:string,score:double,ambiguous:boolean>"
    listed = bounded.groupBy("file_id").agg(F.sort_array(F.collect_list(
        F.when(F.col("sig_pos").isNotNull(), F.struct(F.struct(*key).alias("key"), "source")))).alias("ordered"))

    def take(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda t: (t["sig_pos"] == x["key"]["sig_pos"]) | (t["source"] == x["source"]))
        final = F.when(x["key"]["late"], -x["key"]["adjusted"]).otherwise(-x["key"]["minus"])
        pick = F.struct(x["key"]["sig_pos"].alias("sig_pos"), x["source"].alias("source"), final.alias("score"),
                        x["key"]["late"].alias("ambiguous"))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(pick)))

    # Folded after the aggregate: as a part of its result the fold takes several times as long.
    files = computed_here(listed, "taken", F.aggregate("ordered", F.array().cast(f"array<{item}>"), take))
    return files.select("file_id", "taken")


def complete(files: DataFrame, lexicon: Lexicon, more: tuple[str, ...] = ()) -> DataFrame:
    """All targets for every file, with empty sources and 0 where nothing was taken; ``taken`` is an array.

    ``more`` names fields of ``taken`` that become columns; a flag is false where nothing was taken.
    """
    position = {t: i for i, t in enumerate(lexicon.signatures)}
    slots = F.expr("array(" + ", ".join(
        f"named_struct('target_pos', {i}, 'target_id', {X.sql_text(t.target_id)}, 'sig_pos', {position.get(t.target_id, -1)})"
        for i, t in enumerate(lexicon.targets)) + ")")
    names = ["source", "score", *more]
    rows = files.select("file_id", F.col("taken.sig_pos").alias("at"), *[F.col(f"taken.{c}").alias(c) for c in names], F.explode(slots).alias("slot"))
    found = F.array_position("at", F.col("slot.sig_pos"))
    rows = rows.select("file_id", "slot", found.alias("found"), *[F.get(c, (found - 1).cast("int")).alias(c) for c in names])
    hit = F.col("found") > 0
    return rows.select(
        "file_id", "slot.target_pos", "slot.target_id",
        F.when(hit, F.array("source")).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"),
        *[F.coalesce(c, F.lit(False)).alias(c) if c == "ambiguous" else F.col(c) for c in more])


def match_log(mapping: DataFrame, scored: DataFrame, lexicon: Lexicon) -> DataFrame:
    """How each mapped pair came about: token stages, what became of each token, and the sums."""
    position = F.expr(f"map_from_arrays({X.sql_strings(list(lexicon.signatures))}, sequence(0, {len(lexicon.signatures) - 1}))")
    pairs = mapping.where(F.size("sources") > 0).select(
        "file_id", "target_pos", "target_id", "confidence", F.get("sources", F.lit(0)).alias("source"))
    joined = salted_lookup(pairs, scored.select("source", "tokens", "lemmas", "kept"), "source", F.col("file_id"))
    signature = F.get(X.signature_literal(lexicon), F.try_element_at(position, F.col("target_id")))
    outcomes = bind(signature, lambda sig: F.transform(X.weighted(F.col("kept"), lexicon), lambda t: F.struct(
        t["token"].alias("token"), X.token_outcome(t, sig).alias("result"))))
    rows = joined.withColumn("signature", signature).withColumn("outcomes", outcomes)

    def total(name):
        return F.aggregate("outcomes", F.lit(0.0), lambda s, o: s + o["result"][name])

    return rows.select("file_id", "target_pos", "target_id", "source", "confidence", "tokens", "lemmas", "kept",
                       F.col("signature.total").alias("target_weight"), total("added").alias("input_weight"),
                       total("matched").alias("matched_weight"), F.transform("outcomes", lambda o: F.struct(
                           o["token"].alias("token"), o["result"]["outcome"].alias("outcome"),
                           o["result"]["against"].alias("against"),
                           o["result"]["similarity"].alias("similarity"))).alias("outcomes"))


def suggest(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best targets of every header, with their place; pairs that came with one need not move."""
    if "place" in pairs.columns:
        return pairs.where(F.col("place") <= k)
    order = W.partitionBy("file_id", "source").orderBy(F.desc("score"), "sig_pos")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
