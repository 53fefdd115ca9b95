"""Alias matching in two passes: exact phrase, then trigram overlap and ranked word search on the rest.

Each distinct header is looked up once. Postings (trigram -> aliases, word -> documents) come from the alias table,
which is the size of a dictionary; they are joined on the posting key and Spark picks the join by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X
from .common import computed_here, range_rank, salted_lookup, stored


def alias_keys(aliases: DataFrame) -> DataFrame:
    """The alias table with its cleansed phrases, worked out once."""
    return aliases.withColumn("cleansed", X.cleanse(F.col("alias"))).withColumn(
        "target_id", F.replace("target_key", F.lit(" "), F.lit("_")))


def exact_matches(sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, target_id): cleansed texts equal; the first dictionary key wins."""
    first = alias_keys(aliases).groupBy("cleansed").agg(F.min_by("target_id", "key_pos").alias("target_id"))
    distinct = computed_here(sources.select("source").distinct(), "cleansed", X.cleanse(F.col("source")))
    return distinct.join(first, "cleansed").select("source", "target_id")


#: Similarities at which headers are looked for in turn; a header found at one is not looked for at the next.
BARS = (0.5, 0.2, 0.0)


def rare_first(rows: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """The ``grams`` of each row in order of their frequency among the aliases, rarest first (then by text)."""
    grams = rows.select(*keys, F.explode("grams").alias("gram"))
    counted = salted_lookup(grams, frequency, "gram", F.xxhash64(*keys))
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))
    return counted.groupBy(*keys).agg(order.alias("o")).select(*keys, F.col("o.gram").alias("grams"))


def gram_candidates(sources: DataFrame, aliases: DataFrame, bar: float) -> DataFrame:
    """(source, key_pos, alias_pos) of all pairs whose trigrams can reach the similarity ``bar``.

    Two sets of sizes a and b that reach it share ``bar`` times the larger at least, so one of the rarest
    a - ceil(bar * a) + 1 trigrams of the one is among those of the other, and the sizes differ by ``bar`` at most. The
    rarest one they share leaves as many as come after it in both. Common trigrams are last in every set, so they are
    joined on only where nothing rarer is left.
    """
    def rarest(rows: DataFrame, size: str, *names: str) -> DataFrame:
        n = F.size("grams")
        most = n - F.ceil(n * bar - 1e-9).cast("int") + F.lit(1 if bar > 0 else 0)
        return rows.select(*names, n.alias(size), F.posexplode(F.slice("grams", F.lit(1), most)).alias(f"at_{size}", "gram"))

    met = rarest(sources, "a", "source").join(rarest(aliases, "b", "key_pos", "alias_pos"), "gram")
    left = F.least(F.col("a") - F.col("at_a"), F.col("b") - F.col("at_b"))
    near = ((F.col("b") >= F.col("a") * bar - 1e-9) & (F.col("a") >= F.col("b") * bar - 1e-9)
            & (left >= (F.col("a") + F.col("b")) * (bar / (1 + bar)) - 1e-9))
    return met.where(near).select("source", "key_pos", "alias_pos").distinct()


def trigram_matches(sources: DataFrame, aliases: DataFrame, bars: tuple[float, ...] = BARS) -> DataFrame:
    """(source, target_id, alias, similarity): the alias sharing most trigrams; dictionary order breaks ties.

    The best alias at or above a bar is the best of all, so most headers are done at the first one; headers whose best
    is below the last of ``bars`` have no row.
    """
    named = alias_keys(aliases).withColumn("grams", X.trigrams(F.col("cleansed")))
    frequency = named.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    known = stored(rare_first(named, ["key_pos", "alias_pos"], frequency), "alias-grams")
    distinct = computed_here(sources.select("source").distinct(), "grams", X.trigrams(X.cleanse(F.col("source"))))
    rest = stored(rare_first(distinct, ["source"], frequency), "header-grams")
    parts = []
    for bar in bars:
        pairs = gram_candidates(rest, known, bar).join(rest, "source").join(
            known.withColumnRenamed("grams", "own"), ["key_pos", "alias_pos"])
        # Once per pair: as a plain column the filter and each use of it would intersect again.
        scored = (computed_here(pairs, "shared", F.size(F.array_intersect("grams", "own")))
                  .withColumn("similarity", F.col("shared") / (F.size("grams") + F.size("own") - F.col("shared")))
                  .where((F.col("shared") > 0) & (F.col("similarity") >= bar)))
        best = F.max(F.struct("similarity", (-F.col("key_pos")).alias("k"), (-F.col("alias_pos")).alias("a"))).alias("b")
        found = stored(scored.groupBy("source").agg(best), "trigram-best")
        parts.append(found)
        rest = rest.join(found.select("source"), "source", "left_anti")
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    picked = picked.select("source", "b.similarity", (-F.col("b.k")).alias("key_pos"), (-F.col("b.a")).alias("alias_pos"))
    return picked.join(named.select("key_pos", "alias_pos", "target_id", "alias"), ["key_pos", "alias_pos"]).select(
        "source", "target_id", "alias", "similarity")


def bm25_documents(aliases: DataFrame, per_alias: bool = False) -> DataFrame:
    """(doc_id, target_id, tokens), a row per alias: the aliases of a target are one document, or each is one."""
    doc = F.concat_ws("#", "target_id", "alias_pos") if per_alias else F.col("target_id")
    return alias_keys(aliases).select(doc.alias("doc_id"), "target_id", X.search_tokens(F.col("alias")).alias("tokens"))


def bm25_index(documents: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Postings (token, doc_id, target_id, weight) with the published Okapi weight of a token in a document.

    The tokens are written once and move as they are, by document, where words are counted and meet the length. The counts
    are written, as documents of a word and postings read them; only these move as a row per word.
    """
    documents = stored(documents, "bm25-tokens")
    lengths = documents.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("len"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    terms = documents.repartition("doc_id").select("doc_id", "target_id", F.explode("tokens").alias("token"))
    tf = terms.groupBy("doc_id", "token", "target_id").agg(F.count(F.lit(1)).alias("tf"))
    tf = stored(tf.join(lengths, "doc_id", "left"), "bm25-counts")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # Rows without an id count for their words, but are no postings.
    rows = tf.where("doc_id IS NOT NULL").join(df, "token").join(F.broadcast(totals))  # one row of totals
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    return rows.select("token", "doc_id", "target_id", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight"))


def bm25_search(sources: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """(source, doc_id, target_id, score, place): best ``k`` documents per header; weights are summed in word order."""
    distinct = sources.select("source").distinct()
    words = distinct.select("source", F.posexplode(X.search_tokens(F.col("source"))).alias("word_pos", "token"))
    return _placed(words.join(index, "token"), k)


def _placed(weights: DataFrame, k: int) -> DataFrame:
    hits = weights.groupBy("source", "doc_id", "target_id").agg(
        F.array_sort(F.collect_list(F.struct("word_pos", "weight"))).alias("w"))
    scored = hits.select("source", "doc_id", "target_id", F.aggregate(
        "w", F.lit(0.0), lambda s, x: s + x["weight"]).alias("score"))
    order = W.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


#: Postings in a block.
BLOCK = 128


def bm25_blocks(index: DataFrame, size: int = BLOCK) -> DataFrame:
    """The index with ``block``: each word's postings by falling weight, ``size`` to a block; written once.

    Ranks come from ranges of (word, weight), so a word that stands in very many documents is spread over tasks.
    """
    ranked = range_rank(index, ["token"], [F.desc("weight"), F.asc("doc_id")], "rank")
    return stored(ranked.withColumn("block", F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank"), "bm25-blocks")


def open_blocks(terms: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(source, token, block): the blocks of a header's words that can hold one of its best ``k`` documents.

    ``terms`` is (source, token, times). The first blocks alone give each header ``k`` documents with a score they reach at
    least; the last of these scores is its bar. A header's words are put in order of what they can add, the most first, and a
    document is looked for by the first of them it holds: it scores at most the best weight of that block and the best weights
    of the words after it. Where that is below the bar, the block is closed; of the most frequent words often all are.
    """
    spread = F.xxhash64("source")
    tops = stored(blocks.groupBy("token", "block").agg(F.max("weight").alias("top")), "block-tops")
    most = tops.where("block = 0").select("token", F.col("top").alias("most"))
    known = stored(salted_lookup(terms, most, "token", spread, "inner"), "known-terms")
    first = salted_lookup(known, blocks.where("block = 0").select("token", "doc_id", "weight"), "token", spread, "inner")
    partial = first.groupBy("source", "doc_id").agg(F.sum(F.col("times") * F.col("weight")).alias("s"))
    placed = partial.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("s")))).where(F.col("place") <= k)
    bar = placed.groupBy("source").agg(F.when(F.count(F.lit(1)) == k, F.min("s")).otherwise(F.lit(0.0)).alias("bar"))
    adds = F.col("times") * F.col("most")
    later = W.partitionBy("source").orderBy(F.desc(adds), "token").rowsBetween(1, W.unboundedFollowing)  # the words of one header
    weighed = known.withColumn("later", F.coalesce(F.sum(adds).over(later), F.lit(0.0))).join(bar, "source")
    reach = F.col("times") * F.col("top") + F.col("later")
    return salted_lookup(weighed, tops, "token", spread, "inner").where(reach >= F.col("bar") * (1 - 1e-9)).select("source", "token", "block")


def bm25_search_blocks(sources: DataFrame, blocks: DataFrame, k: int = 10) -> DataFrame:
    """What ``bm25_search`` gives, from the blocks that can matter; only documents met there are scored in full.

    Headers and their words go by numbers, and only postings of words asked for are moved. A document's weights come as
    one map, so a pair of header and document is one narrow row: it is scored where it meets the map, and a row per word of
    the header is never made.
    """
    distinct = stored(sources.select("source").distinct().withColumn("id", F.monotonically_increasing_id()), "search-sources")
    words = stored(distinct.select("id", F.posexplode(X.search_tokens(F.col("source"))).alias("word_pos", "token")), "search-words")
    known = stored(words.select("token").distinct().withColumn("word_id", F.monotonically_increasing_id()), "asked-words")
    terms = words.groupBy(F.col("id").alias("source"), "token").agg(F.count(F.lit(1)).alias("times"))
    opened = open_blocks(terms, blocks, k).withColumnRenamed("source", "id")
    own = blocks.join(known, "token")
    met = opened.join(own.select("token", "block", "doc_id"), ["token", "block"]).select("id", "doc_id").distinct()
    weights = own.groupBy("doc_id", "target_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "weight"))).alias("weights"))
    asked = words.join(known, "token").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("word_pos", "word_id"))).alias("asked"))
    pairs = salted_lookup(met.join(weights, "doc_id"), asked, "id", F.xxhash64("doc_id"), "inner")
    score = F.aggregate("asked", F.lit(0.0), lambda s, a: s + F.coalesce(F.try_element_at("weights", a["word_id"]), F.lit(0.0)))
    order = W.partitionBy("id").orderBy(F.desc("score"), "doc_id")
    # Documents of a repeated id that hold none of the words score 0 and are no hits.
    hits = F.exists("asked", lambda a: F.map_contains_key("weights", a["word_id"]))
    scored = pairs.where(hits).select("id", "doc_id", "target_id", score.alias("score"))
    placed = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.join(distinct, "id").select("source", "doc_id", "target_id", "score", "place")


def alias_match(sources: DataFrame, aliases: DataFrame, min_similarity: float = 0.5, k1: float = 1.2,
                b: float = 0.75) -> DataFrame:
    """Two passes over distinct headers, which are written once for all branches: (source, target_id, method, score, bm25_target_id, bm25_score).

    Exact hits score 1. The rest take the best trigram alias when it reaches ``min_similarity`` (else no target), with the
    best ranked-search document beside it.
    """
    distinct = stored(sources.select("source").distinct(), "headers")
    exact = stored(exact_matches(distinct, aliases), "exact")
    rest = stored(distinct.join(exact.select("source"), "source", "left_anti"), "rest")
    grams = trigram_matches(rest, aliases)
    ranked = bm25_search(rest, bm25_index(bm25_documents(aliases), k1, b), 1)
    lexical = (rest.join(grams, "source", "left")
               .join(ranked.select("source", F.col("target_id").alias("bm25_target_id"),
                                   F.col("score").alias("bm25_score")), "source", "left"))
    sure = F.col("similarity") >= min_similarity
    return exact.select("source", "target_id", F.lit("exact").alias("method"), F.lit(1.0).alias("score"),
                        F.lit(None).cast("string").alias("bm25_target_id"),
                        F.lit(None).cast("double").alias("bm25_score")).unionByName(lexical.select(
                            "source", F.when(sure, F.col("target_id")).alias("target_id"),
                            F.when(sure, "trigram").otherwise("none").alias("method"),
                            F.coalesce("similarity", F.lit(0.0)).alias("score"), "bm25_target_id", "bm25_score"))
