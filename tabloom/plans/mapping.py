"""Whole mapping jobs: choose a matcher, fall back to the next, reuse what was confirmed before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fingerprint
from ..lexicon import Lexicon
from ..operators.common import salted_lookup, stored
from ..operators.detect import detect_headers, header_list
from ..operators.lexical import alias_match
from ..operators.matching import assign, complete, score_sources, taken_targets
from ..operators.reshape import reshape
from ..operators.review import complete_mapping

APP_THRESHOLD = 0.4


def map_headers(headers: DataFrame, lexicon: Lexicon, threshold: float = 0.5, mode: str = "standard",
                files: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Map (file_id, src_pos, source) to the targets; ``mode`` is ``standard`` or ``deep``.

    In deep mode ``vocabulary`` (word, vocab_pos) is a table of words to cut by, in place of the lexicon's.

    Files without any name have no rows in ``headers``; with ``files`` (file_id) they get all targets too, empty.
    """
    mapping = assign(headers, score_sources(headers, lexicon, mode, vocabulary), lexicon, threshold)
    return mapping if files is None else complete_mapping(mapping, files, lexicon)


def score_with(matcher: str, headers: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(source, candidates) from any matcher; ``alias`` gives at most one candidate per header."""
    if matcher != "alias":
        return score_sources(headers, lexicon, matcher).select("source", "candidates")
    found = alias_match(headers, lexicon.alias_table(headers.sparkSession))
    position = F.map_from_arrays(F.array(*[F.lit(t) for t in lexicon.signatures]),
                                 F.array(*[F.lit(i) for i in range(len(lexicon.signatures))]))
    one = F.struct(F.try_element_at(position, F.col("target_id")).alias("sig_pos"), F.col("score").alias("score"))
    return found.where("target_id is not null").select("source", F.array(one).alias("candidates"))


def map_with_fallback(headers: DataFrame, lexicon: Lexicon, matchers: Sequence[str] = ("standard", "deep", "alias"),
                      threshold: float = 0.5, sure: float = 0.0, ambiguous: bool = False) -> DataFrame:
    """Run matchers in turn; adds ``matcher`` to the mapping.

    A file goes on to the next matcher when a mandatory target is empty, when a pair is less than ``sure``, or, with
    ``ambiguous``, when a pair's header had a close rival target. Pairs that are sure stay: the next matcher sees only
    the other headers and targets. A pair that is not sure comes back where that matcher places neither its target nor
    its header. Between matchers a file is one row with the pairs it has, which is written once, as are the headers that
    go on; the 26 rows of a file are made at the end.
    """
    result, todo = None, headers
    for step, matcher in enumerate(matchers):
        got = taken_targets(todo, score_with(matcher, todo, lexicon), lexicon, threshold).select("file_id", F.transform(
            "taken", lambda t: t.withField("matcher", F.lit(matcher))).alias("taken"))
        if result is not None:
            got = _combined(result, got, sure, ambiguous)
        if step == len(matchers) - 1:
            return complete(got, lexicon, ("matcher",))
        result = stored(got, "mapping")
        todo = stored(_still_open(headers, result, lexicon, sure, ambiguous), "still-open")


def _settled(t: Column, sure: float, ambiguous: bool) -> Column:
    fine = t["score"] >= sure
    return fine & ~t["ambiguous"] if ambiguous else fine


def _still_open(headers: DataFrame, result: DataFrame, lexicon: Lexicon, sure: float, ambiguous: bool) -> DataFrame:
    """The headers of files that go on, less those of settled pairs, with the signatures ``closed`` to them."""
    position = {t: i for i, t in enumerate(lexicon.signatures)}
    required = F.array(*[F.lit(position.get(t.target_id, -1)) for t in lexicon.targets if t.required]).cast("array<int>")
    settled = F.filter("taken", lambda t: _settled(t, sure, ambiguous))
    wanting = (F.size(F.array_except(required, F.col("taken.sig_pos"))) > 0) | (F.size("taken") > F.size(settled))
    files = result.where(wanting).select("file_id", settled.alias("settled")).select(
        "file_id", F.col("settled.sig_pos").alias("closed"), F.col("settled.source").alias("held"))
    rows = salted_lookup(headers.select("file_id", "src_pos", "source"), files, "file_id", F.col("source"), "inner")
    return rows.where(~F.coalesce(F.array_contains("held", F.col("source")), F.lit(False))).drop("held")


def _combined(result: DataFrame, later: DataFrame, sure: float, ambiguous: bool) -> DataFrame:
    both = result.join(later.withColumnRenamed("taken", "new"), "file_id", "left")
    new = F.coalesce("new", F.filter("taken", lambda _: F.lit(False)))
    both = both.withColumn("new", new).withColumn("at", F.col("new.sig_pos")).withColumn("placed", F.col("new.source"))
    old = F.filter("taken", lambda t: _settled(t, sure, ambiguous) | ~(
        F.array_contains("at", t["sig_pos"]) | F.array_contains("placed", t["source"])))
    closed = F.transform(F.filter("taken", lambda t: _settled(t, sure, ambiguous)), lambda t: t["sig_pos"])
    more = F.filter("new", lambda t: ~F.array_contains("closed", t["sig_pos"]))
    return both.withColumn("closed", closed).select("file_id", F.concat(old, more).alias("taken"))


# --- reuse of confirmed mappings ---

def with_fingerprint(detected: DataFrame) -> DataFrame:
    """Detected files with the hash of their header layout."""
    return detected.withColumn("fingerprint", fingerprint(F.col("headers")))


def confirmed_profiles(mapping: DataFrame, detected: DataFrame, saved_at, client_id: str = "") -> DataFrame:
    """Confirmed mappings as profiles (client_id, fingerprint, slots, saved_at).

    A slot stores column positions, so it fits any file with the same layout even if names differ in case or spacing.
    """
    per_file = mapping.where(F.size("sources") > 0).groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("target_pos", "target_id", "sources", "confidence"))).alias("filled"))
    rows = with_fingerprint(detected).select("file_id", "fingerprint", "headers").join(per_file, "file_id")
    slots = F.transform("filled", lambda s: F.struct(
        s["target_pos"].alias("target_pos"), s["target_id"].alias("target_id"),
        F.transform(s["sources"], lambda n: (F.array_position("headers", n) - 1).cast("int")).alias("columns"),
        s["confidence"].alias("confidence")))
    # Files of one layout agree up to their text; the first file id settles which one is kept.
    picked = rows.groupBy("fingerprint").agg(F.min_by(slots, "file_id").alias("slots"))
    return picked.select(F.lit(client_id).alias("client_id"), "fingerprint", "slots",
                         F.lit(saved_at).cast("timestamp").alias("saved_at"))


def save_profiles(profiles: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Profiles with newer ones replacing older ones of the same client and layout."""
    return profiles.unionByName(confirmed).groupBy("client_id", "fingerprint").agg(
        F.max_by("slots", "saved_at").alias("slots"), F.max("saved_at").alias("saved_at"))


def cache_hits(detected: DataFrame, profiles: DataFrame, client_id: str = "") -> DataFrame:
    """Detected files with their fingerprint and the slots of a matching profile, null when there is none."""
    own = profiles.where(F.col("client_id") == client_id).select("fingerprint", "slots")
    return salted_lookup(with_fingerprint(detected), own, "fingerprint", F.col("file_id"))


def reuse_or_map(detected: DataFrame, profiles: DataFrame, lexicon: Lexicon, threshold: float = 0.5,
                 mode: str = "standard", client_id: str = "") -> DataFrame:
    """Mapping per file, from a stored profile where the layout is known, else worked out; ``reused`` says which."""
    found = cache_hits(detected, profiles, client_id).where("header_row_index >= 0")
    wanted = F.array(*[F.struct(F.lit(i).alias("target_pos"), F.lit(t.target_id).alias("target_id"))
                       for i, t in enumerate(lexicon.targets)])
    hits = found.where("slots is not null").select("file_id", "headers", "slots", F.explode(wanted).alias("w"))
    slot = F.get(F.filter("slots", lambda s: s["target_id"] == F.col("w.target_id")), F.lit(0))
    reused = hits.withColumn("slot", slot).select(
        "file_id", "w.target_pos", "w.target_id",
        F.coalesce(F.transform("slot.columns", lambda c: F.get("headers", c)),
                   F.array().cast("array<string>")).alias("sources"),
        F.coalesce("slot.confidence", F.lit(0.0)).alias("confidence"), F.lit(True).alias("reused"))
    fresh = map_headers(header_list(found.where("slots is null")), lexicon, threshold, mode)
    return reused.unionByName(fresh.withColumn("reused", F.lit(False)))


def onboard(grid: DataFrame, lexicon: Lexicon, threshold: float = APP_THRESHOLD, mode: str = "standard") -> DataFrame:
    """Raw grids to typed rows: detect, map, reshape. Files without a confident header are left out.

    The detections (one row per file) are written once: mapping and reshaping both read them.
    """
    detected = stored(detect_headers(grid, lexicon), "detected").where("state = 'confident'")
    return reshape(grid, detected, map_headers(header_list(detected), lexicon, threshold, mode), lexicon)
