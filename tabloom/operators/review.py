"""Review of a mapping: edits, badges, statistics, availability, reports and checks.

A mapping is (file_id, target_pos, target_id, sources array<string>, confidence), one row per file and target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import percent_text, review_badge
from ..lexicon import Lexicon
from .common import computed_here, salt_count

EDIT_RANGE = 4096
INITIAL_PLACE = 1 << 40


def complete_mapping(mapping: DataFrame, files: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Every target for every file of ``files``; absent ones get no sources and confidence 0."""
    slots = F.array(*[F.struct(F.lit(i).alias("target_pos"), F.lit(t.target_id).alias("target_id"))
                      for i, t in enumerate(lexicon.targets)])
    # Both sides meet as one row per file: a mapping that is dealt by file stays where it is.
    found = mapping.groupBy("file_id").agg(F.collect_list(F.struct("target_id", "sources", "confidence")).alias("found"))
    wanted = files.select("file_id").distinct().join(found, "file_id", "left").select("file_id", "found", F.explode(slots).alias("s"))
    own = F.filter("found", lambda x: x["target_id"] == F.col("s.target_id"))
    rows = wanted.select("file_id", "s.*", F.explode_outer(own).alias("own"))
    return rows.select(
        "file_id", "target_pos", "target_id",
        F.coalesce("own.sources", F.array().cast("array<string>")).alias("sources"),
        F.coalesce("own.confidence", F.lit(0.0)).alias("confidence"))


def apply_edits(mapping: DataFrame, edits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Replay edit events (file_id, seq, action, target_id, source); ``seq`` is unique per file.

    ``add`` puts a source at the end of a target unless it is in use anywhere in the file; ``remove`` takes it out;
    ``clear`` empties all. Confidences stay.

    A source sits in one target or none and no event touches two sources, so each (file, source) is replayed alone, from
    the file's last ``clear`` on. Long histories are cut into ranges of ``seq``; a range turns into a table "state before
    -> state after" of the targets it names, as it leaves any other holder alone, and only those tables are chained. What is
    said of a source moves once, by file and a salt of the source.
    """
    salts = salt_count(mapping.sparkSession)
    cleared = edits.where("action = 'clear'").groupBy("file_id").agg(F.max("seq").alias("cleared"))
    clicks = edits.where("action <> 'clear' and coalesce(source, '') <> ''").select(
        "file_id", "source", F.col("seq").cast("bigint").alias("seq"), "action", "target_id", F.lit(None).cast("int").alias("place"))
    # Sources the mapping holds go with the clicks, as what came before all ranges.
    # Their file is a generated column: a filter of the last join does not go below it, so both readings of the mapping
    # stay alike and it is worked out once.
    held = computed_here(mapping, "file", F.col("file_id")).select("file", "target_id", F.posexplode("sources").alias("place", "source")).select(
        F.col("file").alias("file_id"), "source", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("action"), "target_id", "place")
    rows, key = clicks.unionByName(held), ["file_id"]
    if salts > 1:  # all that is said of a source is in one of so many parts of its file
        key = ["file_id", "_salt"]
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int"))
        cleared = cleared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    live = rows.join(cleared, key, "left").where("cleared is null or (place is null and seq > cleared)")

    def step(state: Column, e: Column) -> Column:
        free = (e["action"] == "add") & (state["holder"] == "")
        held = (e["action"] == "remove") & (state["holder"] == e["target_id"])
        return (F.when(free, F.struct(e["target_id"].alias("holder"), e["seq"].alias("at")))
                .when(held, F.struct(F.lit("").alias("holder"), e["seq"].alias("at"))).otherwise(state))

    def untouched(holder: Column) -> Column:
        return F.struct(holder.alias("holder"), F.lit(None).cast("bigint").alias("at"))

    click = F.col("place").isNull()
    events = F.sort_array(F.collect_list(F.when(click, F.struct("seq", "action", "target_id"))))
    start = F.min_by(F.struct(F.col("target_id").alias("holder"), (F.col("place") - INITIAL_PLACE).cast("bigint").alias("at")), "place")
    ranges = (live.withColumn("range", F.floor(F.col("seq") / EDIT_RANGE)).withColumn("click", click)
              .groupBy(*key, "source", "click", "range").agg(events.alias("events"), start.alias("start"))
              .withColumn("before", F.array_distinct(F.concat(F.array(F.lit("")), F.array_compact(F.col("events.target_id"))))))
    after = F.transform("before", lambda s: F.aggregate("events", untouched(s), step))
    # Folds run after their aggregates: as a part of an aggregate's result they take several times as long.
    ranges = computed_here(ranges, "after", after).select(*key, "source", "click", "range", "before", "after", "start")
    both = ranges.groupBy(*key, "source").agg(
        F.sort_array(F.collect_list(F.when(F.col("click"), F.struct("range", "before", "after")))).alias("chain"),
        F.first("start", ignorenulls=True).alias("start"))
    start = F.coalesce("start", F.struct(F.lit("").alias("holder"), F.lit(None).cast("bigint").alias("at")))

    def follow(state: Column, part: Column) -> Column:
        nxt = F.get(part["after"], (F.array_position(part["before"], state["holder"]) - 1).cast("int"))
        return F.when(nxt.isNull(), state).otherwise(F.struct(
            nxt["holder"].alias("holder"), F.coalesce(nxt["at"], state["at"]).alias("at")))

    final = computed_here(both, "end", F.aggregate("chain", start, follow))
    # Kept sources are listed per file, which the mapping is dealt by already: its rows need not move again.
    kept = final.where("end.holder <> ''").groupBy("file_id").agg(F.sort_array(F.collect_list(
        F.struct(F.col("end.at").alias("at"), F.col("end.holder").alias("holder"), "source"))).alias("kept"))
    kept = kept.withColumn("targets", F.array_distinct("kept.holder"))
    kept = computed_here(kept, "lists", F.transform("targets", lambda t: F.transform(
        F.filter("kept", lambda x: x["holder"] == t), lambda x: x["source"]))).drop("kept")
    own = F.get("lists", (F.array_position("targets", F.col("target_id")) - 1).cast("int"))
    return mapping.drop("sources").join(kept, "file_id", "left").select(
        "file_id", "target_pos", "target_id",
        F.coalesce(own, F.array().cast("array<string>")).alias("sources"), "confidence")


def review(mapping: DataFrame, lexicon: Lexicon, threshold: float = 0.4) -> DataFrame:
    """The review table: label, required flag, badge and sources of every target."""
    labels = F.array(*[F.lit(t.label) for t in lexicon.targets])
    required = F.array(*[F.lit(t.required) for t in lexicon.targets])
    return mapping.select(
        "file_id", (F.col("target_pos") + 1).alias("position"), "target_id",
        F.get(labels, F.col("target_pos")).alias("label"), F.get(required, F.col("target_pos")).alias("required"),
        "sources", "confidence", review_badge(F.size("sources"), F.col("confidence"), threshold).alias("badge"))


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Per file: targets with one source, with several, with none, and all."""
    n = F.size("sources")
    return mapping.groupBy("file_id").agg(
        F.count_if(n == 1).alias("mapped"), F.count_if(n > 1).alias("merged"),
        F.count_if(n == 0).alias("unmapped"), F.count(F.lit(1)).alias("total"))


def held_sources(mapping: DataFrame) -> DataFrame:
    """(file_id, source, target_id, position, confidence) for every source in use."""
    return mapping.select("file_id", F.explode("sources").alias("source"), "target_id",
                          (F.col("target_pos") + 1).alias("position"), "confidence")


def source_availability(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each header of a file with the target that holds it; position is null while it is free."""
    held = held_sources(mapping).groupBy("file_id", "source").agg(
        F.min_by("target_id", "position").alias("target_id"), F.min("position").alias("position"))
    distinct = headers.groupBy("file_id", "source").agg(F.min("src_pos").alias("src_pos"))
    return distinct.join(held, ["file_id", "source"], "left").select(
        "file_id", "src_pos", "source", "target_id", "position")


def unmapped_headers(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Headers that no target of their file holds (repeats count)."""
    return headers.join(held_sources(mapping).select("file_id", "source"), ["file_id", "source"], "left_anti")


def report_rows(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Long result table: mapped pairs with percent text, then unmapped headers."""
    held = held_sources(mapping).select("file_id", "source", "target_id", F.col("confidence").alias("score"), F.lit("mapped").alias("status"))
    names = headers.groupBy("file_id", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # One full join, so that the mapping is worked out once; a header without a target comes back as often as it occurs.
    both = names.join(held, ["file_id", "source"], "full")
    times = F.when(F.col("status").isNull(), F.array_repeat(F.lit(0), F.col("n"))).otherwise(F.array(F.lit(0)))
    return both.withColumn("_copy", F.explode(times)).select(
        "file_id", "source", "target_id", "score",
        F.when(F.col("status").isNotNull(), percent_text(F.col("score"), 1)).alias("percent"),
        F.coalesce("status", F.lit("unmapped")).alias("status"))


def batch_report(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per file and in total (``file_id`` null): headers, mapped targets and the share.

    The grand total is a second, tiny aggregate over per-file counts.
    """
    names = headers.groupBy("file_id").agg(F.count(F.lit(1)).alias("headers"))
    hits = mapping.groupBy("file_id").agg(F.count_if(F.size("sources") > 0).alias("mapped"))
    joined = names.join(hits, "file_id", "left").select("file_id", "headers", F.coalesce("mapped", F.lit(0)).alias("mapped"))
    totals = joined.rollup("file_id").agg(F.sum("headers").alias("headers"), F.sum("mapped").alias("mapped"))
    return totals.withColumn("share", F.round(F.col("mapped") / F.col("headers"), 4))


def missing_required(mapping: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Mandatory targets without a source."""
    required = [t.target_id for t in lexicon.targets if t.required]
    return mapping.where(F.col("target_id").isin(required) & (F.size("sources") == 0)).select("file_id", "target_id")


def collisions(pairs: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Targets that more than one header of a file would claim at or above the threshold as its best choice.

    The best target is taken per header before anything is counted per target.
    """
    best = pairs.where(F.col("score") >= threshold).groupBy("file_id", "source").agg(
        F.min_by("target_id", F.struct(-F.col("score"), F.col("sig_pos"))).alias("target_id"))
    return best.groupBy("file_id", "target_id").agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources > 1")


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """Names that occur more than once in one file."""
    return headers.groupBy("file_id", "source").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
