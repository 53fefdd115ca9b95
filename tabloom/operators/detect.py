"""Header row detection, re-scoring of a chosen row, previews and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import confidence_state, header_names, readability, row_keys, row_types
from ..lexicon import Lexicon
from .keywords import leading_keyword_columns, vertical_columns
from .structure import SAMPLE_ROWS, head_sample, score_breakdown, score_rows

CONFIDENT = 50
PAGE_ROWS = 15

_PICK = ["row_idx", "cells", "score", "filled", "numeric_cells", "width", "base", "after_numeric", "data_below"]


def first_keys() -> Column:
    """First-cell keys of a file's sample in row order; aggregate, at most ``sample_rows`` long."""
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "first_key")))
    return F.transform(ordered, lambda r: r["first_key"])


def _scored(grid: DataFrame, sample_rows: int, carry: tuple[str, ...]) -> DataFrame:
    return (score_rows(grid, sample_rows, keep=("cells", "keys", *carry))
            .withColumn("first_key", F.get("keys", F.lit(0))).drop("keys"))


def _keyword_layer(files: DataFrame, aliases: Lexicon | DataFrame) -> DataFrame:
    return leading_keyword_columns(
        files.withColumn("types", row_types(F.col("cells"))).withColumn("keys", row_keys(F.col("cells"))), aliases)


def best_rows(scored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per file the highest score, earliest on ties; the last row never stands.

    Keeps the hash partitioning that scoring already made, so no further shuffle.
    """
    candidate = F.col("row_idx") < F.col("last_row")
    picked = F.struct(*_PICK, *carry)
    return scored.groupBy("file_id").agg(
        F.max_by(F.when(candidate, picked), F.when(candidate, F.struct(
            F.col("score").alias("s"), (-F.col("row_idx")).alias("r")))).alias("best"),
        first_keys().alias("first_column"))


def detect_headers(grid: DataFrame, aliases: Lexicon | DataFrame, sample_rows: int = SAMPLE_ROWS,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: the header row, its names and how sure we are.

    Three layers: structural score of every sampled row, keyword ratio of the winner, and, only when the first is at
    least 50 and the second below 50, the first-column check for pivoted sheets. A file without a usable row gets
    index -1 and no names. ``readability`` says whether the header row can be read: ``blocking`` where there is none or
    all its cells are blank, ``recoverable`` where some hold unreadable characters. ``carry`` names grid columns (such as ``line_no``) to keep for the winning row.
    """
    files = (best_rows(_scored(grid, sample_rows, carry), carry)
             .select("file_id", "first_column", "best.*")
             .withColumn("usable", F.coalesce(F.size("cells") > 0, F.lit(False)))
             .withColumn("header_row", F.when(F.col("usable"), F.col("row_idx")).otherwise(F.lit(-1)).cast("int"))
             .withColumn("cells", F.when(F.col("usable"), F.col("cells")).otherwise(F.array().cast("array<string>"))))
    files = vertical_columns(_keyword_layer(files, aliases), aliases)
    doubtful = F.col("usable") & (F.col("score") >= CONFIDENT) & (F.col("keyword_score") < CONFIDENT)
    return files.select(
        "file_id",
        F.col("header_row").alias("header_row_index"),
        header_names(F.col("cells")).alias("headers"),
        F.when(F.col("usable"), F.col("score")).otherwise(F.lit(0)).alias("confidence"),
        F.coalesce("keyword_score", F.lit(0)).alias("keyword_confidence"),
        F.coalesce("keyword_matches", F.lit(0)).alias("keyword_matches"),
        F.coalesce("block", F.lit(0)).alias("keyword_cells"),
        F.when(doubtful, F.col("vertical_score")).alias("vertical_keyword_score"),
        F.when(doubtful, F.col("vertical_pivot")).otherwise(F.lit(False)).alias("is_pivoted"),
        F.when(F.col("usable"), score_breakdown()).alias("breakdown"),
        readability(F.col("cells")).alias("readability"),
        *carry,
    ).withColumn("state", confidence_state(F.col("confidence"), F.col("is_pivoted")))


def score_choice(grid: DataFrame, choices: DataFrame, aliases: Lexicon | DataFrame,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All three layers for a row a person picked; ``choices`` is (file_id, row_idx), one per file.

    The pivot check runs whenever the keyword ratio is below 50, whatever the structural score. A choice outside the file
    gives nulls. Only files with a choice are scored.
    """
    chosen = choices.select("file_id", F.col("row_idx").alias("chosen"))
    sampled = head_sample(grid, sample_rows).join(chosen.select("file_id"), "file_id", "left_semi")
    scored = _scored(sampled, sample_rows, ()).join(chosen, "file_id")
    hit = F.col("row_idx") == F.col("chosen")
    files = (scored.groupBy("file_id").agg(
        F.max("chosen").alias("header_row"),
        F.max_by(F.when(hit, F.struct(*_PICK)), F.when(hit, F.lit(1))).alias("best"),
        first_keys().alias("first_column")).select("file_id", "header_row", "first_column", "best.*"))
    files = vertical_columns(_keyword_layer(files, aliases), aliases)
    found = F.col("score").isNotNull()
    weak = F.col("keyword_score") < CONFIDENT
    scores = files.select(
        "file_id",
        F.when(found, header_names(F.col("cells"))).alias("headers"),
        F.col("score").alias("confidence"),
        F.when(found, F.col("keyword_score")).alias("keyword_confidence"),
        F.when(found, F.when(weak, F.col("vertical_score")).otherwise(F.lit(0))).alias("vertical_keyword_score"),
        F.when(found, F.when(weak, F.col("vertical_pivot")).otherwise(F.lit(False))).alias("is_pivoted"),
        F.when(found, score_breakdown()).alias("structural_breakdown"),
        F.when(found, F.col("keyword_matches")).alias("keyword_matches"),
        F.when(found, F.col("block")).alias("keyword_cells"))
    return chosen.withColumnRenamed("chosen", "row_idx").join(scores, "file_id", "left")


def explain_choice(scores: DataFrame) -> DataFrame:
    """The list a reviewer sees: structural parts, their total, then the keyword part."""
    def part(name, score):
        return F.struct(name.alias("name"), score.cast("int").alias("score"))

    # The wording of the parts.
    total = F.array(part(F.lit("---"), F.lit(0)), part(F.lit("Total Structural %"), F.col("confidence")))
    keyword = F.when(F.col("keyword_cells") > 0, F.array(
        part(F.lit("---"), F.lit(0)),
        part(F.concat(F.lit("Contiguous Keyword Matches ("), F.col("keyword_matches").cast("string"), F.lit("/"),
                      F.col("keyword_cells").cast("string"), F.lit(")")), F.col("keyword_confidence")))).otherwise(
        F.array().cast("array<struct<name:string,score:int>>"))
    usable = F.size("headers") > 0
    return scores.select("file_id", "row_idx", F.when(
        usable, F.concat("structural_breakdown", total, keyword)).alias("breakdown"))


def header_list(detected: DataFrame) -> DataFrame:
    """Detected names as (file_id, src_pos, source)."""
    return detected.select("file_id", F.posexplode("headers").alias("src_pos", "source"))


def preview_rows(grid: DataFrame, header_rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Header row and the two after it within the sample, labelled; ``header_rows`` is (file_id, header_row_index)."""
    wanted = header_rows.where(F.col("header_row_index") >= 0).select("file_id", F.explode(F.array(*[
        F.struct((F.col("header_row_index") + k).cast("long").alias("row_idx"), F.lit(label).alias("label"))
        for k, label in enumerate(("Header Row", "Data Row 1", "Data Row 2"))])).alias("w"))
    wanted = wanted.select("file_id", "w.row_idx", "w.label")
    return head_sample(grid, sample_rows).join(wanted, ["file_id", "row_idx"]).select(
        "file_id", "row_idx", "label", "cells")


def page_rows(grid: DataFrame, page_size: int = PAGE_ROWS) -> DataFrame:
    """Page number and slot of each row."""
    return grid.select("file_id", "row_idx", F.floor(F.col("row_idx") / page_size).cast("int").alias("page"),
                       (F.col("row_idx") % page_size).cast("int").alias("slot"), "cells")


def sheet_profile(grid: DataFrame, head: int = 5) -> DataFrame:
    """Rows per file and the first few of them; only head rows are collected."""
    first = F.array_sort(F.collect_list(F.when(F.col("row_idx") < head, F.struct("row_idx", "cells"))))
    return grid.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.transform(first, lambda r: r["cells"]).alias("first_rows"))
