"""Known-name ratios: across the leading cells of a row, down the first column, or over a whole row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import half_up, leading_block
from ..lexicon import Lexicon
from .common import salted_lookup, stored

VERTICAL_ROWS = 200


def _percent(matches: Column, cells: Column) -> Column:
    return F.when(cells == 0, F.lit(0)).otherwise(half_up(matches / cells * 100))


def mark_known(rows: DataFrame, keys: str, aliases: Lexicon | DataFrame, out: str) -> DataFrame:
    """Add ``out``: for each key of the array column ``keys``, whether it is a known name.

    A lexicon sits in the plan and is tested in place. An alias table is joined: the rows are written once; their
    distinct keys meet the table, so a name in every row is looked up once; rows then collect their known keys through a
    salted lookup. ``rows`` must be unique by (file_id, row_idx).
    """
    if isinstance(aliases, Lexicon):
        known = aliases.keywords or [""]
        return rows.withColumn(out, F.transform(keys, lambda k: F.coalesce(k.isin(known), F.lit(False))))
    rows = stored(rows, "keyword-rows")
    names = aliases.select(F.lower("alias").alias("_key")).distinct()
    cells = rows.select("file_id", "row_idx", F.explode(F.array_distinct(keys)).alias("_key")).where("_key is not null")
    found = cells.select("_key").distinct().join(names, "_key", "left_semi")
    hits = (salted_lookup(cells, found, "_key", F.xxhash64("file_id", "row_idx"), "inner").groupBy("file_id", "row_idx")
            .agg(F.collect_set("_key").alias("_hits")))
    joined = rows.join(hits, ["file_id", "row_idx"], "left")
    return joined.withColumn(out, F.transform(keys, lambda k: F.coalesce(
        F.array_contains("_hits", k), F.lit(False)))).drop("_hits")


def count_true(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda f: f))


def leading_keyword_columns(rows: DataFrame, aliases: Lexicon | DataFrame) -> DataFrame:
    """Add ``block`` (cells before the first gap), ``keyword_matches`` in it and ``keyword_score``."""
    marked = mark_known(rows.withColumn("block", leading_block(F.col("types"))), "keys", aliases, "_known")
    return (marked.withColumn("keyword_matches", count_true(F.slice("_known", F.lit(1), F.col("block"))))
            .withColumn("keyword_score", _percent(F.col("keyword_matches"), F.col("block"))).drop("_known"))


def row_keyword_columns(rows: DataFrame, aliases: Lexicon | DataFrame) -> DataFrame:
    """Older form: matches over all filled cells of the row."""
    marked = mark_known(rows, "keys", aliases, "_known")
    return (marked.withColumn("keyword_matches", count_true(F.col("_known")))
            .withColumn("keyword_score", _percent(F.col("keyword_matches"), F.col("filled"))).drop("_known"))


def score_keywords(grid: DataFrame, aliases: Lexicon | DataFrame) -> DataFrame:
    """Keyword ratio of every row: (file_id, row_idx, block, keyword_matches, keyword_score)."""
    from .structure import typed_rows
    return leading_keyword_columns(typed_rows(grid), aliases).select(
        "file_id", "row_idx", "block", "keyword_matches", "keyword_score")


def vertical_columns(rows: DataFrame, aliases: Lexicon | DataFrame) -> DataFrame:
    """Add the first-column ratio from ``header_row`` down.

    ``first_column`` is the array of first-cell keys of the file's sample in row order (at most ``VERTICAL_ROWS`` long
    from the header on). The block ends at the first empty cell; the ratio is over that block, and a table counts as
    pivoted when at least half its labels are known and none repeats.
    """
    from_header = F.slice("first_column", F.col("header_row") + 1, F.lit(VERTICAL_ROWS))
    marked = rows.withColumn("_down", F.when(F.col("header_row") >= 0, from_header))
    marked = marked.withColumn("_down", F.slice("_down", F.lit(1), leading_block(F.col("_down"))))
    marked = mark_known(marked, "_down", aliases, "_known")
    return (marked
            .withColumn("vertical_cells", F.size("_down"))
            .withColumn("vertical_matches", count_true(F.col("_known")))
            .withColumn("vertical_repeats", F.size("_down") - F.size(F.array_distinct("_down")))
            .withColumn("vertical_score", _percent(F.col("vertical_matches"), F.col("vertical_cells")))
            .withColumn("vertical_pivot", (F.col("vertical_score") >= 50) & (F.col("vertical_repeats") == 0))
            .drop("_down", "_known"))
