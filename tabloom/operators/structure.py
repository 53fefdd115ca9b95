"""Structural header score of every row of a grid.

Input grids are ``(file_id, row_idx, cells array<string>)`` with ``row_idx`` dense per file. Scoring looks at the head
of each file only (``sample_rows``, 200 by default), so every per-file window holds at most that many rows and a file
with a third of all data costs no more than any other. Rows stay whole: cells are handled inside arrays, so there is one
shuffle (on ``file_id``) and no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.cells import bind, clean, filled_type, half_up, is_typed

SAMPLE_ROWS = 200
CONTEXT_ROWS = 5


def head_sample(grid: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """First rows of each file."""
    return grid.where(F.col("row_idx") < sample_rows)


def typed_rows(grid: DataFrame) -> DataFrame:
    """Add ``types`` (null for empty cells), ``keys`` and the fill counts of each row."""
    cleaned = grid.withColumn("_clean", F.transform("cells", clean))  # once for both
    typed = cleaned.withColumn("types", F.transform("_clean", filled_type)).withColumn(
        "keys", F.transform(F.transform("_clean", F.lower), lambda k: F.nullif(k, F.lit("")))).drop("_clean")
    return typed.withColumn("filled", F.size(F.filter("types", lambda t: t.isNotNull()))).withColumn(
        "numeric_cells", F.size(F.filter("types", is_typed)))


def with_context(typed: DataFrame) -> DataFrame:
    """Add file-wide values (``width``, ``last_row``) and the types of the next five rows (``below``, nearest first)."""
    by_row = W.partitionBy("file_id").orderBy("row_idx")
    whole = by_row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # ordered alike, so one pass makes all
    following = F.array(*[F.lead("types", k).over(by_row) for k in range(1, CONTEXT_ROWS + 1)])
    return (typed
            .withColumn("below", following)
            .withColumn("data_below", F.coalesce(
                F.max("filled").over(by_row.rowsBetween(1, CONTEXT_ROWS)) > 0, F.lit(False)))
            .withColumn("width", F.greatest(F.max("filled").over(whole), F.lit(1)))
            .withColumn("last_row", F.max("row_idx").over(whole)))


def below_cell(below: Column, k: int, i: Column) -> Column:
    return F.get(F.get(below, F.lit(k)), i)


def first_type_below(below: Column, i: Column) -> Column:
    """Type of the nearest filled cell under column ``i`` within the next rows."""
    return F.coalesce(*[below_cell(below, k, i) for k in range(CONTEXT_ROWS)])


def unique_string_cells(types: Column, keys: Column, width: Column) -> Column:
    """How many text cells left of ``width`` hold a value found once in the whole row.

    Sorting puts equal values next to each other, so wide rows cost n log n.
    """
    cells = F.filter(F.transform(keys, lambda k, i: F.struct(
        k.alias("k"), i.alias("i"), F.get(types, i).alias("t"))), lambda c: c["k"].isNotNull())
    ordered = F.sort_array(cells)
    return bind(ordered, lambda o: F.size(F.filter(
        F.transform(o, lambda c, j: F.when(
            (c["t"] == "string") & (c["i"] < width)
            & ~F.coalesce((F.when(j > 0, F.get(o, j - 1)["k"])) == c["k"], F.lit(False))
            & ~F.coalesce(F.get(o, j + 1)["k"] == c["k"], F.lit(False)), F.lit(1))),
        lambda hit: hit.isNotNull())))


def column_counts(rows: DataFrame) -> DataFrame:
    """Counts over the cells left of the file width: filled, text, unique text, typed below, text below."""
    within = F.slice("types", F.lit(1), F.col("width"))
    under_text = F.transform(within, lambda t, i: F.when(t == "string", first_type_below(F.col("below"), i)))
    return (rows
            .withColumn("_in", within)
            .withColumn("_under", under_text)
            .withColumn("present", F.size(F.filter("_in", lambda t: t.isNotNull())))
            .withColumn("texts", F.size(F.filter("_in", lambda t: t == "string")))
            .withColumn("unique_texts", unique_string_cells(F.col("types"), F.col("keys"), F.col("width")))
            .withColumn("boundaries", F.size(F.filter("_under", is_typed)))
            .withColumn("consistent", F.size(F.filter("_under", lambda t: t == "string")))
            .drop("_in", "_under"))


def score_rows(grid: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sampled grid row with its structural ``score`` (0..100) and the counts behind it.

    Each filled cell earns 20; text 10 more, 10 more if unique in its row, and 60 (typed value below) or 40 (text
    below). The average over the file width is zeroed when at least half the filled cells are typed or nothing follows
    in the next five rows, and halved when any is typed.
    """
    rows = column_counts(with_context(typed_rows(head_sample(grid, sample_rows))))
    points = (20 * F.col("present") + 10 * F.col("texts") + 10 * F.col("unique_texts")
              + 60 * F.col("boundaries") + 40 * F.col("consistent"))
    numeric_share = F.col("numeric_cells") / F.nullif(F.col("filled"), F.lit(0))
    base = F.when(F.col("filled") == 0, F.lit(0.0)).otherwise(points / F.col("width"))
    after_numeric = (F.when(numeric_share >= 0.5, F.lit(0.0))
                     .when(F.col("numeric_cells") > 0, F.col("base") * 0.5).otherwise(F.col("base")))
    scored = (rows.withColumn("base", base)
              .withColumn("after_numeric", after_numeric)
              .withColumn("raw", F.when(F.col("data_below"), F.col("after_numeric")).otherwise(F.lit(0.0)))
              .withColumn("score", F.least(F.lit(100), half_up(F.col("raw")))))
    return scored.select("file_id", "row_idx", *keep, "width", "last_row", "filled", "numeric_cells", "present", "texts",
                         "unique_texts", "boundaries", "consistent", "data_below", "base", "after_numeric", "score")


def score_breakdown() -> Column:
    """Ordered (name, score) contributions behind a structural score."""
    def part(name, score):
        return F.struct(name.alias("name"), score.cast("int").alias("score"))

    # The wording of the parts.
    average = part(F.concat(F.lit("Base Average Score ("), F.col("filled").cast("string"), F.lit("/"),
                            F.col("width").cast("string"), F.lit(" cols)")), half_up(F.col("base")))
    pure = F.when((F.col("base") > 0) & (F.col("numeric_cells") / F.col("filled") >= 0.5), part(
        F.lit("Critical Penalty: Pure Data Row (0.0x)"), -half_up(F.col("base"))))
    mixed = F.when((F.col("base") > 0) & (F.col("numeric_cells") > 0)
                   & (F.col("numeric_cells") / F.col("filled") < 0.5), part(
        F.lit("Critical Penalty: Mixed Numeric Data (0.5x)"), -half_up(F.col("base") * 0.5)))
    orphan = F.when((F.col("after_numeric") > 0) & ~F.col("data_below"), part(
        F.lit("Critical Penalty: Orphan Header / No Data Below (0.0x)"), -half_up(F.col("after_numeric"))))
    return F.when(F.col("filled") > 0, F.array_compact(F.array(average, pure, mixed, orphan))).otherwise(
        F.array().cast("array<struct<name:string,score:int>>"))
