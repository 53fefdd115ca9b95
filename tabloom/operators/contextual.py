"""The two older detectors: a point system over the next rows, and its keyword-led variant.

They score all rows of a file (or the first ``sample_rows``). Rows stay whole and are shuffled once: by file and range of
RANGE rows, each range with the five rows after it, so a long file is worked on in many places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.cells import bind, clamp, clean, header_names, is_typed
from ..lexicon import Lexicon
from .keywords import row_keyword_columns
from .structure import CONTEXT_ROWS, below_cell, typed_rows

ACCEPT = 50
RANGE = 2000
PIVOT_STAGE_ROWS = 20
SERIES_CELLS = 3  # fewer number and date cells are no series, so their values are not read


def number_value(cleaned: Column, kind: Column) -> Column:
    """Numeric value of a number cell, epoch milliseconds of a date cell, else null.

    Dates are read as year-month-day or month/day/year, where a year of two digits is 1950 to 2049; other date-like
    texts have no value. Binary, octal and hexadecimal numbers are converted.
    """
    unsigned = F.substring(cleaned, F.lit(3), F.length(cleaned))
    prefix = F.lower(F.substring(cleaned, 1, 2))
    number = (F.when(prefix == "0x", F.conv(unsigned, 16, 10).cast("double"))
              .when(prefix == "0o", F.conv(unsigned, 8, 10).cast("double"))
              .when(prefix == "0b", F.conv(unsigned, 2, 10).cast("double"))
              .otherwise(cleaned.try_cast("double")))
    iso = F.regexp_extract(cleaned, "^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", 0)
    us = F.regexp_extract(cleaned, "^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$", 0)
    short = F.regexp_extract(cleaned, "^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2})$", 0)
    parts = F.split(cleaned, "[-/]")

    def epoch(year: Column, m: int, d: int) -> Column:
        text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(F.get(parts, F.lit(m)), 2, "0"),
                           F.lpad(F.get(parts, F.lit(d)), 2, "0"))
        return F.unix_date(text.try_cast("date")).cast("double") * 86400000.0

    last = F.get(parts, F.lit(2))
    full = F.concat(F.when(last >= "50", "19").otherwise("20"), last)
    date = (F.when(iso != "", epoch(F.get(parts, F.lit(0)), 1, 2)).when(us != "", epoch(last, 0, 1))
            .when(short != "", epoch(full, 0, 1)))
    return F.when(kind == "number", number).when(kind == "date", date)


def series_flag(cells: Column, types: Column) -> Column:
    """Whether the number and date cells of a row form a pivot series.

    At least three values, strictly rising or falling, and: any date cell, or steps of one, or all whole years
    1900-2100, or all whole months 1-12.
    """
    values = F.filter(F.zip_with(F.transform(cells, clean), types, number_value), lambda v: v.isNotNull())

    def judge(v: Column) -> Column:
        steps = F.transform(F.slice(v, F.lit(2), F.size(v)), lambda x, i: x - F.get(v, i))
        rising = F.forall(steps, lambda s: s > 0)
        falling = F.forall(steps, lambda s: s < 0)
        consecutive = F.forall(steps, lambda s: F.abs(s) == 1)
        years = F.forall(v, lambda x: (x == F.floor(x)) & (x >= 1900) & (x <= 2100))
        months = F.forall(v, lambda x: (x == F.floor(x)) & (x >= 1) & (x <= 12))
        has_date = F.exists(types, lambda t: F.coalesce(t == "date", F.lit(False)))
        return (F.size(v) >= SERIES_CELLS) & (rising | falling) & (has_date | consecutive | years | months)

    return F.coalesce(bind(values, judge), F.lit(False))


def with_following(grid: DataFrame) -> DataFrame:
    """Typed rows with the types of the next five rows (``below``), how many rows follow among them, and whether any has data.

    Rows move with their cells alone; types are worked out where the rows of a range have met.
    """
    number = F.floor(F.col("row_idx") / RANGE)
    early = F.when((number > 0) & (F.col("row_idx") % RANGE < CONTEXT_ROWS), F.struct((number - 1).alias("n"), F.lit(True).alias("guest")))
    placed = grid.withColumn("_r", F.explode(F.array_compact(F.array(F.struct(number.alias("n"), F.lit(False).alias("guest")), early))))
    # Plain columns: windows over a field of a struct are not seen to be dealt alike, and each would move the rows.
    placed = placed.select(*grid.columns, F.col("_r.n").alias("_range"), F.col("_r.guest").alias("_guest")).repartition("file_id", "_range")
    by_row = W.partitionBy("file_id", "_range").orderBy("row_idx")
    ahead = by_row.rowsBetween(1, CONTEXT_ROWS)
    return (typed_rows(placed)
            .withColumn("below", F.array(*[F.lead("types", k).over(by_row) for k in range(1, CONTEXT_ROWS + 1)]))
            .withColumn("following", F.count(F.lit(1)).over(ahead))
            .withColumn("data_below", F.coalesce(F.max("filled").over(ahead) > 0, F.lit(False)))
            .where("NOT _guest").drop("_range", "_guest"))


def contextual_counts(grid: DataFrame, sample_rows: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row what the point system needs, for both pivot settings.

    ``strong`` and ``weak`` count text cells earning the boundary and the plain points; ``series_cells`` counts typed
    cells unique in their row with at least 60 % typed cells below.
    """
    rows = with_following(grid if sample_rows is None else grid.where(F.col("row_idx") < sample_rows))
    width_below = F.array(*[F.size(F.get("below", F.lit(k))) for k in range(CONTEXT_ROWS)])

    def under(i: Column) -> Column:
        cells = F.array(*[below_cell(F.col("below"), k, i) for k in range(CONTEXT_ROWS)])
        return F.struct(
            F.size(F.filter(cells, is_typed)).alias("typed"),
            F.size(F.filter(cells, lambda t: t == "string")).alias("text"),
            F.size(F.filter(width_below, lambda n: n > i)).alias("present"),
            F.coalesce(below_cell(F.col("below"), 0, i) == "string", F.lit(False)).alias("text_first"))

    judged = F.transform("types", lambda t, i: F.struct(t.alias("t"), F.get("keys", i).alias("k"), under(i).alias("u")))
    rows = rows.withColumn("_c", judged)
    strong = F.filter("_c", lambda c: (c["t"] == "string") & (c["u"]["typed"] > c["u"]["text"]) & ~c["u"]["text_first"])
    touched = F.filter("_c", lambda c: (c["t"] == "string") & (c["u"]["typed"] + c["u"]["text"] > 0))
    likely = F.filter("_c", lambda c: is_typed(c["t"]) & (c["u"]["present"] > 0)
                      & (c["u"]["typed"] / F.nullif(c["u"]["present"], F.lit(0)) >= 0.6))
    filled_keys = F.filter("keys", lambda k: k.isNotNull())
    repeated = bind(F.array_sort(filled_keys), lambda o: F.filter(o, lambda k, i: (
        F.coalesce(F.get(o, i + 1) == k, F.lit(False)) | F.coalesce(F.when(i > 0, F.get(o, i - 1)) == k, F.lit(False)))))
    return (rows
            .withColumn("repeated", F.array_distinct(repeated))
            .withColumn("strong", F.size(strong))
            .withColumn("weak", F.size(touched) - F.col("strong"))
            .withColumn("series_cells", bind(F.col("repeated"), lambda again: F.size(F.filter(
                F.transform(likely, lambda c: c["k"]), lambda k: ~F.array_contains(again, k)))))
            .withColumn("texts", F.size(F.filter("types", lambda t: t == "string")))
            .withColumn("duplicates", F.size(filled_keys) - F.size(F.array_distinct(filled_keys)))
            .withColumn("is_series", F.when(F.col("numeric_cells") >= SERIES_CELLS, series_flag(F.col("cells"), F.col("types"))).otherwise(False))
            .select("file_id", "row_idx", *keep, "keys", "filled", "numeric_cells", "texts", "strong", "weak",
                    "series_cells", "duplicates", "is_series", "following", "data_below"))


def points(scaling: bool, pivot_aware: bool) -> Column:
    """Total of the point system; no average over the width and no cap."""
    scale = F.when(F.lit(scaling) & (F.col("following") < 3), F.lit(0.6)).otherwise(F.lit(1.0))
    series = F.lit(pivot_aware) & F.col("is_series")

    def scaled(n: int) -> Column:
        return F.floor(scale * n + 0.5)

    def when(condition: Column, value) -> Column:
        return F.when(condition, value).otherwise(0)

    some = F.col("filled") > 0
    total = (2 * F.col("filled")
             + F.col("strong") * scaled(15) + F.col("weak") * scaled(5)
             + when(series, F.col("series_cells") * scaled(10) + 25)
             + when(~series & some & (F.col("numeric_cells") / F.nullif(F.col("filled"), F.lit(0)) > 0.5), -50)
             + when(~series & (F.col("numeric_cells") > 0), -20)
             + when(some & (F.col("texts") == F.col("filled")), 10)
             + when(F.col("duplicates") > 0, -5 * F.col("duplicates"))
             + when((F.col("filled") > 1) & (F.col("duplicates") == 0), 5)
             + when(some & ~F.col("data_below"), -50))
    return total.cast("int")


def contextual_scores(grid: DataFrame, scaling: bool = True, sample_rows: int | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, row_idx, plain_score, pivot_score, is_series) for every row."""
    return (contextual_counts(grid, sample_rows, keep)
            .withColumn("plain_score", points(scaling, False)).withColumn("pivot_score", points(scaling, True)))


def _first_best(order: list[Column], payload: Column, candidate: Column) -> Column:
    return F.max_by(F.when(candidate, payload), F.when(candidate, F.struct(*order, -F.col("row_idx"))))


def detect_headers_contextual(grid: DataFrame, scaling: bool = True, sample_rows: int | None = None) -> DataFrame:
    """Two stages: the plain score if its best reaches 50; else the pivot-aware score if that reaches 50 and is higher;
    else the plain best, whatever it is."""
    scored = contextual_scores(grid, scaling, sample_rows, keep=("cells",))
    candidate = F.col("following") > 0  # the last row never stands
    files = scored.groupBy("file_id").agg(
        _first_best([F.col("plain_score")], F.struct(F.col("plain_score").alias("s"), "row_idx", "cells"), candidate).alias("plain"),
        _first_best([F.col("pivot_score")], F.struct(F.col("pivot_score").alias("s"), "row_idx", "cells"), candidate).alias("pivot"))
    pivoted = F.coalesce((F.col("plain.s") < ACCEPT) & (F.col("pivot.s") >= ACCEPT)
                         & (F.col("pivot.s") > F.col("plain.s")), F.lit(False))
    chosen = F.when(pivoted, F.col("pivot")).otherwise(F.col("plain"))
    return files.select("file_id", F.coalesce(chosen["row_idx"].cast("int"), F.lit(-1)).alias("header_row_index"),
                        chosen["s"].alias("score"), pivoted.alias("is_pivoted"),
                        F.coalesce(header_names(chosen["cells"]), F.array().cast("array<string>")).alias("headers"))


def detect_headers_ranked(grid: DataFrame, aliases: Lexicon | DataFrame, keyword_first: bool = False,
                          sample_rows: int | None = None) -> DataFrame:
    """Keyword-led variant: rows ranked by (keyword, points) or (points, keyword).

    Accepted when the leading score reaches 50. Else rows among the first 20 are ranked with the pivot-aware points; that
    winner needs a leading score of 50 that beats the first stage, and its confidence is its points less 100.
    Context scaling is on.
    """
    scored = row_keyword_columns(contextual_scores(grid, True, sample_rows, keep=("cells",)), aliases)
    candidate = F.col("following") > 0  # the last row never stands
    early = candidate & (F.col("row_idx") < PIVOT_STAGE_ROWS)

    def stage(score: str, among: Column) -> Column:
        order = [F.col("keyword_score"), F.col(score)] if keyword_first else [F.col(score), F.col("keyword_score")]
        return _first_best(order, F.struct(F.col(score).alias("s"), "keyword_score", "row_idx", "cells"), among)

    files = scored.groupBy("file_id").agg(stage("plain_score", candidate).alias("plain"),
                                          stage("pivot_score", early).alias("pivot"))
    lead = "keyword_score" if keyword_first else "s"
    pivoted = F.coalesce((F.col(f"plain.{lead}") < ACCEPT) & (F.col(f"pivot.{lead}") >= ACCEPT)
                         & (F.col(f"pivot.{lead}") > F.col(f"plain.{lead}")), F.lit(False))
    chosen = F.when(pivoted, F.col("pivot")).otherwise(F.col("plain"))
    usable = F.coalesce(F.size(chosen["cells"]) > 0, F.lit(False))
    confidence = clamp(F.when(pivoted, chosen["s"] - 100).otherwise(chosen["s"]))
    return files.select(
        "file_id", F.when(usable, chosen["row_idx"]).otherwise(F.lit(-1)).cast("int").alias("header_row_index"),
        F.when(usable, header_names(chosen["cells"])).otherwise(F.array().cast("array<string>")).alias("headers"),
        F.when(usable, confidence).otherwise(F.lit(0)).alias("confidence"),
        F.when(usable, clamp(chosen["keyword_score"])).otherwise(F.lit(0)).alias("keyword_confidence"),
        pivoted.alias("is_pivoted"))
