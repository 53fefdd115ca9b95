"""Reshape data rows to the typed target schema; merging, typed casts and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import bind, clean, filled_type
from ..functions.text import strings
from ..lexicon import Lexicon
from .common import computed_here, salted_lookup

SPARK_TYPES = {"integer": "bigint", "decimal": "decimal(18,2)", "string": "string", "alphanumeric": "string"}
DEFAULT_SEPARATOR = " "


def reshape_plan(detected: DataFrame, mapping: DataFrame, lexicon: Lexicon,
                 merges: DataFrame | None = None) -> DataFrame:
    """One row per file: where its data starts and, per target, which columns feed it.

    ``detected`` has (file_id, header_row_index, headers). ``merges`` (file_id, target_id, separator) sets the separator
    for targets with several sources. The first column wins when a name repeats.
    """
    chosen = mapping if merges is None else mapping.join(merges, ["file_id", "target_id"], "left")
    separator = F.lit(DEFAULT_SEPARATOR) if merges is None else F.coalesce("separator", F.lit(DEFAULT_SEPARATOR))
    slots = chosen.where(F.size("sources") > 0).groupBy("file_id").agg(
        F.collect_list(F.struct("target_id", "sources", separator.alias("separator"))).alias("slots"))
    usable = detected.where("header_row_index >= 0").select("file_id", "header_row_index", "headers")
    joined = usable.join(slots, "file_id", "left")

    def slot_of(target: Column) -> Column:
        return bind(F.get(F.filter("slots", lambda s: s["target_id"] == target), F.lit(0)), lambda slot: F.struct(
            F.transform(F.filter(F.transform(slot["sources"], lambda s: F.array_position("headers", s)), lambda p: p > 0),
                        lambda p: (p - 1).cast("int")).alias("columns"),
            slot["separator"].alias("separator")))

    return joined.select("file_id", "header_row_index", F.transform(strings(lexicon.target_ids), slot_of).alias("plan"))


def cast_value(value: Column, data_type: str) -> Column:
    """Value in the target's type, null when it does not fit."""
    text = F.nullif(clean(value), F.lit(""))
    if data_type in ("integer", "decimal"):
        return text.try_cast(SPARK_TYPES[data_type])
    return text


def source_values(grid: DataFrame, plan: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Data rows with one text column per target: the mapped cells, joined by the separator when several.

    One lookup of the file's plan per row, spread over salts so that a huge file is not one task; no explode, no pivot.
    A row carries and works out only the targets its file fills, with each target's place among them.
    """
    numbered = F.transform("plan", lambda s, i: F.struct(s["columns"].alias("columns"), s["separator"].alias("separator"), i.alias("target")))
    short = computed_here(plan.select("file_id", "header_row_index", F.filter(numbered, lambda s: F.size(s["columns"]) > 0).alias("plan")), "at", F.transform(
        F.sequence(F.lit(0), F.lit(len(lexicon.target_ids) - 1)), lambda i: (F.array_position("plan.target", i) - 1).cast("int")))
    rows = salted_lookup(grid.select("file_id", "row_idx", "cells"), short, "file_id", F.col("row_idx"), "inner")
    data = rows.where(F.col("row_idx") > F.col("header_row_index"))

    def joined(slot: Column) -> Column:
        parts = F.filter(F.transform(F.transform(slot["columns"], lambda c: F.get("cells", c)), clean), lambda v: v != "")
        return bind(parts, lambda p: F.when(F.size(p) > 0, F.call_function("array_join", p, slot["separator"])))

    filled = computed_here(data.select("file_id", "row_idx", "cells", "plan", "at"), "_values", F.transform("plan", joined))
    return filled.select("file_id", "row_idx", *[
        F.get("_values", F.get("at", F.lit(i))).alias(t) for i, t in enumerate(lexicon.target_ids)])


def typed(values: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Typed target columns, plus ``rejects`` (target ids whose text did not fit) and ``missing`` (mandatory blanks)."""
    casts = {t.target_id: cast_value(F.col(t.target_id), t.data_type) for t in lexicon.targets}
    rejects = F.array_compact(F.array(*[
        F.when(F.col(t.target_id).isNotNull() & casts[t.target_id].isNull(), F.lit(t.target_id))
        for t in lexicon.targets if t.data_type in ("integer", "decimal")]))
    missing = F.array_compact(F.array(*[
        F.when(F.col(t.target_id).isNull(), F.lit(t.target_id)) for t in lexicon.targets if t.required]))
    return values.select("file_id", "row_idx", *[casts[t].alias(t) for t in lexicon.target_ids],
                         rejects.alias("rejects"), missing.alias("missing"))


def reshape(grid: DataFrame, detected: DataFrame, mapping: DataFrame, lexicon: Lexicon,
            merges: DataFrame | None = None) -> DataFrame:
    """All data rows below the header as 26 typed columns with ``rejects`` and ``missing``."""
    return typed(source_values(grid, reshape_plan(detected, mapping, lexicon, merges), lexicon), lexicon)


def rejected_values(values: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(file_id, row_idx, target_id, value) for every text that does not fit its target's type."""
    wrong = F.array_compact(F.array(*[
        F.when(F.col(t.target_id).isNotNull() & cast_value(F.col(t.target_id), t.data_type).isNull(),
               F.struct(F.lit(t.target_id).alias("target_id"), F.col(t.target_id).alias("value")))
        for t in lexicon.targets if t.data_type in ("integer", "decimal")]))
    return values.select("file_id", "row_idx", F.explode(wrong).alias("w")).select("file_id", "row_idx", "w.*")


def masked_sample(grid: DataFrame, header_rows: DataFrame, n_rows: int = 10) -> DataFrame:
    """The first data rows with e-mail addresses and money-like numbers replaced by fixed dummies.

    The sample is taken right below the header, wherever that is.
    """
    heads = header_rows.where("header_row_index >= 0").select("file_id", "header_row_index")
    near = salted_lookup(grid, heads, "file_id", F.col("row_idx"), "inner")
    rows = near.where((F.col("row_idx") > F.col("header_row_index"))
                      & (F.col("row_idx") <= F.col("header_row_index") + n_rows))

    def mask(cell: Column) -> Column:
        hidden = F.regexp_replace(cell, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "user@example.com")
        money = (filled_type(clean(cell)) == "number") & F.contains(cell, F.lit("."))
        return F.when(F.coalesce(money, F.lit(False)), F.lit("999.99")).otherwise(hidden)

    return rows.select("file_id", "row_idx", F.transform("cells", mask).alias("cells"))
