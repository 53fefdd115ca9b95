"""Column expressions over single cells and over arrays of cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, functions as F

# Characters stripped from both ends of a cell (ECMAScript white space and line ends).
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Text that reads as a number, and text that looks like a date.
NUMBER_PATTERN = (
    r"^([+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
    r"|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
)
DATE_PATTERN = r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(value: Column) -> Column:
    """Cell text without white space at either end.

    Most cells have none: a look at the first and last character spares them the search for each in the whole list.
    """
    ends = F.substring(value, 1, 1).isin(list(WHITE_SPACE)) | F.substring(value, -1, 1).isin(list(WHITE_SPACE))
    return F.when(ends, F.btrim(value, F.lit(WHITE_SPACE))).otherwise(value)


def cell_type(value: Column) -> Column:
    """``empty``, ``number``, ``date`` or ``string``."""
    return F.coalesce(filled_type(clean(value)), F.lit("empty"))


def filled_type(cleaned: Column) -> Column:
    """Type of a cleaned cell, null when the cell is empty.

    The first-character test spares most text cells the two pattern matches.
    """
    maybe_typed = F.substring(cleaned, 1, 1).isin(list("0123456789+-.I"))
    return (F.when(cleaned.isNull() | (cleaned == ""), F.lit(None).cast("string"))
            .when(~maybe_typed, F.lit("string"))
            .when(cleaned.rlike(NUMBER_PATTERN), F.lit("number"))
            .when(cleaned.rlike(DATE_PATTERN), F.lit("date"))
            .otherwise(F.lit("string")))


def is_typed(kind: Column) -> Column:
    return kind.isin("number", "date")


def cell_key(value: Column) -> Column:
    """Comparison key: cleaned and lower-cased, null when empty."""
    return F.nullif(F.lower(clean(value)), F.lit(""))


def row_types(cells: Column) -> Column:
    """Array of cell types, null for empty cells."""
    return F.transform(F.transform(cells, clean), filled_type)


def row_keys(cells: Column) -> Column:
    return F.transform(F.transform(cells, lambda c: F.lower(clean(c))), lambda k: F.nullif(k, F.lit("")))


def header_names(cells: Column) -> Column:
    """Cleaned names; an empty cell is called ``Column_n`` by its position."""
    return F.transform(cells, lambda c, i: F.coalesce(
        F.nullif(clean(c), F.lit("")), F.concat(F.lit("Column_"), (i + 1).cast("string"))))


def leading_block(types: Column) -> Column:
    """Number of cells before the first empty one."""
    gaps = F.filter(F.transform(types, lambda t, i: F.when(t.isNull(), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(gaps, F.lit(0)), F.size(types))


def half_up(value: Column) -> Column:
    """Round a non-negative number, halves upward."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), score))


# --- header hygiene ---

@cache
def accents() -> tuple[str, str]:
    """Letters that are a base letter with combining marks, of every script, and their base letters, position by position.

    The table follows from the canonical decompositions that Python's Unicode data has.
    """
    marked, plain = [], []
    for code in range(0xA0, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]) and parts[0].isalpha():
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold_accents(text: Column) -> Column:
    """Base letters for letters with marks, in every script; combining marks that stand alone are dropped."""
    marked, plain = accents()
    return F.regexp_replace(F.translate(text, marked, plain), "\\p{Mn}", "")


def readability(cells: Column) -> Column:
    """``blocking`` when a header row is all blank, ``recoverable`` when any name holds unreadable characters."""
    all_blank = ~F.exists(cells, lambda c: F.coalesce(clean(c), F.lit("")) != "")
    damaged = F.exists(cells, lambda c: F.coalesce(c.rlike("[\\uFFFD\\x00-\\x08\\x0e-\\x1f\\x7f]"), F.lit(False)))
    return F.when(all_blank, "blocking").when(damaged, "recoverable").otherwise("ok")


# --- judgements on detection and mapping results ---

def confidence_state(confidence: Column, is_pivoted: Column) -> Column:
    return (F.when(is_pivoted, "pivoted").when(confidence >= 50, "confident").otherwise("unpredictable"))


def low_header_warning(confidence: Column) -> Column:
    return F.coalesce(confidence < 40, F.lit(False))


def headers_visible(status: Column, confidence: Column, is_pivoted: Column, headers: Column) -> Column:
    return F.coalesce(~status.isin("error", "confirming_header") & (confidence >= 50)
                      & ~F.coalesce(is_pivoted, F.lit(False)) & (F.size(headers) > 0), F.lit(False))


def percent_text(score: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%.{decimals}f%%", score * 100)


def review_badge(n_sources: Column, confidence: Column, threshold: float = 0.4) -> Column:
    return (F.when(n_sources == 0, F.lit("Unmapped"))
            .when(n_sources > 1, F.lit("Merged"))
            .when(confidence >= 0.99, F.lit("Exact Match"))
            .when(confidence >= threshold, F.concat(F.lit("Lexical ("), percent_text(confidence), F.lit(")")))
            .otherwise(F.lit("High")))


def confidence_tier(confidence: Column, high: float = 0.9, medium: float = 0.7) -> Column:
    return F.when(confidence > high, "high").when(confidence >= medium, "medium").otherwise("unmapped")


def readable_size(n_bytes: Column) -> Column:
    """``0 Bytes``, ``1.5 KB``, ... up to GB; two decimals, trailing zeros dropped. Whole numbers only, halves go up."""
    step = (F.when(n_bytes < 1024, 0).when(n_bytes < 1024 ** 2, 1).when(n_bytes < 1024 ** 3, 2).otherwise(3))
    size = F.get(F.array(*[F.lit(1024 ** k).cast("long") for k in range(4)]), step)
    hundredths = F.floor((n_bytes.cast("decimal(38,0)") * 100 + F.floor(size / 2)) / size).cast("long")
    part = F.lpad((hundredths % 100).cast("string"), 2, "0")
    text = F.concat(F.floor(hundredths / 100).cast("string"), F.when(hundredths % 100 == 0, "").otherwise(
        F.concat(F.lit("."), F.rtrim(part, F.lit("0")))))
    unit = F.get(F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")]), step)
    return F.when(n_bytes == 0, F.lit("0 Bytes")).otherwise(F.concat(text, F.lit(" "), unit))
