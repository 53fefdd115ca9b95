"""Grid sources: CSV folders, extracted sheet tables, alias dictionaries, wide header lists; and row numbering."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.cells import bind
from ..operators.common import computed_here, dense_index
from ..operators.structure import SAMPLE_ROWS
from .ledger import MAX_BYTES, reject_reason

# Delimiters a file may use, most usual first.
DELIMITERS = [",", "\t", "|", ";"]
GUESS_LINES = 10
#: Rows handed on at once.
ROWS = 4096
_QUOTED = '"(?:[^"]++|"")*+"'


def guess_delimiter(text: Column) -> Column:
    """The delimiter that cuts the first lines into the steadiest number of cells, two or more; a comma if none does.

    Quoted stretches do not count. Ties go to the one with more cells, then to the more usual one.
    """
    lines = F.slice(F.filter(F.split(F.regexp_replace(text, "(?m)(^|[,;|\\t])" + _QUOTED, "$1"), "\\r\\n|\\n|\\r"), lambda x: F.trim(x) != ""), 1, GUESS_LINES)

    def judged(lines: Column, at: int) -> Column:
        counts = F.transform(lines, lambda x: F.size(F.split(x, f"[{DELIMITERS[at]}]")))
        steps = F.aggregate(counts, F.struct(F.get(counts, F.lit(0)).alias("last"), F.lit(0).alias("sum")), lambda s, n: F.struct(
            n.alias("last"), (s["sum"] + F.abs(n - s["last"])).alias("sum")))["sum"]
        average = F.aggregate(counts, F.lit(0), lambda s, n: s + n) / F.greatest(F.size(counts), F.lit(1))
        return F.when(average >= 2, F.struct(steps.alias("steps"), (-average).alias("few"), F.lit(at).alias("at")))

    best = bind(lines, lambda x: F.array_min(F.array_compact(F.array(*[judged(x, k) for k in range(len(DELIMITERS))]))))
    return F.get(F.array(*[F.lit(x) for x in DELIMITERS]), F.coalesce(best["at"], F.lit(0)))


def _files(spark: SparkSession, path: str, max_bytes: int, extensions: list[str] | None) -> DataFrame:
    """(file_id, error, text): every file below ``path`` once; the text of files that are not admitted is not read."""
    listed = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    reason = reject_reason(name, size, F.lit(""), max_bytes, extensions)
    good = listed.where(reason.isNull()).select(
        F.col("_metadata.file_path").alias("file_id"), F.lit(None).cast("string").alias("error"),
        F.regexp_replace("value", "^\ufeff", "").alias("text"))
    bad = listed.where(reason.isNotNull()).select(F.col("_metadata.file_path").alias("file_id"), reason.alias("error"),
                                                  F.lit(None).cast("string").alias("text"))
    return good.unionByName(bad)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, error, text, delimiter) -> (file_id, error, row_idx, cells): the rows of a file, or one with what is wrong."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        for file_id, error, text, delimiter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = []
            if error is None:
                # a row that stands alone at the end stays so unless a quoted cell is still open there
                end = "end of file"
                rows = [r for r in csv.reader(io.StringIO(f"{text}\n{end}\n", newline=""), delimiter=delimiter) if r]
                error = "a quoted cell does not end" if rows.pop() != [end] else None if rows else "no rows"
            if error is not None:
                rows = [None]
            n = len(rows)
            for at in range(0, n, ROWS):
                part = rows[at:at + ROWS]
                cells = [None if r is None else [c or None for c in r] for r in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_id] * len(part)), pa.array([error] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()),
                     pa.array(cells, pa.list_(pa.string()))], names=["file_id", "error", "row_idx", "cells"])


def _records(files: DataFrame) -> DataFrame:
    """(file_id, error, row_idx, cells) of all files."""
    named = computed_here(files, "delimiter", guess_delimiter(F.col("text")))
    return named.mapInArrow(_cut, "file_id string, error string, row_idx long, cells array<string>")


def read_csv_grids(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, extensions: list[str] | None = None) -> DataFrame:
    """Header-less CSV files as (file_id, line_no, row_idx, cells); the delimiter is guessed for each file.

    Only admitted files are read, each whole by one task, which the admission limit ``max_bytes`` keeps small. The
    reader of Python's library cuts them (a CSV scan with one schema would pad short rows, so where a row ends would be
    lost). Rows are numbered as they are cut, so nothing is shuffled. Empty lines are dropped, lines of delimiters alone
    are kept. Files that cannot be read give no rows here but one in ``read_errors``.
    """
    cut = _records(_files(spark, path, max_bytes, extensions)).where("error IS NULL")
    return cut.select("file_id", F.col("row_idx").alias("line_no"), "row_idx", "cells")


def read_errors(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, extensions: list[str] | None = None) -> DataFrame:
    """(file_id, error) of the files that ``read_csv_grids`` gives no rows for."""
    return _records(_files(spark, path, max_bytes, extensions)).where("error IS NOT NULL").select("file_id", "error")


def read_sheet_grids(spark: SparkSession, path: str) -> DataFrame:
    """Extracted sheets stored as parquet (file_id, line_no, cells); blank rows are dropped."""
    return drop_blank_rows(spark.read.schema("file_id string, line_no long, cells array<string>").parquet(path))


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("cells", lambda c: c.isNotNull()))


def number_rows(rows: DataFrame) -> DataFrame:
    """Dense ``row_idx`` per file over all rows, by ``line_no`` (unique per file)."""
    return dense_index(rows, ["file_id"], "line_no", "row_idx")


def head_rows(rows: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows of each file with dense ``row_idx``.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per file and task before it shuffles, so long files are not
    moved or sorted in one place.
    """
    place = F.row_number().over(W.partitionBy("file_id").orderBy("line_no"))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).withColumn(
        "row_idx", (F.col("_n") - 1).cast("long")).drop("_n")


def text_grids(rows: DataFrame, file_id: str, text: str) -> DataFrame:
    """Grids from one text per file: lines, then commas; empty lines dropped. Nothing is shuffled."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line != "")
    return rows.select(F.col(file_id).cast("string").alias("file_id"), F.posexplode(lines).alias("row_idx", "line")).select(
        "file_id", F.col("row_idx").cast("long").alias("row_idx"), F.split("line", ",").alias("cells"))


def cells_of(grid: DataFrame) -> DataFrame:
    """One row per cell: (file_id, row_idx, col_idx, value, cell_type)."""
    from ..functions.cells import cell_type
    return grid.select("file_id", "row_idx", F.posexplode("cells").alias("col_idx", "value")).withColumn(
        "cell_type", cell_type(F.col("value")))


def read_alias_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {key: [phrases]} as (key_pos, target_key, alias_pos, alias)."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,array<string>>").alias("m"))
    keys = parsed.select(F.posexplode(F.map_entries("m")).alias("key_pos", "e"))
    return keys.select("key_pos", F.col("e.key").alias("target_key"),
                       F.posexplode("e.value").alias("alias_pos", "alias"))


def unpivot_headers(wide: DataFrame, name_column: str = "File Name") -> DataFrame:
    """One row per file with a column per header -> (file_id, src_pos, source)."""
    columns = [c for c in wide.columns if c != name_column]
    position = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(i) for i in range(len(columns))]))
    return (wide.unpivot([name_column], columns, "_column", "source").where("source is not null and source <> ''")
            .select(F.col(name_column).alias("file_id"), F.element_at(position, F.col("_column")).alias("src_pos"), "source"))


def with_typo_sets(headers: DataFrame, suffix: str = " (variant)") -> DataFrame:
    """The header sets plus a letter-swapped copy of each."""
    from ..functions.text import typo_variant
    copies = headers.withColumn("file_id", F.concat("file_id", F.lit(suffix))).withColumn(
        "source", typo_variant(F.col("source")))
    return headers.unionByName(copies)
