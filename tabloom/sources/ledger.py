"""The file ledger: admission, new-file check, removal, kinds and states. A ledger is (file_name, length, mime_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What may be uploaded.
MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = [".csv", ".xls", ".xlsx"]
MIME_TYPES = ["text/csv", "application/vnd.ms-excel",
              "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files below a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length",
                         F.lit("").alias("mime_type"))


def extension(name: Column) -> Column:
    """Lower-cased text from the last dot on; the whole name when it has none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(name, r"(\.[^.]*)$", 1), F.lit("")), name))


def reject_reason(name: Column, length: Column, mime_type: Column, max_bytes: int = MAX_BYTES,
                  extensions: list[str] | None = None) -> Column:
    # The wording of both reasons.
    allowed = extension(name).isin(extensions or EXTENSIONS) | F.coalesce(mime_type.isin(MIME_TYPES), F.lit(False))
    return (F.when(length > max_bytes, F.concat(F.lit("'"), name, F.lit("' exceeds the 10 MB limit.")))
            .when(~allowed, F.concat(F.lit("'"), name, F.lit("' is an invalid file type."))))


def admit(ledger: DataFrame) -> DataFrame:
    """The ledger with ``reject_reason``, null for files that pass."""
    return ledger.withColumn("reject_reason", reject_reason(F.col("file_name"), F.col("length"), F.col("mime_type")))


def new_files(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming files whose name is not known yet; repeats inside one batch stay."""
    return incoming.join(known.select("file_name").distinct(), "file_name", "left_anti")


def add_files(known: DataFrame, incoming: DataFrame) -> DataFrame:
    return known.unionByName(new_files(incoming, known))


def remove_files(known: DataFrame, removed: DataFrame) -> DataFrame:
    return known.join(removed.select("file_name").distinct(), "file_name", "left_anti")


def file_kind(name: Column) -> Column:
    """How a file is parsed; the extension is taken as written, so ``.XLSX`` counts as text."""
    return F.when(name.endswith(".xlsx") | name.endswith(".xls"), "workbook").otherwise("text")


def icon_kind(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".csv"), "csv").otherwise("sheet")


def file_status(files: DataFrame, detected: DataFrame, confirmed_headers: DataFrame, mapped: DataFrame,
                completed: DataFrame) -> DataFrame:
    """Status of each file from what exists for it.

    ``files`` and the last three tables hold ``file_id``. No detection yet: queued. No header names: error. Then
    confirming_header until confirmed, mapping until a mapping exists, mapping_confirm until completed.
    """
    def flag(table: DataFrame, name: str) -> DataFrame:
        return table.select("file_id").distinct().withColumn(name, F.lit(True))

    found = detected.select("file_id", F.size("headers").alias("n_headers"))
    joined = (files.join(found, "file_id", "left").join(flag(confirmed_headers, "_confirmed"), "file_id", "left")
              .join(flag(mapped, "_mapped"), "file_id", "left").join(flag(completed, "_completed"), "file_id", "left"))
    status = (F.when(F.col("n_headers").isNull(), "queued").when(F.col("n_headers") == 0, "error")
              .when(F.col("_completed"), "completed").when(F.col("_mapped"), "mapping_confirm")
              .when(F.col("_confirmed"), "mapping").otherwise("confirming_header"))
    return joined.select("file_id", status.alias("status"))
