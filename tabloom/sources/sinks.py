"""Table sinks for results, reports and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tagged_batches(rows: DataFrame, batch_size: int = 1000) -> DataFrame:
    """Number batches of ``batch_size`` rows inside each file from the dense ``row_idx``."""
    return rows.withColumn("batch_no", F.floor(F.col("row_idx") / batch_size).cast("long"))


def write_batches(rows: DataFrame, path: str, batch_size: int = 1000) -> None:
    """Write rows in (file, row) order; range partitions cut a large file wherever sizes ask for it."""
    ordered = tagged_batches(rows, batch_size).repartitionByRange("file_id", "row_idx").sortWithinPartitions(
        "file_id", "row_idx")
    ordered.write.mode("append").parquet(path)


def write_results(report: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    writer = report.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_grid_table(grid: DataFrame, table: str, buckets: int = 512) -> None:
    """Store grids bucketed by file, so detection and reshaping read them without a shuffle."""
    grid.write.mode("overwrite").bucketBy(buckets, "file_id").sortBy("file_id").saveAsTable(table)
