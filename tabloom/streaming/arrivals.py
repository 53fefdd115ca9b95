"""Files arriving over time: skip known names, detect and map each micro-batch, keep the latest status.

Every micro-batch ends with a commit record, written last. Readers (``committed``) take only batches that have one, so a
batch that failed half-way is unseen until its replay has overwritten all its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lexicon import Lexicon
from ..operators.common import salted_lookup
from ..operators.detect import detect_headers, header_list
from ..operators.reshape import reshape
from ..plans.mapping import APP_THRESHOLD, map_headers
from ..sources.sinks import tagged_batches

GRID_SCHEMA = "file_id string, row_idx long, cells array<string>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Names are remembered that long after they were first seen.
FORGET = "30 days"
#: Up to so many names of a batch that are not new are sent to all tasks; more meet the rows in a shuffle.
FEW_NAMES = 10_000
#: Status batches between two merges into the compacted table.
MERGE_EVERY = 8


def grid_stream(spark: SparkSession, path: str, max_files: int = 1000, schema: str = GRID_SCHEMA) -> DataFrame:
    """Grids arriving as parquet files, with the file they came in (``arrival``); a source file arrives in one of them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("arrival"))


def first_arrivals(heads: DataFrame, forget: str | None = FORGET) -> DataFrame:
    """(file_id, arrival) once for each name, where it is first seen, from a stream of (file_id, arrival).

    The names are keyed state of the running query. They are dropped ``forget`` after they were seen, which bounds the
    state; with None all are kept.
    """
    stamped = heads.withColumn("claimed_at", F.current_timestamp())
    if forget is None:
        claims = stamped.dropDuplicates(["file_id"])
    else:
        claims = stamped.withWatermark("claimed_at", forget).dropDuplicatesWithinWatermark(["file_id"])
    return claims.select("file_id", "arrival")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a broken table is not an empty one
        return None


def committed(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """A table of ``run_arrivals`` (detected, mapping, rows, late) without batches that are not finished; None before the first."""
    marks, rows = _table(spark, f"{out}/commits"), _table(spark, f"{out}/{table}")
    if marks is None or rows is None:
        return None
    return rows.join(marks.select("batch_id"), "batch_id", "left_semi")


def handle_batch(grid: DataFrame, batch_id: int, out: str, lexicon: Lexicon, threshold: float = APP_THRESHOLD,
                 mode: str = "standard", batch_size: int = 1000, typed_rows: bool = True) -> None:
    """Detect, map and reshape the new files of one micro-batch; write detections, mappings and tagged rows.

    Each table gets its own folder per batch, overwritten when a batch is replayed. A file without headers ends with an
    ``error`` text, not an exception, and does not hold up the others.
    """
    spark = grid.sparkSession
    detected = detect_headers(grid, lexicon).withColumn(
        "error", F.when(F.col("header_row_index") < 0, F.lit("no header row found")))
    detected.write.mode("overwrite").parquet(f"{out}/detected/batch_id={batch_id}")
    stored = spark.read.parquet(f"{out}/detected/batch_id={batch_id}")
    good = stored.where("error is null")
    map_headers(header_list(good), lexicon, threshold, mode).write.mode("overwrite").parquet(
        f"{out}/mapping/batch_id={batch_id}")
    if typed_rows:
        mapping = spark.read.parquet(f"{out}/mapping/batch_id={batch_id}")
        rows = tagged_batches(reshape(grid, good.where("state = 'confident'"), mapping, lexicon), batch_size)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")


def late_and_fresh(came: DataFrame, old: DataFrame, spread: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch whose ``_name`` is in ``old`` (written, one row per name), and the others.

    Few names are sent to all tasks, and rows stay where they are. Files of names are far smaller than the names are in
    memory, so Spark is not left to tell by their size: many names would fill the driver.
    """
    n = old.count()
    if not n:
        return came.where(F.lit(False)), came
    if n <= FEW_NAMES:
        return came.join(F.broadcast(old), "_name", "left_semi"), came.join(F.broadcast(old), "_name", "left_anti")
    names = old.hint("merge")
    return salted_lookup(came, names, "_name", spread, "left_semi"), salted_lookup(came, names, "_name", spread, "left_anti")


def run_arrivals(stream: DataFrame, out: str, checkpoint: str, lexicon: Lexicon,
                 to_grid: Callable[[DataFrame], DataFrame] = lambda batch: batch, available_now: bool = False,
                 forget: str | None = FORGET, head: Column | None = None, **options) -> StreamingQuery:
    """Start the stream; ``to_grid`` turns a micro-batch into a grid when it is not one already.

    ``stream`` has a ``file_id`` and, from ``grid_stream``, an ``arrival``. ``head`` picks a row that stands for the
    file (the first one of a grid), so only few and narrow rows meet the state; without it, and without ``row_idx``, all
    rows do. Rows of a name that came before, in this batch or an earlier one, are written to ``late`` whole.

    Rows and names first seen come out of one query and are written once per batch, in two places used in turn; what
    follows reads them there, so neither the source nor the state is asked twice.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, ""):
        spark.conf.set(key, STATE_STORE)  # unless one was chosen: names live on disk, not in the heap
    rows = stream if "arrival" in stream.columns else stream.withColumn("arrival", F.lit(""))
    if head is None and "row_idx" in rows.columns:
        head = F.col("row_idx") == 0
    heads = (rows if head is None else rows.where(head)).select("file_id", "arrival")
    both = rows.withColumn("_claim", F.lit(False)).unionByName(
        first_arrivals(heads, forget).withColumn("_claim", F.lit(True)), allowMissingColumns=True)
    schema = both.schema

    def handle(batch: DataFrame, batch_id: int) -> None:
        place = f"{out}/arrived/slot={batch_id % 2}"
        batch.write.mode("overwrite").parquet(place)
        here = spark.read.schema(schema).parquet(place).withColumn("_name", F.struct("file_id", "arrival"))
        came = here.where("NOT _claim").drop("_claim")
        new = here.where("_claim").select("_name").distinct()
        spread = F.xxhash64(*[c for c in rows.columns if c != "arrival"])
        known = f"{out}/known/slot={batch_id % 2}"
        came.select("_name").distinct().join(new, "_name", "left_anti").write.mode("overwrite").parquet(known)
        late, fresh = late_and_fresh(came, spark.read.schema(new.schema).parquet(known), spread)
        late.drop("_name").write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        if not new.isEmpty():  # batches without new names come, also from moves of the watermark
            handle_batch(to_grid(fresh.select(*stream.columns)), batch_id, out, lexicon, **options)
        new.agg(F.count("*").alias("files")).write.mode("overwrite").parquet(f"{out}/commits/batch_id={batch_id}")

    writer = both.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- the latest status of every file ---

def latest_status(history: DataFrame) -> DataFrame:
    """(file_id, status, ts, seq): the newest of every file; the larger status if both times are equal."""
    newest = F.max(F.struct("ts", "seq", "status")).alias("s")
    return history.groupBy("file_id").agg(newest).select("file_id", "s.status", "s.ts", "s.seq")


def _changes(spark: SparkSession, out: str, first: int, last: int) -> DataFrame | None:
    parts = [spark.read.parquet(f"{out}/changes/slot={k % (2 * MERGE_EVERY)}").where(F.col("batch_id") == k) for k in range(first, last + 1)]
    whole = None
    for part in parts:
        whole = part if whole is None else whole.unionByName(part)
    return None if whole is None else whole.drop("batch_id")


def _statuses(spark: SparkSession, out: str, last: int) -> DataFrame:
    """What batches 0..last say: the table of the last merge, and the changes since."""
    merges = (last + 1) // MERGE_EVERY
    since = _changes(spark, out, merges * MERGE_EVERY, last)
    if not merges:
        return latest_status(since)
    merged = spark.read.parquet(f"{out}/merged/slot={merges % 2}")
    return latest_status(merged if since is None else merged.unionByName(since))


def merge_status(changes: DataFrame, batch_id: int, out: str) -> None:
    """Take up one batch of (file_id, status, ts, seq).

    Its newest status per file is written as a change. Every MERGE_EVERY batches the changes are merged into the table
    of all files, which has two places used in turn, as have the changes: a new version overwrites the one before the
    last, so a reader of the last is undisturbed and old ones do not pile up. The commit record says which batch is the
    last whole one. A replayed batch writes the same rows to the same places.
    """
    spark = changes.sparkSession
    change = latest_status(changes.select("file_id", "status", "ts", "seq")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    change.write.mode("overwrite").parquet(f"{out}/changes/slot={batch_id % (2 * MERGE_EVERY)}")
    done = batch_id + 1
    if done % MERGE_EVERY == 0:
        merges = done // MERGE_EVERY
        whole = _changes(spark, out, done - MERGE_EVERY, batch_id)
        if merges > 1:
            whole = whole.unionByName(spark.read.parquet(f"{out}/merged/slot={(merges - 1) % 2}"))
        latest_status(whole).write.mode("overwrite").parquet(f"{out}/merged/slot={merges % 2}")
    spark.range(1).select(F.lit(batch_id).cast("long").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/slot={batch_id % 2}")


def run_latest_status(history: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the newest status of every file; the query itself has no state."""
    writer = history.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: merge_status(batch, batch_id, out))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """(file_id, status): reads one row a file, and the changes of fewer than MERGE_EVERY batches."""
    marks = [m.agg(F.max("last")).first()[0] for m in (_table(spark, f"{out}/commits/slot={k}") for k in (0, 1)) if m is not None]
    last = max((m for m in marks if m is not None), default=None)
    if last is None:
        return spark.createDataFrame([], "file_id string, status string")
    return _statuses(spark, out, last).select("file_id", "status")
