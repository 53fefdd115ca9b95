"""Exact duplicates by content sort.

Texts are equal when identical after every run of blanks is replaced by one space. Sampled splitters deal the rows into
ranges of the sort order, each range is sorted (externally, by Spark), so equal texts are neighbours, and neighbours
are compared in full. The order is (first 64 characters, hash, text, doc_id): splitters stay small however long the
texts are, and as doc_id takes part, a group of copies of any size is spread over as many ranges as it needs. Only the
first and the last run of a range can go on elsewhere; these, two a range at most, are put together at the end.

Null texts count as empty. A null doc_id comes last. Of rows that tie in text and doc_id one stays. An empty table
gives an empty result. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import scratch_dir

PREFIX = 64
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
_RUN = T.StructType([
    T.StructField("range_no", T.IntegerType()), T.StructField("head", T.BooleanType()),
    T.StructField("edge", T.BooleanType()), T.StructField("run_keep", T.LongType()),
    T.StructField("run_size", T.LongType()), T.StructField("sha", T.StringType())])


def _runs(carried: int):
    """Rows (id, text, carried...) in sort order -> rows of runs of equal texts. Carried columns stay with the first row."""
    def emit(ids, sha, first, edge, schema) -> pa.RecordBatch:
        n = len(ids)
        number = TaskContext.get().partitionId()
        own = [pa.array(ids, pa.int64()), pa.array([number] * n, pa.int32()), pa.array([True] + [False] * (n - 1)),
               pa.array([edge] * n), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n, pa.int64()),
               pa.array([sha] * n)]
        for k in range(carried):
            value = first.column(2 + k)
            own.append(pa.concat_arrays([value, pa.nulls(n - 1, value.type)]) if n > 1 else value)
        return pa.RecordBatch.from_arrays(own, names=["id", "range_no", "head", "edge", "run_keep", "run_size", "sha"]
                                          + [f"c{k}" for k in range(carried)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = first = None
        ids: list = []
        done = 0
        for batch in batches:
            key, value = batch.column(0), batch.column(1)
            ready = []
            for i, (row_id, row_text) in enumerate(zip(key.to_pylist(), value.to_pylist(), strict=True)):
                if row_text == text:
                    ids.append(row_id)
                    continue
                if ids:
                    ready.append(emit(ids, hashlib.sha256(text.encode()).hexdigest(), first, not done, None))
                    done += 1
                text, ids = row_text, [row_id]
                first = batch.slice(i, 1)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            if first is not None:  # do not hold the whole batch for one row
                first = pa.RecordBatch.from_arrays([c.take(pa.array([0])) for c in first.columns], names=first.schema.names)
        if ids:
            yield emit(ids, hashlib.sha256(text.encode()).hexdigest(), first, True, None)
    return work


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                partitions: int | None = None) -> DataFrame:
    """(id, range_no, head, edge, run_keep, run_size, sha, c0...): every row with the run of equal texts it stands in."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), BLANK_RUN, " ")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("t"),
                       *[docs[c].alias(f"c{k}") for k, c in enumerate(carry)])
    order = [F.substring("t", 1, PREFIX), F.xxhash64("t")]
    last = F.col("id").asc_nulls_last()
    ranged = rows.repartitionByRange(n, *order, last).sortWithinPartitions(*order, "t", last)
    kinds = [docs.schema[c].dataType for c in carry]
    schema = T.StructType([T.StructField("id", T.LongType()), *_RUN.fields,
                           *[T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)]])
    return ranged.mapInArrow(_runs(len(carry)), schema)


def settled(runs: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept, joining the runs that go on in another range (two rows a range at most)."""
    edges = (runs.where("edge AND head").groupBy("sha")
             .agg(F.min("range_no").alias("first_range"), F.min("run_keep").alias("keep_all"),
                  F.sum("run_size").alias("size_all"))).withColumn("at_edge", F.lit(True))
    both = runs.join(F.broadcast(edges), "sha", "left")
    met = F.col("at_edge").isNotNull()
    return (both.withColumn("keep_id", F.when(met, F.col("keep_all")).otherwise(F.col("run_keep")))
            .withColumn("group_size", F.when(met, F.col("size_all")).otherwise(F.col("run_size")))
            .withColumn("kept", F.col("head") & (~met | (F.col("range_no") == F.col("first_range"))))
            .drop("first_range", "keep_all", "size_all", "at_edge"))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that later steps neither repeat the work nor lose it."""
    spark = frame.sparkSession
    path = scratch_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    runs = stored(sorted_runs(docs, id_col, text_col), "exact-runs")
    return settled(runs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole and unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"x{k}" for k in range(len(names))])
    id_at, text_at = names.index(id_col), names.index(text_col)
    runs = stored(sorted_runs(plain, f"x{id_at}", f"x{text_at}", tuple(plain.columns)).where("head"), "exact-heads")
    return settled(runs).where("kept").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
