"""Building blocks shared by operators: skew-safe lookups and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import scratch_dir

#: With it Spark deletes the shuffle files of a query when the query ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table in the shared folder: computed once, and safe when executors are lost.

    What was shuffled for it is not read again, so those files go as soon as the table is written.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)


def salt_count(spark: SparkSession) -> int:
    """Half the square root of the shuffle partitions: over so many tasks a hot key is spread."""
    return max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5 / 2))


def salted_lookup(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left",
                  salts: int | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key) so that a hot key is spread over ``salts`` tasks.

    Unless given, that is half the square root of the shuffle partitions: the share of a hot key's rows in one task falls
    as the cluster grows, and ``small`` is repeated far fewer times than there are tasks.

    ``small`` has one row per key and is repeated once per salt. No broadcast is forced: Spark broadcasts ``small`` by itself when it measures it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    if salts is None:
        salts = salt_count(big.sparkSession)
    if salts == 1:
        return big.join(small, key, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def computed_here(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Add a costly column at this point of the plan.

    Spark pushes filters on derived columns below the ``distinct`` that was meant to save the work, and would then run the
    expression on every input row. A generated column cannot be pushed, so it is worked out once per row of ``rows``.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(column))


def dense_index(rows: DataFrame, group: list[str], order: str, out: str, fan_out: int = 1 << 14) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by an integer column that is unique in the group.

    A plain window would sort a whole group in one task. Here rows are numbered inside ranges of ``order`` no longer
    than ``fan_out``, and the ranges get their offsets from running counts on two coarser levels, so a task holds at most
    ``fan_out`` rows of one group below the top level (which has one row per ``fan_out`` ** 2 of the order's span).
    """
    def running(value: str, parts: list[str], by: str) -> Column:
        frame = W.partitionBy(*parts).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(frame), F.lit(0))

    numbered = rows.withColumn("_b0", F.floor(F.col(order).cast("long") / fan_out).cast("long"))
    counts = numbered.groupBy(*group, "_b0").agg(F.count(F.lit(1)).alias("_n0"))
    counts = counts.withColumn("_b1", F.floor(F.col("_b0") / fan_out).cast("long"))
    upper = counts.groupBy(*group, "_b1").agg(F.sum("_n0").alias("_n1"))
    upper = upper.withColumn("_o1", running("_n1", group, "_b1")).drop("_n1")
    offsets = (counts.join(upper, [*group, "_b1"])
               .withColumn("_offset", F.col("_o1") + running("_n0", [*group, "_b1"], "_b0"))
               .select(*group, "_b0", "_offset"))
    inside = F.row_number().over(W.partitionBy(*group, "_b0").orderBy(order)) - 1
    return (numbered.withColumn("_in", inside).join(offsets, [*group, "_b0"])
            .withColumn(out, (F.col("_offset") + F.col("_in")).cast("long"))
            .drop("_b0", "_in", "_offset"))


def range_rank(rows: DataFrame, group: list[str], order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """Number the rows of each group 1, 2, 3, ... in ``order``, however long a group or a run of ties in its first columns is.

    Sampled splitters deal the rows into ranges of (group, order), which are written once. A row's number is the rows of
    its group in the ranges before, by running counts over ranges, and its place in its range. So a group spans as many
    tasks as it needs; only rows equal in all of ``order`` stay together.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_place", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    return inside.join(before, [*group, "_range"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")
