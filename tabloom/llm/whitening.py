"""Embedding whitening: projections on the leading components of the covariance, over their standard deviations.

Entries become whole numbers x = floor(256 c). The fit list is every distinct x vector once; it is written once. Its
moments are exact: vectors are centred by the whole number nearest to the mean of each dimension before they are
multiplied, the products are summed as whole numbers (in doubles where no sum can pass 2**53, else in Python's), each task
hands over one row of sums a dimension, and Spark adds them up. The rest of the mean is taken off the sums in exact
arithmetic. So neither the layout of the table nor the order of tasks moves the covariance by a bit. Its components come
from contour integration (see ``feast``). What the driver holds has the size of the dimension squared.

Vectors that are null, or hold a null or non-finite entry or one whose x does not fit 53 bits, are dropped, and so are
vectors whose length is not that of most vectors (ties: the longer). Components without variance (below 1e-12 of
all) are left out, so a table of equal vectors, or an empty one, gives no rows. Repeated rows and null vec_ids give
rows like others. ``deviation`` is null where it does not fit a long. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exact import stored
from .feast import largest

COMPONENTS, SCALE = 4, 256
_LIMIT = float(2**53)
_ROWS = 8192


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) -> (id, x), without vectors that cannot be used."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            lists = part.column(1)
            lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            flat = lists.flatten() if lists.null_count == 0 else lists.drop_null().flatten()
            lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(SCALE * values)
                fits = np.abs(x) < _LIMIT
            owner = np.repeat(np.arange(len(part)), lengths)
            bad = np.bincount(owner[~fits], minlength=len(part)) > 0
            keep = (lengths > 0) & ~bad
            kept = x[keep[owner]].astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths[keep])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))],
                                             names=["id", "x"])


def _rows(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), _ROWS):
        part = column.slice(at, _ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _sums(d: int):
    """(dimension, sum) of a task's vectors, as text: sums have no bound."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            for x in _rows(batch.column(0), d):
                n += len(x)
                part = x.sum(0) if np.abs(x).max(initial=0) < 2**62 // _ROWS else x.astype(object).sum(0)
                total = [a + int(b) for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(s) for s in [n, *total]])], names=["i", "s"])
    return work


def products(x: np.ndarray) -> np.ndarray:
    """x.T @ x in whole numbers, exact: doubles in blocks whose sums stay below 2**53, Python's numbers beyond."""
    most = int(np.abs(x).max(initial=0))
    rows = 2**53 // (most * most) if most else len(x)
    if rows < 8:
        big = x.astype(object)
        return big.T @ big
    total = np.zeros((x.shape[1],) * 2, np.int64)
    wide = np.zeros_like(total, dtype=object)
    for k, at in enumerate(range(0, len(x), rows)):
        part = x[at:at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
        if k % 512 == 511:  # 512 sums below 2**53 fit a long
            wide, total = wide + total, np.zeros_like(total)
    return wide + total


def _products(d: int, center: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d), object), False
        for batch in batches:
            for x in _rows(batch.column(0), d):
                total, seen = total + products(x - center), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([" ".join(map(str, row)) for row in total])],
                                             names=["i", "s"])
    return work


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = [np.array([int(s) for s in text.split()], object) for text in table["s"].to_pylist()]
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([" ".join(map(str, sum(rows[1:], rows[0])))])})


def _summed(frame: DataFrame) -> dict[int, list[int]]:
    """Rows of whole numbers added up by ``i``: on some tasks of each key first, then together."""
    part = (frame.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
            .groupBy("i", "part").applyInArrow(_added, "i int, s string"))
    return {r["i"]: [int(v) for v in r["s"].split()] for r in part.groupBy("i").applyInArrow(_added, "i int, s string").collect()}


def _whitened(mean: np.ndarray, turned: np.ndarray):
    return lambda x: (x - mean) @ turned


def _spread(d: int, mean: np.ndarray, turned: np.ndarray):
    """(first moments, second moments) of whitened vectors of a task."""
    project = _whitened(mean, turned)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turned.shape[1]
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _rows(batch.column(0), d):
                w = project(x)
                one, two = one + w.sum(0), two + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([one.tolist()], pa.list_(pa.float64())), pa.array([two.ravel().tolist()], pa.list_(pa.float64()))],
                                         names=["one", "two"])
    return work


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    far = max((n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))), 1)
    if far * far * len(sums) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def _output(d: int, n: int, sums: list[int], mean: np.ndarray, turned: np.ndarray, explained: list[float], error: float):
    project = _whitened(mean, turned)
    k = turned.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _rows(batch.column(1), d):
                m = len(x)
                ids = batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)), deviation,
                     pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m
    return work


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    spark = rows.sparkSession
    vectors = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast("array<double>").alias("v"))
    whole = vectors.mapInArrow(_whole, "id long, x array<long>")
    lengths = vectors.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    size = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], _RESULT)
    d = size["d"]
    used = whole.where(F.size("x") == d)
    fit = stored(used.select("x").distinct(), "fit-list")
    if fit.isEmpty():
        return spark.createDataFrame([], _RESULT)
    sums_of = {i: v[0] for i, v in _summed(fit.mapInArrow(_sums(d), "i int, s string")).items()}
    n, sums = sums_of[-1], [sums_of[i] for i in range(d)]
    center = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    product = _summed(fit.mapInArrow(_products(d, center), "i int, s string"))
    rest = [s - n * int(c) for s, c in zip(sums, center, strict=True)]  # what the centred vectors still add up to
    v = np.array([[float(Fraction(n * product[i][j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    values, basis = largest(spark, v, components)
    trace = float(np.trace(v))
    keep = values > 1e-12 * trace
    values, basis = values[keep], basis[:, keep]
    if not len(values):
        return spark.createDataFrame([], _RESULT)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    turned = basis / np.sqrt(values)
    moments = fit.mapInArrow(_spread(d, mean, turned), "one array<double>, two array<double>")
    k = len(values)
    one, two = (np.array(moments.select(*[F.sum(F.col(c)[i]) for i in range(m)]).first(), float) / n for c, m in (("one", k), ("two", k * k)))
    error = float(np.abs(two.reshape(k, k) - np.outer(one, one) - np.eye(k)).max())
    return used.mapInArrow(_output(d, n, sums, mean, turned, (values / trace).tolist(), error), _RESULT)
