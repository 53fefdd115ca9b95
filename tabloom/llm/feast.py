"""Eigenvalues of a symmetric matrix in intervals, by contour integration (FEAST), with counts by inertia.

For an interval a..b of the eigenvalue axis, the integral of the resolvent (z I - V)^-1 over a circle through a and b
is the projector onto the eigenvectors that belong to eigenvalues between them. Gauss-Legendre quadrature on the upper
half circle (V is real, so the lower half is its conjugate) turns it into one complex shifted solve a node, applied to
a block of vectors. Rayleigh-Ritz on the projected block extracts eigenpairs; the block is projected again until their
residuals are at rounding level. The solves of all intervals and nodes are independent of each other: they are rows of
a Spark job, and a block of vectors a row comes back.

By Sylvester's law the signs of the pivots of V - s I tell how many eigenvalues lie above s. These counts choose the
intervals (halved until each holds few eigenvalues, or is as narrow as rounding allows), and verify afterwards that each
interval gave as many eigenpairs as it holds; where not, its block is widened and projected again.

The matrix has the size of the dimension, whatever the number of rows it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

NODES, PER_INTERVAL, ROUNDS = 8, 6, 40


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` exceed ``shift``: positive pivots of a symmetric elimination (Bunch-Parlett)."""
    a = v - shift * np.eye(len(v))
    floor = np.finfo(float).eps * max(1e-300, np.abs(v).max(initial=0.0) + abs(shift))
    positive = 0
    while len(a):
        d = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i = int(d.argmax())
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if d[i] >= 0.6403882 * off[p, q]:
            pivot = a[i, i]
            if abs(pivot) <= floor:
                return positive  # what is left is zero
            positive += pivot > 0
            keep = np.delete(np.arange(len(a)), i)
            a = a[np.ix_(keep, keep)] - np.outer(a[keep, i], a[i, keep]) / pivot
        else:  # a block of two with one eigenvalue of each sign
            positive += 1
            keep = np.delete(np.arange(len(a)), [p, q])
            block, side = a[np.ix_([p, q], [p, q])], a[np.ix_(keep, [p, q])]
            a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def intervals(v: np.ndarray, most: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within), from the top down, that hold the ``most`` largest eigenvalues at least."""
    radius = np.abs(v).sum(1).max()  # no eigenvalue lies outside -radius..radius
    top = radius * (1 + 1e-12) + 1e-300
    narrow = 64 * np.finfo(float).eps * top
    out: list[tuple[float, float, int]] = []
    todo = [(-top, top, 0, len(v))]  # (low, high, eigenvalues above high, above low)
    while todo and sum(c for _, _, c in out) < most:
        low, high, over, under = todo.pop()
        if under == over:
            continue
        if under - over <= per or high - low <= narrow:
            out.append((low, high, under - over))
            continue
        mid = (low + high) / 2
        n = min(max(above(v, mid), over), under)
        todo += [(low, mid, n, under), (mid, high, over, n)]
    return out


def _solved(v: np.ndarray, blocks: list[np.ndarray]):
    nodes, weights = np.polynomial.legendre.leggauss(NODES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, j, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                angle = np.pi / 2 * (1 + nodes[j])
                center, radius = (low + high) / 2, (high - low) / 2
                turn = np.exp(1j * angle)
                shifted = (center + radius * turn) * np.eye(len(v)) - v
                part = (weights[j] / 2 * radius * turn * np.linalg.solve(shifted, blocks[k].astype(complex))).real
                out.append(np.ascontiguousarray(part).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["k", "j", "part"])
    return work


def _projected(spark: SparkSession, v: np.ndarray, spans: list[tuple[float, float]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each block through the projector of its interval; a task for each solve."""
    points = [(k, j, float(low), float(high)) for k, (low, high) in enumerate(spans) for j in range(NODES)]
    frame = spark.createDataFrame(points, "k int, j int, low double, high double").repartition(min(len(points), spark.sparkContext.defaultParallelism))
    out = [np.zeros_like(b) for b in blocks]
    for r in sorted(frame.mapInArrow(_solved(v, blocks), "k int, j int, part binary").collect(), key=lambda r: (r["k"], r["j"])):
        out[r["k"]] += np.frombuffer(r["part"]).reshape(blocks[r["k"]].shape)
    return out


def _ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, s, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, s > 1e-12 * s.max(initial=0.0)]
    values, turn = np.linalg.eigh(q.T @ v @ q)
    return values, q @ turn


def largest(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and unit eigenvectors in columns; fewer if the matrix has fewer rows."""
    k = min(k, len(v))
    spans = intervals(v, k)
    edge = np.finfo(float).eps * 256 * (np.abs(v).sum(1).max() if len(v) else 0.0)
    rng = np.random.default_rng(13)
    blocks = [rng.standard_normal((len(v), min(len(v), 2 * n + 4))) for _, _, n in spans]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for turn in range(ROUNDS):
        open_ = [i for i in range(len(spans)) if i not in found]
        if not open_:
            break
        # circles through the ends; those of an interval as narrow as rounding get room
        rooms = [(spans[i][0] - edge, spans[i][1] + edge) for i in open_]
        for i, block in zip(open_, _projected(spark, v, rooms, [blocks[i] for i in open_]), strict=True):
            low, high, n = spans[i]
            values, vectors = _ritz(v, block)
            inside = np.argsort(-values)
            inside = inside[(values[inside] > low - edge) & (values[inside] <= high + edge)]
            left = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            good = inside[left <= edge]
            if len(good) >= n:  # as many as the inertia counts say
                found[i] = values[good[:n]], vectors[:, good[:n]]
            elif turn % 8 == 7 and blocks[i].shape[1] < len(v):
                wide = min(len(v), 2 * blocks[i].shape[1])
                blocks[i] = np.hstack([vectors, rng.standard_normal((len(v), wide - vectors.shape[1]))])
            else:
                blocks[i] = vectors
    missed = [spans[i] for i in range(len(spans)) if i not in found]
    if missed:
        raise ArithmeticError(f"eigenvalues not found within {missed}")
    if not found:
        return np.empty(0), np.empty((len(v), 0))
    # one basis for all intervals, orthonormal to rounding
    values, vectors = _ritz(v, np.hstack([found[i][1] for i in range(len(spans))]))
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order]
