"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

As the threshold is the same for all texts, a text's fingerprint is a fixed part of its shingle set: fingerprints merge
by union, and the share of one found in another estimates containment however unequal the two texts are. Shingles are
runs of five words (all words of a text that has fewer); words are runs of anything but blanks.

A fingerprint is ``<name>.<hashes>``: the name is a 64-bit hash of the whole shingle set, the hashes are sorted 64-bit
numbers in base64. Short texts may keep no hash; then the names decide (1.0 if equal, else 0.0). Null texts count as
empty. Repeated rows have equal fingerprints. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as X
from .jaccard import gram_sets, set_names

FRACTION = 1 / 4
RANGE_BYTES = 16_000_000


def sketches(texts: pa.Array, fraction: float = FRACTION) -> tuple[list[np.ndarray], list[int]]:
    """Kept hashes and set name of every text."""
    below = np.uint64(min(int(fraction * 2**64), 2**64 - 1))
    kept, names = [], []
    for c in X.chunks(texts):
        grams, counts = gram_sets(c)
        use = grams < below
        owner = c.owner(counts)[use]
        kept += np.split(grams[use], np.searchsorted(owner, np.arange(1, c.texts)))
        names += (set_names(grams, counts)[0].view(np.uint64)).tolist()
    return kept, names


def written(hashes: np.ndarray, name: int) -> str:
    return f"{name:016x}.{base64.b64encode(hashes.astype('<u8').tobytes()).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    name, _, rest = fingerprint.partition(".")
    return int(name, 16), np.frombuffer(base64.b64decode(rest), "<u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kept hashes of two texts put together."""
    return np.union1d(a, b)


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """Estimated share of the part's shingles that the whole has."""
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part) if len(part) else 0.0


def likeness(a: np.ndarray, a_name: int, b: np.ndarray, b_name: int) -> float:
    """1.0 for equal shingle sets; else the share of the smaller fingerprint found in the larger."""
    if a_name == b_name:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return containment(small, large)


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to as much of the start of the next one."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _ranged(splitters: list[int], top: int | None):
    """Rows with the range they stand in; the first row of a range also ends the range before it in the order."""
    cuts = np.array(splitters, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            values = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            place = np.where(known, np.searchsorted(cuts, values), 0)

            def rows(at: np.ndarray, ranges: np.ndarray, extra: bool) -> pa.RecordBatch:
                part = batch.take(pa.array(at))
                return pa.RecordBatch.from_arrays(
                    [pa.array(ranges, pa.int32()), pa.array([extra] * len(at), pa.bool_()), *part.columns],
                    names=["range_no", "extra", "id", "t"])
            yield rows(np.arange(len(values)), place, False)
            if len(cuts):
                first = np.flatnonzero(known & (place < len(cuts)) & (cuts[np.minimum(place, len(cuts) - 1)] == values))
                if len(first):
                    yield rows(first, place[first] + 1, True)
                start = np.flatnonzero(known & (values == top))
                if len(start):  # after the last comes the first
                    yield rows(start, np.zeros(len(start), int), True)
    return work


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(fraction: float):
    def out(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        """Rows (id, text, text of the next)."""
        texts = [r[1] for r in rows]
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        n = len(texts)
        kept, names = sketches(pa.array(texts + changed + following, pa.large_string()), fraction)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([written(kept[i], names[i]) for i in range(n)]),
            pa.array([written(kept[i], names[i]) for i in range(n, 2 * n)]),
            pa.array([likeness(kept[i], names[i], kept[n + i], names[n + i]) for i in range(n)], pa.float64()),
            pa.array([likeness(kept[i], names[i], kept[2 * n + i], names[2 * n + i]) for i in range(n)], pa.float64())], names=_OUT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        for batch in batches:
            at, _ = X.text_bytes(batch.column(3))
            for a, b in X.slices(at):
                part = batch.slice(a, b - a)
                rows, following = [], []
                for r in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    first = r if first is None or first[0] != r[0] else first
                    if held is not None and held[0] == r[0] and not held[1]:
                        rows.append(held[2:])
                        following.append(r[3])
                    elif held is not None and not held[1]:
                        raise AssertionError("a range ends without the row that follows")
                    held = r
                if rows:
                    yield out(rows, following)
        if held is not None and not held[1]:  # the only range: the last row's next is the first
            yield out([held[2:]], [first[3]])
    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """One row per row of ``docs`` in SCHEMA; the next document is the one with the next smaller doc_id (ties: by text;
    null last; after the last comes the first)."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    size = rows.select(F.sum(F.octet_length("t")).alias("n"), F.max("id").alias("top")).first()
    ranges = max(1, math.ceil((size["n"] or 0) / RANGE_BYTES))
    cuts: list[int] = []
    if ranges > 1 and size["top"] is not None:  # ids that stand in the table, so each range begins with a known row
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.select(F.percentile_approx("id", shares, max(10_000, 20 * ranges)).alias("p")).first()["p"]))
    dealt = rows.mapInArrow(_ranged(cuts, size["top"]), "range_no int, extra boolean, id long, t string")
    n = max(len(cuts) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(n, "range_no").sortWithinPartitions(
        "range_no", "extra", F.col("id").desc_nulls_last(), "t")
    return ordered.mapInArrow(_pairs(fraction), SCHEMA)
