"""Substring dedup by recompression: words that stand in a run of 35 words which also starts anywhere else are removed.

1. Distinct texts are dealt once, by hash, to owners of about OWNER_BYTES each.
2. Every owner recompresses its texts (see ``recompress``) and sends the names of its last symbols to buckets. A bucket
   answers each owner which of its names other owners have too. A run of 35 words that stands twice holds the same
   symbols twice, wherever their deciding words lie within it; runs that hold no such symbol are candidates as well, so
   none is missed.
3. Owners send 128-bit hashes of all candidate runs, buckets answer which of them stand elsewhere: this verifies them.
4. Owners cover the words of repeated runs, and hash the words that are left.

A name or run goes to its bucket once from each owner, whatever the number of its places, so no passage makes a hot
key; nothing is paired. The texts are shuffled once: all steps read the same exchange.

Words are runs of anything but blanks. Null texts have no words. Texts shorter than the window lose nothing. Every row
of ``docs`` gives a row; repeated rows repeat each other's words, so they lose all of them. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import recompress as R, words as X

WINDOW = 35
OWNER_BYTES = 12_000_000
BUCKET_BYTES = 12_000_000
_KEYS = "bucket int, owner int, keys binary"
NO_WORDS = hashlib.sha256(b"").hexdigest()


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts in one task the first goes on; this keeps large groups of copies out of the shuffle."""
    seen: set = set()
    for batch in batches:
        new = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


def _distinct(table: pa.Table) -> pa.Table:
    pairs = np.stack([table["k1"].to_numpy(), table["k2"].to_numpy()], 1)
    _, at = np.unique(pairs, axis=0, return_index=True)
    return table.take(pa.array(np.sort(at))).combine_chunks()


def _texts(table: pa.Table) -> pa.Array:
    column = table["t"].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _sent(owner: int, buckets: int, keys: np.ndarray) -> pa.Table:
    """Sorted distinct keys (structured or plain), cut by bucket: by the leading bits, so each is one slice."""
    lead = keys["a"] if keys.dtype.names else keys
    # leading 31 bits times buckets / 2**31 keeps the order of the keys
    edges = np.searchsorted(lead, (np.arange(buckets + 1, dtype=object) * 2**64 // buckets).clip(0, 2**64 - 1).astype(np.uint64))
    edges[-1] = len(keys)
    used = [b for b in range(buckets) if edges[b + 1] > edges[b]]
    return pa.table({"bucket": pa.array(used, pa.int32()), "owner": pa.array([owner] * len(used), pa.int32()),
                     "keys": pa.array([keys[edges[b]:edges[b + 1]].tobytes() for b in used], pa.binary())})


_PAIR = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _met(kind: np.dtype):
    """The keys of a bucket that two or more owners sent, back to each of them."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owners = table["owner"].to_pylist()
        parts = [np.frombuffer(x.as_py(), kind) for x in table["keys"]]
        every = np.concatenate(parts)
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.lexsort((every["b"], every["a"])) if kind.names else np.argsort(every, kind="stable")
        every, source = every[order], source[order]
        same = every[1:] == every[:-1]
        twice = np.zeros(len(every), bool)
        twice[1:] |= same
        twice[:-1] |= same
        every, source = every[twice], source[twice]
        back = [(owners[s], every[source == s].tobytes()) for s in np.unique(source)] if len(owners) < 64 else \
            _by_source(owners, every, source)
        return pa.table({"owner": pa.array([o for o, _ in back], pa.int32()), "keys": pa.array([k for _, k in back], pa.binary())})
    return work


def _by_source(owners, every, source):
    order = np.argsort(source, kind="stable")
    every, source = every[order], source[order]
    at = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.empty(0, int)
    return [(owners[source[i]], every[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(source)], strict=True)]


def _anchors(c: X.Chunk, width: int):
    """Names of symbols whose deciding words fit a window, and the first and last window start that holds them."""
    h = c.hashes()
    name, lo, hi = R.symbols(h, c.first)
    fit = (hi - lo <= width) & (lo >= 0)
    name, lo, hi = name[fit], lo[fit], hi[fit]
    text = np.searchsorted(c.first, lo, "right") - 1
    early = np.maximum(hi - width, c.first[text])
    late = np.minimum(lo, c.first[text + 1] - width)
    name = X.mix(name + X.spans(h, lo, hi))
    has = early <= late
    return h, name[has], early[has], late[has]


def _marked(n: int, early: np.ndarray, late: np.ndarray) -> np.ndarray:
    """True at positions within any early..late."""
    steps = np.bincount(early, minlength=n + 1)[:n + 1] - np.bincount(late + 1, minlength=n + 1)[:n + 1]
    return np.cumsum(steps)[:n] > 0


def _runs(c: X.Chunk, h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(at), _PAIR)
    out["a"] = X.spans(h, at, at + width)
    out["b"] = X.spans(c.hashes(2), at, at + width, 0x2545F4914F6CDD1D)
    return out


def _distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each stands."""
    if keys.dtype.names:
        keys = keys[np.lexsort((keys["b"], keys["a"]))]
    else:
        keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


def _send_names(buckets: int, width: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = [np.empty(0, np.uint64)]
        for c in X.chunks(_texts(_distinct(table))):
            names.append(_distinct_keys(_anchors(c, width)[1])[0])
        return _sent(key[0].as_py(), buckets, _distinct_keys(np.concatenate(names))[0])
    return work


def _send_runs(buckets: int, width: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, buckets, np.empty(0, _PAIR))
        abroad = [np.frombuffer(x.as_py(), np.uint64) for x in answers["keys"]]
        parts = list(X.chunks(_texts(_distinct(table))))
        found = [_anchors(c, width) for c in parts]
        own, times = _distinct_keys(np.concatenate([np.empty(0, np.uint64), *[f[1] for f in found]]))
        known = np.sort(np.concatenate([own[times > 1], *abroad]))
        runs = [np.empty(0, _PAIR)]
        for c, (h, name, early, late) in zip(parts, found, strict=True):
            starts, _ = c.windows(width)
            twice = _within(known, name)
            candidate = ~_marked(len(h), early, late) | _marked(len(h), early[twice], late[twice])
            runs.append(_runs(c, h, starts[candidate[starts]], width))
        own, times = _distinct_keys(np.concatenate(runs))
        sent = _sent(key[0].as_py(), buckets, own)
        here = own[times > 1]  # stands twice with this owner already: told to itself
        return pa.concat_tables([sent, _own(key[0].as_py(), here)])
    return work


def _own(owner: int, keys: np.ndarray) -> pa.Table:
    return pa.table({"bucket": pa.array([-1 - owner] if len(keys) else [], pa.int32()),
                     "owner": pa.array([owner] if len(keys) else [], pa.int32()),
                     "keys": pa.array([keys.tobytes()] if len(keys) else [], pa.binary())})


def _within(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    return known[np.minimum(at, len(known) - 1)] == keys


def _met_runs():
    answer = _met(_PAIR)

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return table.select(["owner", "keys"]) if key[0].as_py() < 0 else answer(key, table)
    return work


def _cover(width: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known = np.concatenate([np.empty(0, _PAIR), *[np.frombuffer(x.as_py(), _PAIR) for x in answers["keys"]]])
        known = known[np.argsort(known["a"], kind="stable")] if len(known) else known
        table = _distinct(table) if table.num_rows else table
        k1, k2 = table["k1"].to_pylist(), table["k2"].to_pylist()
        for c in X.chunks(_texts(table)) if table.num_rows else []:
            starts, _ = c.windows(width)
            gone = np.zeros(len(c.start), bool)
            if len(known) and len(starts):
                h = c.hashes()
                near = _within(known["a"], X.spans(h, starts, starts + width))
                at = starts[near]
                runs = _runs(c, h, at, width)
                # equal first halves lie together; nearly always there is one
                low, high = np.searchsorted(known["a"], runs["a"]), np.searchsorted(known["a"], runs["a"], "right")
                same = np.zeros(len(at), bool)
                for step in range(int((high - low).max()) if len(at) else 0):
                    same |= (low + step < high) & (known["b"][np.minimum(low + step, len(known) - 1)] == runs["b"])
                at = at[same]
                gone = _marked(len(gone), at, at + width - 1)
            removed = np.add.reduceat(np.append(gone, 0).astype(np.int64), c.first[:-1]) * (np.diff(c.first) > 0)
            for t in range(c.texts):
                parts = c.raw(t).split()
                if removed[t]:
                    parts = list(compress(parts, (~gone[c.first[t]:c.first[t + 1]]).tolist()))
                out.append((k1[c.row + t], k2[c.row + t], int(c.first[t + 1] - c.first[t]), int(removed[t]),
                            hashlib.sha256(b" ".join(parts)).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({n: pa.array(v, pa.string() if n == "kept_sha256" else pa.int64()) for n, v in
                         zip(["k1", "k2", "n_words", "n_removed", "kept_sha256"], columns, strict=True)})
    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    owners, buckets = max(1, math.ceil(size / OWNER_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    # two hashes of the text name it
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
    texts = (docs.select(*keys, text.alias("t")).mapInArrow(_first_copies, "k1 long, k2 long, t string")
             .withColumn("owner", F.pmod("k1", F.lit(owners)).cast("int")))
    names = texts.groupBy("owner").applyInArrow(_send_names(buckets, width), _KEYS)
    shared = names.groupBy("bucket").applyInArrow(_met(np.dtype(np.uint64)), "owner int, keys binary")
    runs = texts.groupBy("owner").cogroup(shared.groupBy("owner")).applyInArrow(_send_runs(buckets, width), _KEYS)
    repeated = runs.groupBy("bucket").applyInArrow(_met_runs(), "owner int, keys binary")
    covered = texts.groupBy("owner").cogroup(repeated.groupBy("owner")).applyInArrow(
        _cover(width), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), *keys)
    times = rows.groupBy("k1", "k2").agg(F.count("*").alias("times"))
    per_text = covered.join(times, ["k1", "k2"])
    gone = (F.col("times") > 1) & (F.col("n_words") >= width)  # a copy repeats every run of its text
    per_text = per_text.select("k1", "k2", "n_words", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                               F.when(gone, F.lit(NO_WORDS)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    return rows.join(per_text, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")
