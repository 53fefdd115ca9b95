"""Language-model scores of texts: a word-count base, and a causal self-attention model over subword ids.

Training texts are those whose crc32(doc_id) mod 5 is not 1. The base needs the count of every word over all of them.
Texts are dealt to owners (as in ``repeats``); an owner sends each of its distinct words once, with its own count, to
the bucket of the word's hash, and gets the total counts back in the same order. A frequent word thus meets its bucket
once from each owner, whatever the number of its places. How many words and tokens all buckets hold is one sum more. The
attention model's class shares come from the subword counts of all training texts, and
its weights are learned from all of them: each task learns from every text it reads, long ones in windows, and the
weights are averaged, each row by how many places it served, so an id that few tasks meet still counts. There are
ROUNDS rounds, each over its part of the texts by hash, each beginning with the mean of the one before; together they
read every training text once, and steps grow with the corpus. Only the start values come from a bounded sample, worked
out on the driver: SAMPLE training texts, first by a hash of doc_id, of at most SAMPLE_IDS ids. The weights depend a
little on how rows are dealt to tasks.

Words are lower-cased (A-Z) runs of anything but blanks; each text has one END token more. Null texts count as empty.
Rows with a null doc_id count as training texts. Repeated rows are scored, and counted, each. Without training texts
all counts are 0. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import attention as A, words as X
from .exact import stored
from .packing import encoder
from .repeats import _distinct, _first_copies, _texts

FOLDS, HELD_OUT = 5, 1
SAMPLE, SAMPLE_IDS = 600, 8000
ROUNDS, BLOCK_ROWS = 2, 256
OWNER_BYTES, BUCKET_BYTES = 12_000_000, 24_000_000
#: Stands for END among word hashes.
_END_WORD = np.uint64(0x5E4D3C2B1A090807)
_SENT = "bucket int, owner int, keys binary, counts binary"
_SAID = "owner int, bucket int, counts binary, kinds long, tokens long"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


# --- the attention model ---

def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each text, two bytes each (the vocabulary is smaller than that)."""
    encode, _ = encoder()
    for batch in batches:
        at, _ = X.text_bytes(batch.column(4))
        for a, b in X.slices(at):
            part = batch.slice(a, b - a)
            ids = [encode(t.as_py()).astype("<u2").tobytes() for t in part.column(4)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(ids, pa.binary())], names=["doc_id", "held_out", "k1", "k2", "ids"])


def _ids(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<u2")


def _subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(A.VOCABULARY, np.int64)
    for batch in batches:
        counts[A.END] += len(batch)
        for value in batch.column(0):
            counts += np.bincount(_ids(value), minlength=A.VOCABULARY) if len(value.as_py()) > 50_000 else 0
        few = [_ids(v) for v in batch.column(0) if len(v.as_py()) <= 50_000]
        counts += np.bincount(np.concatenate([np.empty(0, np.int64), *few]).astype(np.int64), minlength=A.VOCABULARY)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["id", "n"])


def _learned(model: A.Model):
    """What the texts of a task move the weights by, in blocks of BLOCK_ROWS rows that were used."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, task = A.Learner(model), TaskContext.get().partitionId()
        for batch in batches:
            size = np.concatenate([[0], np.cumsum([len(x.as_py()) for x in batch.column(0)])])
            for a, b in X.slices(size, X.CHUNK_BYTES // 8):
                learner.read([_ids(x) for x in batch.column(0).slice(a, b - a)])
        moved, uses = learner.moved()
        at = [k for k in range(0, len(uses), BLOCK_ROWS) if uses[k:k + BLOCK_ROWS].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k // BLOCK_ROWS for k in at], pa.int32()), pa.array([task] * len(at), pa.int32()),
             pa.array([moved[k:k + BLOCK_ROWS].astype("<f4").tobytes() for k in at], pa.binary()),
             pa.array([uses[k:k + BLOCK_ROWS].astype("<f8").tobytes() for k in at], pa.binary())], names=["block", "task", "moved", "uses"])
    return work


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("task")  # sums do not depend on which task was done first
    moved, uses = (sum(np.frombuffer(x.as_py(), t).astype(np.float64) for x in table[c]) for c, t in (("moved", "<f4"), ("uses", "<f8")))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "moved": pa.array([moved.tobytes()], pa.binary()),
                     "uses": pa.array([uses.tobytes()], pa.binary())})


def learned(rows: DataFrame, model: A.Model) -> A.Model:
    """The mean of what all tasks learn from ``rows`` (ids); tables of the model's size come back."""
    blocks = rows.select("ids").mapInArrow(_learned(model), "block int, task int, moved binary, uses binary")
    moved = np.zeros_like(A.in_rows(model), np.float64)
    uses = np.zeros(len(moved))
    for r in blocks.groupBy("block").applyInArrow(_added, "block int, moved binary, uses binary").collect():
        at = slice(r["block"] * BLOCK_ROWS, (r["block"] + 1) * BLOCK_ROWS)
        moved[at] = np.frombuffer(r["moved"], np.float64).reshape(-1, A.WIDTH)
        uses[at] = np.frombuffer(r["uses"], np.float64)
    return A.merged(model, moved, uses)


def train(encoded: DataFrame) -> A.Model:
    """Subword counts and weights from all training texts; the sample gives the weights to start with."""
    rows = encoded.where("NOT held_out")
    counts = np.zeros(A.VOCABULARY)
    for r in rows.select("ids").mapInArrow(_subwords, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    first = rows.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = rows.join(F.broadcast(first), "doc_id").where(F.octet_length("ids") <= 2 * SAMPLE_IDS).select("doc_id", "ids").collect()
    model = A.train([np.frombuffer(r["ids"], "<u2") for r in sorted(texts, key=lambda r: (r["doc_id"], bytes(r["ids"])))], counts)
    part = F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        model = learned(rows.where(part == k), model)
    return model


def _modelled(model: A.Model):
    """Adds the model's score; of equal texts in one task the first is worked out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = A.Scorer(model), {}
        for batch in batches:
            size = np.concatenate([[0], np.cumsum([len(x.as_py()) for x in batch.column(4)])])
            for a, b in X.slices(size, X.CHUNK_BYTES // 2):
                part = batch.slice(a, b - a)
                keys = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                new = {key: i for i, key in reversed(list(enumerate(keys))) if key not in known}
                found = scorer.log10_probability([_ids(part.column(4)[i]) for i in new.values()])
                known.update(zip(new, found.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([known[k] for k in keys], pa.float64())],
                                                 names=["doc_id", "held_out", "k1", "k2", "score"])
    return work


# --- word counts ---

def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    cuts = np.array([i * 2**64 // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def _kinds(parts: list[X.Chunk]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct word hashes of an owner's texts with END, and for each chunk the hashes of its words."""
    own = [c.hashes() for c in parts]
    every = np.sort(np.concatenate([np.array([_END_WORD]), *own]))
    return every[np.concatenate([[True], every[1:] != every[:-1]])], own


def _send(buckets: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, times: pa.Table) -> pa.Table:
        owner = key[0].as_py()
        table = _distinct(table) if table.num_rows else table
        many = dict(zip(zip(times["k1"].to_pylist(), times["k2"].to_pylist(), strict=True), times["n"].to_pylist(), strict=True))
        weight = np.array([many.get(k, 0) for k in zip(table["k1"].to_pylist(), table["k2"].to_pylist(), strict=True)], np.float64)
        parts = list(X.chunks(_texts(table), X.BLANKS, X.LOWER)) if table.num_rows else []
        keys, own = _kinds(parts)
        counts = np.zeros(len(keys))
        for c, h in zip(parts, own, strict=True):
            counts += np.bincount(np.searchsorted(keys, h), weight[c.row:c.row + c.texts][c.owner()], minlength=len(keys))
        counts[np.searchsorted(keys, _END_WORD)] += weight.sum()
        counts, at = counts.astype(np.int64), _edges(keys, buckets)
        used = np.flatnonzero(np.diff(at)).tolist()  # rows follow the words sent, not owners times buckets
        return pa.table({"bucket": pa.array(used, pa.int32()), "owner": pa.array([owner] * len(used), pa.int32()),
                         "keys": pa.array([keys[at[b]:at[b + 1]].tobytes() for b in used], pa.binary()),
                         "counts": pa.array([counts[at[b]:at[b + 1]].tobytes() for b in used], pa.binary())})
    return work


def _total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]]) if len(every) else np.empty(0, bool)
    number = np.empty(len(every), np.int64)
    number[order] = np.cumsum(new) - 1
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])
    total = np.zeros(int(new.sum()), np.int64)
    np.add.at(total, number, counts)
    back = np.split(total[number], np.cumsum([len(k) for k in keys])[:-1])
    n = table.num_rows
    first = [1] + [0] * (n - 1)  # the bucket's own numbers stand in one of its rows
    return pa.table({"owner": table["owner"], "bucket": pa.array([key[0].as_py()] * n, pa.int32()),
                     "counts": pa.array([x.tobytes() for x in back], pa.binary()),
                     "kinds": pa.array([int((total > 0).sum()) * f for f in first], pa.int64()),
                     "tokens": pa.array([int(total.sum()) * f for f in first], pa.int64())})


def _base(tokens: int, kinds: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        return _scored(table, said, tokens, kinds)
    return work


def _scored(table: pa.Table, said: pa.Table, tokens: int, kinds: int) -> pa.Table:
    names = ["k1", "k2", "n_tokens", "n_known", "train_tokens", "base_score"]
    rows: list[list] = [[] for _ in names]
    if table.num_rows:
        table = _distinct(table)
        parts = list(X.chunks(_texts(table), X.BLANKS, X.LOWER))
        keys, own = _kinds(parts)
        said = said.sort_by("bucket")
        counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in said["counts"]])
        gain = np.log10(counts + 0.5) - math.log10(tokens + 0.5 * (kinds + 1))
        end = int(np.searchsorted(keys, _END_WORD))
        for c, h in zip(parts, own, strict=True):
            at, owner = np.searchsorted(keys, h), c.owner()
            rows[2] += (np.diff(c.first) + 1).tolist()
            rows[3] += (np.bincount(owner, counts[at] > 0, minlength=c.texts) + (counts[end] > 0)).astype(int).tolist()
            rows[5] += (np.bincount(owner, gain[at], minlength=c.texts) + gain[end]).tolist()
        rows[0], rows[1] = table["k1"].to_pylist(), table["k2"].to_pylist()
        rows[4] = [tokens] * len(rows[0])
    return pa.table({n: pa.array(v, pa.float64() if n == "base_score" else pa.int64()) for n, v in zip(names, rows, strict=True)})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    owners, buckets = max(1, math.ceil(size / OWNER_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]
    doc_id = docs[id_col].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), *keys, text.alias("t"))
    # Ids are made once: for the subword counts, for training, and for scoring.
    encoded = stored(rows.mapInArrow(_encoded, "doc_id long, held_out boolean, k1 long, k2 long, ids binary"), "subwords")
    modelled = encoded.mapInArrow(_modelled(train(encoded)), "doc_id long, held_out boolean, k1 long, k2 long, score double")
    owner = F.pmod("k1", F.lit(owners)).cast("int")
    texts = rows.select("k1", "k2", "t").mapInArrow(_first_copies, "k1 long, k2 long, t string").withColumn("owner", owner)
    times = encoded.groupBy("k1", "k2").agg(F.sum((~F.col("held_out")).cast("long")).alias("n")).withColumn("owner", owner)
    sent = texts.groupBy("owner").cogroup(times.groupBy("owner")).applyInArrow(_send(buckets), _SENT)
    said = stored(sent.groupBy("bucket").applyInArrow(_total, _SAID), "word-counts")
    tokens, kinds = said.agg(F.sum("tokens"), F.sum("kinds")).first()
    base = texts.groupBy("owner").cogroup(said.groupBy("owner")).applyInArrow(
        _base(tokens or 0, kinds or 0), "k1 long, k2 long, n_tokens long, n_known long, train_tokens long, base_score double")
    return modelled.join(base, ["k1", "k2"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
