"""Packing token streams into windows by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of ids (byte-level BPE, then END_ID after each document).
A window is at most WINDOW ids. It may end after a document (free), after a sentence (SENTENCE_CUT, for a document
that is cut) or, within a stretch without sentence ends, anywhere that STEP allows (HARD_CUT). A window costs its
padding up to WINDOW, nothing when its length is a power of two, and SEQUENCE for being one. The cuts with least total
cost are found exactly: over the last WINDOW ids the best start of a window that ends here is the front of a monotone
queue of (cost + place); starts at a power of two are looked up.

Each task packs what it reads and shuffles nothing; only its last window can be short for want of more text. A stream
is worked in blocks of about BLOCK_IDS, and the last window of a block is left open for the next one.

Null texts are empty documents: END_ID alone. Every row is a document of its own, also when rows or ids repeat. Empty
tables give no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW, END_ID = 2048, 1
SENTENCE_CUT, HARD_CUT, SEQUENCE, STEP = 16.0, 160.0, 32.0, 256
BLOCK_IDS = 300_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SPECIAL = "<|endoftext|>"
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


@cache
def encoder(name: str = "byte_bpe_50k"):
    """Text -> ids of the public vocabulary. The ranks give the same ids several times faster than the JSON form; texts
    with the special token's string, which only that form knows, or with huge words go through it."""
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(public.path(f"{name}.json"))

    def encode(text: str) -> np.ndarray:
        if _SPECIAL in text or _LONG_RUN.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)
    ends = np.zeros(max(ranks.values()) + 2, bool)
    for piece, i in ranks.items():
        ends[i] = piece.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n")
    return encode, ends


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, in order, and what a cut there costs. The first is 0, the last the stream's end."""
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_CUT
    cost[doc_ends] = 0.0
    cost[[0, total]] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > STEP)
    if len(wide):
        more = np.concatenate([np.arange(at[g] + STEP, at[g + 1], STEP) for g in wide])
        cost[more] = HARD_CUT
        at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the cuts with least total cost, from the first to the last candidate."""
    n = len(at)
    exact: list[list[int]] = [[] for _ in range(n)]
    size = 1
    while size <= window:
        place = np.searchsorted(at, at - size)
        for j in np.flatnonzero(at[np.minimum(place, n - 1)] == at - size).tolist():
            exact[j].append(int(place[j]))
        size *= 2
    places, costs = at.tolist(), cost.tolist()
    total, came = [0.0] * n, [0] * n
    queue: deque = deque([(0.0, 0)])
    for j in range(1, n):
        here = places[j]
        while places[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        best = value + window - here
        for k in exact[j]:
            if total[k] < best:
                best, i = total[k], k
        best += costs[j] + SEQUENCE
        total[j], came[j] = best, i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [places[-1]], n - 1
    while j:
        j = came[j]
        cuts.append(places[j])
    return cuts[::-1]


class Stream:
    """Documents that are not yet in a closed window."""

    def __init__(self, task: int):
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, ids of the document before those held here, ids held, all its ids
        self.size, self.task, self.number = 0, task, 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def pack(self, ends: np.ndarray, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([d[2] for d in self.docs])
        cuts = best_cuts(*candidates(ids, doc_ends, ends))
        if not last:
            cuts = cuts[:-1]  # the window that ends with the block stays open
        raw, out, doc, doc_start = ids.astype("<u4").tobytes(), [], 0, 0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            at = low
            while at < high:
                doc_id, before, held, every = self.docs[doc]
                end = min(high, doc_start + held)
                out.append((doc_id, before + at - doc_start, end - at, zlib.crc32(raw[4 * at:4 * end]), every,
                            (self.task << 33) + self.number, at - low))
                at = end
                if end == doc_start + held:
                    doc, doc_start = doc + 1, end
            self.number += 1
        rest = cuts[-1]
        left = []
        for doc_id, before, held, every in self.docs[doc:]:
            gone = max(0, rest - doc_start)
            left.append((doc_id, before + gone, held - gone, every))
            doc_start += held
        self.docs, self.ids, self.size = left, [ids[rest:]], len(ids) - rest
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, ends = encoder()
    ends = ends.copy()
    stream = Stream(TaskContext.get().partitionId())
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def out(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            stream.add(doc_id, np.append(encode(text.as_py() or ""), np.uint32(END_ID)))
            if stream.size >= BLOCK_IDS:
                rows = stream.pack(ends, False)
                if rows:
                    yield out(rows)
    rows = stream.pack(ends, True)
    if rows:
        yield out(rows)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces in SCHEMA: which ids of which document lie where in which sequence."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("t"))
    return rows.mapInArrow(_packed, SCHEMA)
