"""N-gram Jaccard join by MinHash banding.

The n-grams of a text are its runs of five words (of all its words, if it has fewer). Texts with the same n-gram set
are one class, found by a 128-bit hash of the set. Of each class, min-hashes in bands are made; band and row counts
follow from the target recall at the threshold. Band hashes are shuffled; classes that share a band are candidates.

Candidates fall into clumps (connected by shared bands). The n-gram sets of a clump meet in blocks: each pair of blocks
is one task's work, where all pairs are compared on their full n-gram sets by matrix products. So every candidate pair
is verified once, however many bands it shares, without a row for any pair; what comes out is one row for each of the two
blocks, with lists: how many others a class links to, and the class that stands for its part of the links. The rows of
a block meet in one task, which adds up the counts and joins the parts, so a class gives one link, and a part one more.
A clump of m classes costs m * m comparisons, which exact link counts need.

Results: ``class_id`` is the smallest doc_id of the texts connected by links, ``copy_id`` the smallest doc_id with the
same n-gram set, ``n_links`` the number of other n-gram sets at the threshold or above. Null texts count as empty;
empty texts have the empty set, equal only to each other. Repeated rows are copies. A null doc_id never names a class
unless all its members have none. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as X
from .components import components
from .exact import stored

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
ROWS = 5
#: Most classes, and n-grams, of a block on average.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000
_COLUMNS = 4096


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` min-hashes so that a pair at ``similarity`` shares one with probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def set_names(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each n-gram set: two sums of mixed hashes, whatever their order. The empty set has 0, 0."""
    has = np.flatnonzero(counts)
    begin = np.concatenate([[0], np.cumsum(counts)])[has].astype(np.intp)
    sums = tuple(np.zeros(len(counts), np.uint64) for _ in range(2))
    if len(has):
        for k, s in enumerate(sums):
            s[has] = np.add.reduceat(X.mix(grams * np.uint64(0xA24BAED4963EE407 + 2 * k)), begin)
    return X.as_long(sums[0]), X.as_long(sums[1])


def gram_sets(c: X.Chunk, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of all texts, one after another, and how many each text has."""
    h = c.hashes()
    short = np.minimum(np.diff(c.first), n)  # texts of 1 to n - 1 words have one n-gram of all their words
    at, counts = c.windows(n)
    grams = X.rolling(h, n)[at] if len(at) else np.empty(0, np.uint64)
    few = np.flatnonzero((short > 0) & (counts == 0))
    owner = c.owner(counts)
    if len(few):
        grams = np.concatenate([grams, X.spans(h, c.first[few], c.first[few + 1])])
        owner = np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.bincount(owner, minlength=c.texts)


def _signed(similarity: float, recall: float, n: int, rows: int):
    bands = bands_for(similarity, recall, rows)
    multiply = np.random.default_rng(20240229).integers(1, 2**63, bands * rows, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column(1)):
                grams, counts = gram_sets(c, n)
                has = np.flatnonzero(counts)
                begin = np.concatenate([[0], np.cumsum(counts)])[has].astype(np.intp)
                keys = np.zeros((c.texts, bands), np.uint64)
                if len(has):
                    for b in range(bands):
                        key = np.full(len(has), b, np.uint64)
                        for m in multiply[b * rows:(b + 1) * rows]:
                            key = X.mix(key * np.uint64(31) + np.minimum.reduceat(grams * m, begin))
                        keys[has, b] = key
                own = batch.slice(c.row, c.texts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]), pa.int32()),
                    pa.array(X.as_long(keys[has].reshape(-1))))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), *map(pa.array, set_names(grams, counts)), pa.array(counts, pa.int64()), lists],
                    names=["id", "text_hash", "set_a", "set_b", "n_grams", "bands"])
    return work


def _sets(n: int):
    """Rows (node, clump, blocks, set_a, set_b, text) -> n-gram sets, where the text has the set it was looked up for."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column(5)):
                grams, counts = gram_sets(c, n)
                own = batch.slice(c.row, c.texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                                                 pa.array(X.as_long(grams)))
                a, b = set_names(grams, counts)
                same = (a == own.column(3).to_numpy()) & (b == own.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), lists],
                                                 names=["node", "clump", "blocks", "grams"]).filter(pa.array(same))
    return work


def _with_set(n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column(0)):
                own = batch.slice(c.row, c.texts)
                arrays = [*own.columns[1:], *map(pa.array, set_names(*gram_sets(c, n)))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names[1:], "set_a", "set_b"])
    return work


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.concatenate(left + right) if left and right else np.empty(0, np.int64)
    if not len(both):
        return out
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(both, kind="stable")
    both, owner = both[order], owner[order]
    new = np.concatenate([[True], both[1:] != both[:-1]])
    column = np.cumsum(new) - 1
    # only n-grams on both sides count
    sides = np.zeros((2, column[-1] + 1), bool)
    sides[(owner >= len(left)).astype(int), column] = True
    shared = sides.all(0)
    number = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = number[column[use]], owner[use]
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        grid = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        out += grid[:len(left)] @ grid[len(left):].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """True where the Jaccard similarity of two sets is ``similarity`` or more."""
    sizes = [np.array([len(x) for x in side], np.float64) for side in (left, right)]
    common = shared_counts(left, right).astype(np.float64)
    return (common >= similarity * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-9) & (common > 0)


_PART = "clump long, block int, node array<long>, to array<long>, n array<long>"


def _verified(similarity: float):
    """A pair of blocks -> for each of both: its classes with links, the smallest class of their part, their links."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        clump, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        _, once = np.unique(table["node"].to_numpy(), return_index=True)  # repeated rows give a class twice
        table = table.take(pa.array(once)).combine_chunks()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        values = table["grams"].chunk(0) if table["grams"].num_chunks else pa.array([], pa.list_(pa.int64()))
        flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        sets = [flat[at[i]:at[i + 1]] for i in range(len(node))]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        out: list[tuple] = []
        if len(left) and len(right):
            links = linked([sets[i] for i in left], [sets[i] for i in right], similarity)
            if low == high:
                np.fill_diagonal(links, False)
                grid, names = links, node[left]
            else:
                n = len(left)
                grid = np.zeros((n + len(right),) * 2, bool)
                grid[:n, n:], grid[n:, :n] = links, links.T
                names = np.concatenate([node[left], node[right]])
            degree, root = grid.sum(1), names.copy()
            seen = degree == 0
            for i in range(len(names)):
                if seen[i]:
                    continue
                part, front = np.zeros(len(names), bool), np.array([i])
                part[i] = True
                while len(front):
                    reach = grid[front].any(0) & ~part
                    part |= reach
                    front = np.flatnonzero(reach)
                seen |= part
                root[part] = names[part].min()
            for b, own in ((low, slice(0, len(left))), (high, slice(len(left), None))) if low != high else ((low, slice(None)),):
                has = degree[own] > 0
                if has.any():
                    out.append((clump, b, names[own][has], root[own][has], degree[own][has]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        lists = [pa.array(c, pa.list_(pa.int64())) for c in cols[2:]]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *lists], names=["clump", "block", "node", "to", "n"])
    return work


def _tallied(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All rows of a block -> (node, to, n): its classes once, with all their links, and a link for each part they are in."""
    node, to, n = (np.concatenate([np.asarray(x.as_py(), np.int64) for x in table[c]]) for c in ("node", "to", "n"))
    names, at = np.unique(np.concatenate([node, to]), return_inverse=True)
    a, b = at[:len(node)], at[len(node):]
    root = np.arange(len(names))
    while True:  # the smallest name of what hangs together
        small = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, small)
        np.minimum.at(new, b, small)
        new = new[new]
        if (new == root).all():
            break
        root = new
    links = np.bincount(a, n, minlength=len(names)).astype(np.int64)
    return pa.table({"node": names, "to": names[root], "n": links})


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                 n: int = WORDS, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copy_id, n_grams, n_links, keep), one row per row of ``docs``.

    ``keep`` marks the n-gram set, of all that links connect, that has the smallest doc_id (ties: the smallest hash).
    """
    joined = _joined(docs, id_col, text_col, similarity, n, recall, rows, block)
    return joined.select("doc_id", "class_id", "copy_id", "n_grams", "n_links", "keep")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                n: int = WORDS, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near duplicates is kept, whole and unchanged."""
    joined = _joined(docs, id_col, text_col, similarity, n, recall, rows, block)
    stay = joined.where("keep AND doc_id <=> copy_id").select(F.col("doc_id").alias("i"), F.col("set_a").alias("a"),
                                                              F.col("set_b").alias("b")).distinct()
    plain = docs.toDF(*[f"x{k}" for k in range(len(docs.columns))])
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*plain.schema.fields, T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType())])
    named = plain.select(plain[f"x{t}"].alias("t"), *plain.columns).mapInArrow(_with_set(n), schema)
    kept = (named.join(stay, (named["set_a"] == stay["a"]) & (named["set_b"] == stay["b"])
                       & named[f"x{i}"].cast("long").eqNullSafe(stay["i"]))
            .dropDuplicates(["set_a", "set_b", "i"]))
    return kept.select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(docs.columns)])


def _joined(docs, id_col, text_col, similarity, n, recall, rows, block) -> DataFrame:
    text = docs[text_col]
    texts = docs.select(docs[id_col].cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("text_hash"))
    made = texts.mapInArrow(_signed(similarity, recall, n, rows),
                            "id long, text_hash long, set_a long, set_b long, n_grams long, bands array<long>")
    signed = stored(made, "signed")
    members = signed.select("id", "set_a", "set_b", "n_grams")
    # A class is named by its smallest doc_id in results; inside, by one half of its set's hash.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))  # ids first, then none
    classes = (signed.groupBy("set_a", "set_b").agg(first.alias("first"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
               .withColumn("copy_id", F.col("first.id")).withColumn("text_hash", F.col("first.text_hash")).drop("first"))
    node = F.col("set_a").bitwiseXOR(F.shiftleft("set_b", 1))
    classes = stored(classes.withColumn("node", node), "classes")
    in_bands = classes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = in_bands.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = in_bands.join(hubs, ["band", "key"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clumps = components(near)
    found_in = clumps.join(classes.select("node", "copy_id", "text_hash", "set_a", "set_b", "n_grams"), "node")
    sizes = found_in.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_grams") / BLOCK_GRAMS))
                                         .cast("int").alias("blocks"))
    placed = found_in.join(sizes, "root").select("node", F.col("root").alias("clump"), "blocks", "set_a", "set_b",
                                                 F.col("copy_id").alias("id"), F.col("text_hash").alias("h"))
    # One text per class, by doc_id and hash of the text, so rows without an id, or with one id, do not meet in pairs.
    one = (placed.join(texts, placed["id"].eqNullSafe(texts["id"]) & (placed["h"] == texts["text_hash"]))
           .select("node", "clump", "blocks", "set_a", "set_b", "t"))
    sets = one.mapInArrow(_sets(n), "node long, clump long, blocks int, grams array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (sets.withColumn("block", own).withColumn("other", other)
             .select("clump", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "node", "block", "grams"))
    parts = dealt.groupBy("clump", "low", "high").applyInArrow(_verified(similarity), _PART)
    found = stored(parts.groupBy("clump", "block").applyInArrow(_tallied, "node long, to long, n long"), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    named = (classes.select("node", "set_a", "set_b", "copy_id").join(roots, "node", "left").join(counts, "node", "left")
             .withColumn("root", F.coalesce("root", "node")))
    order = F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "node")
    smallest = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min(order)["node"].alias("kept_node"))
    named = named.join(smallest, "root").select(
        "set_a", "set_b", "copy_id", "class_id", (F.col("node") == F.col("kept_node")).alias("keep"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return members.join(named, ["set_a", "set_b"]).withColumnRenamed("id", "doc_id")
