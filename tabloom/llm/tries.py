"""Prefix trie of conversations: members, children, leaves and savings of every shared beginning.

1. Turns (role, text) are encoded by a dictionary: distinct SHA-256 values of turns, numbered once and written. A
   conversation is from then on a list of numbers, with the code points of each text beside it.
2. Equal lists become one sequence with its number of conversations, the smallest, and the hash of all their ids. For
   that, conversations are sorted by (hash of the list, id) in sampled ranges, so a group of copies spans as many ranges
   as it needs; runs that can go on in another range are hashed once more, as a stream of joined ids.
3. Sequences are dealt to range shards in lexicographic order. A shard holds its sorted sequences as a ternary search
   tree (a node compares one turn number: less, equal, greater), balanced by inserting medians first. One iterative
   traversal orders the nodes, and from the last to the first they pass members, leaves and savings to their parents.
4. Only nodes on the paths of a shard's first and last sequence can go on in another shard. They are passed on as two
   sequences a shard, each node with what its finished subtrees gave, and merged by the same step in fewer shards, until
   one is left. Finished nodes below an unfinished one learn its smallest conversation by a join on a hash of its path.

Null roles and texts count as empty. Turns with the same number follow the order of their hashes. Rows without a
conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table gives no rows.
One conversation's numbers (12 bytes a turn) are held in one row. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.common import salted_lookup
from .exact import stored

FAMILY, HEADS = 100, 6
#: Most turn numbers of a shard on average, and most ids of a joined piece.
SHARD_IDS, PIECE = 250_000, 50_000
NOBODY = hashlib.sha256(b"").hexdigest()
_SEQUENCE = "ids array<long>, lens array<int>, n long, least long, ends string"
_OPEN = "k1 long, k2 long, range_no int, part int, piece string, " + _SEQUENCE
_OWN = ["own_n", "own_least", "own_leaves", "own_saved", "own_children"]
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "node_key binary, parent_key binary, ids array<long>, lens array<int>, " + ", ".join(f"{c} array<long>" for c in _OWN) + ", own_ends array<string>")
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_NODE_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
               "array<string>": pa.list_(pa.string())}


# --- conversations as lists of turn numbers ---

def encoded(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids, lens): each conversation's turns in order, as dictionary numbers, with the code points of their texts."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = stored(conversations.where(conversations[id_col].isNotNull())
                   .select(conversations[id_col].cast("long").alias("conv_id"), conversations[turn_col].alias("turn"), named.alias("sha"),
                           F.char_length(text).alias("len")), "turns")
    dictionary = stored(turns.select("sha").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    numbered = salted_lookup(turns, dictionary, "sha", F.col("conv_id"), "inner")
    lists = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "sha", "id", "len"))).alias("w"))
    return lists.select("conv_id", F.col("w.id").alias("ids"), F.col("w.len").alias("lens"))


def rebuilt(lists: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % family, then goes on with its own after the first h."""
    lists = stored(lists, "turn-lists")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    base = lists.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "lens")])
    joined = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(base, "base", "left")

    def put(c: str) -> F.Column:
        first = F.coalesce(F.col(f"head_{c}"), F.array().cast(lists.schema[c].dataType))
        return F.concat(F.slice(first, F.lit(1), h), F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))).alias(c)
    return joined.select("conv_id", put("ids"), put("lens"))


# --- one row for each distinct list ---

class _Run:
    def __init__(self, first: tuple):
        self.first, self.ids = first, []


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k1, k2, ids, lens, conv_id) -> a row for each run of equal lists; pieces of joined ids at both ends."""
    number, run, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or run.first[:3] != row[:3]:
                if run is not None:
                    out += _opened(run, number) if not done else [_closed(run)]
                    done += 1
                run = _Run(row)
            run.ids.append(row[4])
        if out:
            yield _batch(_OPEN, out)
    if run is not None:
        yield _batch(_OPEN, _opened(run, number))


def _closed(run: _Run) -> tuple:
    k1, k2, ids, lens, _ = run.first
    return k1, k2, None, None, None, ids, lens, len(run.ids), run.ids[0], hashlib.sha256(",".join(map(str, run.ids)).encode()).hexdigest()


def _opened(run: _Run, number: int) -> list[tuple]:
    k1, k2, ids, lens, _ = run.first
    pieces = [run.ids[i:i + PIECE] for i in range(0, len(run.ids), PIECE)]
    return [(k1, k2, number, i, ",".join(map(str, p)), ids, lens, len(p), p[0], None) for i, p in enumerate(pieces)]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (k1, k2, ids, range_no, part, piece, lens, n, least) -> a row for each list, its ids hashed as a stream."""
    at, sha, row = None, None, None
    for batch in batches:
        out = []
        for k1, k2, ids, _, _, piece, lens, n, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (k1, k2, ids):
                if at is not None:
                    out.append((*row, sha.hexdigest()))
                at, sha, row = (k1, k2, ids), hashlib.sha256(piece.encode()), (ids, lens, n, least)
            else:
                sha.update(b"," + piece.encode())
                row = (ids, lens, row[2] + n, row[3])
        if out:
            yield _batch(_SEQUENCE, out)
    if at is not None:
        yield _batch(_SEQUENCE, [(*row, sha.hexdigest())])


def sequences(lists: DataFrame) -> DataFrame:
    """(ids, lens, n, least, ends): each distinct list with its conversations: how many, the smallest, the hash of all."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = lists.select(F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(7), "ids").alias("k2"), "ids", "lens", "conv_id")
    ranged = keyed.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "ids", "conv_id")
    runs = stored(ranged.mapInArrow(_runs, _OPEN), "conversation-runs")
    pieces = runs.where("piece IS NOT NULL").select("k1", "k2", "ids", "range_no", "part", "piece", "lens", "n", "least")
    put = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "ids", "range_no", "part").mapInArrow(_streamed, _SEQUENCE)
    return runs.where("piece IS NULL").select("ids", "lens", "n", "least", "ends").unionByName(put)


# --- shards ---

class Tree:
    """A ternary search tree over lists of numbers. Node 0 is the empty list; ``up`` is the node of the list without its last number."""

    def __init__(self):
        self.code, self.low, self.equal, self.high, self.up, self.size, self.depth = [None], [-1], [-1], [-1], [-1], [0], [0]
        self.n, self.least, self.leaves, self.saved, self.children, self.ends = [0], [None], [0], [0], [0], [None]

    def _new(self, code: int, size: int, up: int) -> int:
        for column, value in ((self.code, code), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.size, size),
                              (self.depth, self.depth[up] + 1), (self.n, 0), (self.least, None), (self.leaves, 0), (self.saved, 0),
                              (self.children, 0), (self.ends, None)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, ids: list[int], sizes: list[int]) -> list[int]:
        """The nodes of all prefixes of ``ids``, from the empty one."""
        code, path = self.code, [0]
        for value, size in zip(ids, sizes, strict=True):
            up = path[-1]
            at = self.equal[up]
            if at < 0:
                at = self.equal[up] = self._new(value, size, up)
            while code[at] != value:
                side = self.low if value < code[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(value, size, up)
                at = side[at]
            path.append(at)
        return path

    def add(self, node: int, n: int, least, leaves: int = 0, saved: int = 0, children: int = 0) -> None:
        self.n[node] += n
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least
        self.leaves[node] += leaves
        self.saved[node] += saved
        self.children[node] += children

    def order(self) -> list[int]:
        """All nodes, each before those that go on from it."""
        out, stack = [0], [self.equal[0]]
        while stack:
            at = stack.pop()
            if at < 0:
                continue
            out.append(at)
            stack += [self.high[at], self.equal[at], self.low[at]]
        return out

    def finish(self, order: list[int], unfinished: set[int]) -> None:
        """Pass what is known from the last node to the first; unfinished nodes only collect."""
        for at in reversed(order):
            if at in unfinished:
                continue
            self.leaves[at] += self.children[at] == 0
            if at:
                self.saved[at] += (self.n[at] - 1) * self.size[at]
                self.add(self.up[at], self.n[at], self.least[at], self.leaves[at], self.saved[at], 1)


def by_medians(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves, and so on."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


def _shard(last: bool, passed_on: bool):
    """Sorted sequences of a shard -> finished nodes, and its first and last sequence with what is unfinished on them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not items:
            return
        tree = Tree()
        paths = {}
        for i in by_medians(len(items)):
            ids, sizes, *own = items[i]
            path = tree.insert(ids, sizes)
            if i in (0, len(items) - 1):
                paths[i] = path
            if passed_on:
                for node, n, least, leaves, saved, children, ends in zip(path, *own, strict=True):
                    tree.add(node, n, least, leaves, saved, children)
                    tree.ends[node] = tree.ends[node] or ends
            else:
                tree.add(path[-1], own[0], own[1])
                tree.ends[path[-1]] = own[2]
        unfinished = set() if last else {node for path in paths.values() for node in path}
        order = tree.order()
        tree.finish(order, unfinished)
        keys: dict[int, bytes] = {}
        for at in order:
            if passed_on or at in unfinished:
                before = b"" if not at else keys[tree.up[at]] + tree.code[at].to_bytes(8, "little", signed=True)
                keys[at] = hashlib.blake2b(before, digest_size=16).digest()
        rows, none = [], [None] * 8
        for at in order:
            if at in unfinished:
                continue
            up = tree.up[at]
            waits = up in unfinished
            rows.append((tree.least[at], tree.depth[at], None if waits or up < 0 else tree.least[up], tree.n[at], tree.children[at], tree.leaves[at],
                         tree.saved[at], tree.ends[at] or NOBODY, keys.get(at), keys[up] if waits else None, *none))
            if len(rows) >= 10_000:
                yield _nodes(rows)
                rows = []
        told: set[int] = set()
        for i in sorted(paths) if not last else []:
            own = [(tree.n[x], tree.least[x], tree.leaves[x], tree.saved[x], tree.children[x], tree.ends[x]) if x not in told
                   else (0, None, 0, 0, 0, None) for x in paths[i]]
            told.update(paths[i])
            rows.append((*[None] * 10, items[i][0], items[i][1], *map(list, zip(*own, strict=True))))
        if rows:
            yield _nodes(rows)
    return work


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_NODE_TYPES[c.split()[1]] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NODE_NAMES)


def trie(lists: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct prefix."""
    spark = lists.sparkSession
    rows, passed_on, levels = stored(sequences(lists), "sequences"), False, []
    shards = None
    while True:
        total = rows.select(F.sum(F.size("ids") + 1)).first()[0] or 0
        fit = math.ceil(total / shard_ids)
        # each round passes on two sequences a shard; halving ends it where single sequences are longer than a shard
        shards = max(fit, int(spark.conf.get("spark.sql.shuffle.partitions"))) if shards is None else min(max(fit, 1), shards // 2)
        last = shards <= 1
        dealt = (rows.repartition(1) if last else rows.repartitionByRange(shards, "ids")).sortWithinPartitions("ids")
        out = stored(dealt.mapInArrow(_shard(last, passed_on), _NODE), "trie-nodes")
        levels.append(out.where("depth IS NOT NULL").drop("ids", "lens", *_OWN, "own_ends"))
        if last:
            break
        rows, passed_on = out.where("ids IS NOT NULL").select("ids", "lens", *_OWN, "own_ends"), True
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    names = nodes.where("node_key IS NOT NULL").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("found"))
    waiting = salted_lookup(nodes.where("parent_key IS NOT NULL").drop("node_key", "parent_conv_id"), names, "parent_key", F.col("conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (nodes.where("parent_key IS NULL").select(columns)
            .unionByName(waiting.withColumnRenamed("found", "parent_conv_id").select(columns)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(encoded(conversations)))
