import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tabloom.llm import queries, tries

SCHEMA = "conv_id long, turn long, role string, text string, ids string, n long, least string, depth int, base int"


def make(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x", None, k) for k, r in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(),
                           (role or "", text or "")))
    own = {c: [x[3] for x in sorted(w)] for c, w in own.items()}
    whole = {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + w[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, w in whole.items():
        ends[tuple(w)].append(c)
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += kids[p] == 0
            saved[p[:k]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got(frame):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in frame.collect())


def talk(seed, convs=150, start=0):
    rng = random.Random(seed)
    rows = []
    for c in range(start, start + convs):
        turns = rng.choice([0, 1, 2, 3, 4, 6, 9])
        for t in range(turns):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc", "a much longer text " * 3])))
    return rows


def awkward():
    rows = talk(1) + talk(2, 40, 380) + [(1000 + i, t, "user", f"same {t}") for i in range(60) for t in range(7)]
    rows += [(2000, t, "user", "again" if t % 3 else f"t{t}") for t in range(700)] + [(2001, t, "user", "again" if t % 3 else f"t{t}") for t in range(690)]
    rows += [(None, 1, "user", "nobody"), (5, None, "user", "first"), (5, None, "user", "first too"), (7, 3, "x", "tie"), (7, 3, "x", "tie"),
             (7, 3, "y", "tie b"), (-7, 0, "user", "minus"), (-300, 0, "user", "base of minus"), (-307, 0, "u", "x"), (8, 2**62, "u", "late"),
             (10**15 + 1, 0, "u", "large id")]
    random.Random(3).shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_ids", [40, 1000, 250_000])
def test_trie_against_brute_force(spark, shard_ids):
    rows = awkward()
    frame = make(spark, rows)
    assert got(tries.trie(tries.rebuilt(tries.encoded(frame)), shard_ids)) == brute(rows)


def test_pieces_of_joined_ids(spark, monkeypatch):
    rows = [(c, 0, "user", "one" if c % 5 else "two") for c in range(400)]
    assert got(tries.conversation_trie(make(spark, rows))) == brute(rows)


def test_empty_and_single(spark):
    assert tries.conversation_trie(make(spark, [])).count() == 0
    assert tries.conversation_trie(make(spark, [(None, 1, "u", "x")])).count() == 0
    for rows in ([(0, 0, "u", "x")], [(3, 0, "u", "x")], [(0, t, "u", "x") for t in range(6)]):
        assert got(tries.conversation_trie(make(spark, rows))) == brute(rows)


def test_medians_balance_the_tree():
    tree = tries.Tree()
    for i in tries.by_medians(1023):
        tree.insert([i * 3], [1])
    deepest, stack = 0, [(tree.equal[0], 1)]
    while stack:
        at, level = stack.pop()
        if at >= 0:
            deepest = max(deepest, level)
            stack += [(tree.low[at], level + 1), (tree.high[at], level + 1)]
    assert deepest == 10 and sorted(tree.order()) == list(range(1024))


def test_sql_gives_the_same():
    rows = [(c, t, r or "", x or "") for c, t, r, x in talk(5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    sql = "SELECT conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM (" + \
        queries.SQL["op12_prefix_trie"] + ")"
    assert sorted(con.execute(sql).fetchall()) == brute(rows)
