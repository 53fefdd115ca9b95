"""Substring dedup, Jaccard join, license scan, fingerprints and exact dedup against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import exact, jaccard, licenses, recompress, repeats, scoring, sketches, words as X
from tabloom.llm.components import components


def blanks(text):
    return (text or "").encode().split()


def test_words_and_spans_match_plain_splitting():
    texts = ["a bc", None, "", " x\ty ", "é ü z", "same words here", "here same words"]
    (c,) = X.chunks(pa.array(texts))
    for t, text in enumerate(texts):
        got = [c.data[a:b].tobytes() for a, b in zip(c.start[c.first[t]:c.first[t + 1]], c.end[c.first[t]:c.first[t + 1]], strict=True)]
        assert got == blanks(text)
    names = dict(zip([w for t in texts for w in blanks(t)], c.hashes().tolist(), strict=False))
    assert len(set(names.values())) == len(names)


def test_symbols_are_decided_by_the_words_they_name():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 60).astype(np.uint64)
    parts = [np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), shared, rng.integers(0, 2**63, n).astype(np.uint64)]) for n in (7, 40)]
    h = np.concatenate(parts)
    first = np.array([0, len(parts[0]), len(h)])
    name, lo, hi = recompress.symbols(h, first)
    inside = [{(n, a - at, b - at) for n, a, b in zip(name.tolist(), lo.tolist(), hi.tolist(), strict=True) if at <= a and b <= at + 60}
              for at in (7, len(parts[0]) + 40)]
    assert inside[0] == inside[1] and len(inside[0]) >= 3


def removed(rows, width):
    docs = [blanks(t) for _, t in rows]
    seen = Counter(tuple(w[k:k + width]) for w in docs for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_repeats_match_brute_force(docs, no_docs, corpus_rows, monkeypatch):
    monkeypatch.setattr(repeats, "OWNER_BYTES", 30_000)  # several owners and buckets
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 50_000)
    got = Counter(tuple(r) for r in repeats.remove_repeats(docs).collect())
    assert got == removed(corpus_rows, 35)
    assert repeats.remove_repeats(no_docs).count() == 0


def gram_set(text, n=5):
    w = blanks(text)
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def joined(rows, similarity=0.8):
    sets = sorted({gram_set(t) for _, t in rows}, key=repr)
    copy_id = {s: min((i for i, t in rows if i is not None and gram_set(t) == s), default=None) for s in sets}
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s
    links = Counter()
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x & y and len(x & y) / len(x | y) >= similarity:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    class_id = defaultdict(list)
    for s in sets:
        class_id[find(s)] += [copy_id[s]] if copy_id[s] is not None else []
    return Counter((i, min(class_id[find(s)], default=None), copy_id[s], len(s), links[s])
                   for i, t in rows for s in [gram_set(t)])


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_jaccard_join_matches_brute_force(docs, corpus_rows, block):
    got = Counter(tuple(r) for r in jaccard.jaccard_join(docs, block=block)
                  .select("doc_id", "class_id", "copy_id", "n_grams", "n_links").collect())
    assert got == joined(corpus_rows)


def test_one_of_each_near_duplicate_stays(docs, no_docs, corpus_rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = joined(corpus_rows)
    assert len(rows) == len({(k[1], k[2] if k[1] is None else 0, k[3] if k[1] in (None, 7) else 0) for k in want})
    assert all(r["doc_id"] is None or (r["doc_id"], r["doc_id"]) in {(k[0], k[1]) for k in want} for r in rows)
    assert jaccard.one_of_each(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands = jaccard.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8 ** jaccard.ROWS) ** bands >= 0.9995 > 1 - (1 - 0.8 ** jaccard.ROWS) ** (bands - 1)


def test_large_group_of_near_copies_keeps_all_links(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[:k] + [f"new{k}"] + words[k + 1:])) for k in range(60)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    sets = [gram_set(t) for _, t in rows]
    want = [sum(1 for y in sets if y != x and len(x & y) / len(x | y) >= 0.8) for x in sets]
    assert {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(want))
    assert {r["class_id"] for r in got} == {0}


def test_license_scan_matches_brute_force(spark, frame_of, no_docs):
    texts = ["MIT License", "the MIT-license; the mit license!", "apache LICENSE mit license", "General  Public\nLicense", "public license",
             "Licensed under CC BY-NC 4.0. fine", "Licensed under CC strange BY-NC 4.0", "nothing to see", "", None, "éMIT license", "mit licenseé",
             "This work is licensed under the GNU General Public License, version 3.", "general public license general public license",
             "x " * 30_000 + "mit license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "MIT License"), (None, "apache license")]
    got = licenses.scan(frame_of(rows)).collect()
    want = Counter()
    for i, t in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 0)}
    assert "cc-by-nc" in by[5]["labels"] and "cc-by-nc" in by[6]["labels"] and by[7]["labels"] == "" and by[7]["score"] == 0
    assert {"gpl", "gpl-3.0"} <= set(by[12]["labels"].split(","))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize("range_bytes", [sketches.RANGE_BYTES, 20_000])
def test_fingerprints_match_brute_force(docs, corpus_rows, monkeypatch, range_bytes):
    monkeypatch.setattr(sketches, "RANGE_BYTES", range_bytes)
    got = sketches.fingerprints(docs).collect()
    order = sorted(corpus_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[:len(t) - half] + following[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = defaultdict(set)
    for r in got:
        same[r["doc_id"]].add(r["fingerprint"])
    assert len(same[5]) == 1 and len(same[7]) == 2


def test_sketches_estimate_containment_and_merge(no_docs):
    w = [f"q{i}" for i in range(4000)]
    kept, names = sketches.sketches(pa.array([" ".join(w), " ".join(w[:400]), " ".join(w[400:]), ""]))
    assert sketches.containment(kept[1], kept[0]) == 1.0
    assert abs(sketches.containment(kept[0], kept[1]) - 0.1) < 0.03
    assert set(sketches.merged(kept[1], kept[2])) <= set(kept[0])
    name, hashes = sketches.read(sketches.written(kept[1], names[1]))
    assert name == names[1] and (hashes == kept[1]).all()
    assert sketches.fingerprints(no_docs).count() == 0


def test_exact_duplicates_match_brute_force(docs, no_docs, corpus_rows):
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in corpus_rows:
        groups[normal(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = i == keep and left
            left = left and not kept
            want[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact.exact_duplicates(docs).collect()) == want
    stay = exact.drop_exact_duplicates(docs)
    assert stay.columns == docs.columns
    assert Counter(r["doc_id"] for r in stay.collect()) == Counter(k[0] for k in want.elements() if k[3])
    assert exact.exact_duplicates(no_docs).count() == 0 and exact.drop_exact_duplicates(no_docs).count() == 0


def test_a_group_over_many_ranges_keeps_one(spark):
    rows = [(i, "same  text" if i % 2 else "same text") for i in range(300)] + [(i, f"other {i}") for i in range(300, 340)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    runs = exact.settled(exact.stored(exact.sorted_runs(frame, partitions=12), "runs")).collect()
    assert len({r["range_no"] for r in runs if r["group_size"] == 300}) > 1
    assert [r["id"] for r in runs if r["kept"] and r["group_size"] > 1] == [0]
    assert {r["keep_id"] for r in runs if r["id"] < 300} == {0}


def _near_copies(members, distinct_words=90):
    """Texts of one clump: every two differ in a word or two, so nearly all pairs are links."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(distinct_words)]
    out = []
    for i in range(members):
        x = list(base)
        x[rng.randrange(len(x))] = f"n{i}"
        out.append((i, " ".join(x)))
    return out


def test_links_of_near_copies_grow_with_the_members(spark, monkeypatch):
    """Both lists of links that components are worked out from."""
    rows_of = {}
    for members in (100, 400):
        counts = []
        whole = jaccard.components

        def counted(links, counts=counts, whole=whole):
            links = links.where("a <> b").distinct()
            counts.append(links.count())
            return whole(links)
        monkeypatch.setattr(jaccard, "components", counted)
        frame = spark.createDataFrame(_near_copies(members), "doc_id long, text string")
        got = jaccard.jaccard_join(frame, block=16).collect()
        monkeypatch.setattr(jaccard, "components", whole)
        sets = {i: _grams(t) for i, t in _near_copies(members)}
        links = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets.values()) - 1 for i, a in sets.items()}
        assert {r["doc_id"]: r["n_links"] for r in got} == links
        rows_of[members] = counts
    assert all(b <= 5.5 * a for a, b in zip(rows_of[100], rows_of[400], strict=True)), rows_of


def _grams(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_rows_without_or_with_one_id_do_not_meet_in_pairs(spark):
    rows = [(None, t) for _, t in _near_copies(120)] + [(7, t) for _, t in _near_copies(60)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16)
    sets = [_grams(t) for _, t in _near_copies(120)]
    links = sorted(sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets)
    assert sorted(r["n_links"] for r in got.where("doc_id IS NULL").collect()) == links
    plans = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plans and "NestedLoop" not in plans


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(8)
    names = rng.sample(range(-10**9, 10**9), 400)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[160], names[i]) for i in range(161, 260)]
    links += [(names[300 + i], names[300 + (i + 1) % 40]) for i in range(40)] + [(5, 5), (names[0], names[1])]
    links += [(10**10 + i, 10**10 + i + 1) for i in range(130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    want = sorted((x, find(x)) for x in parent)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_different_long_words_have_different_names(spark):
    one = _thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    c = next(X.chunks(pa.array([one + " " + other + " " + one])))
    for seed in (1, 2):
        h = c.hashes(seed)
        assert h[0] == h[2] != h[1]
    assert (c.hashes(1) != c.hashes(2)).all()
    same = [f"w{i}" for i in range(34)]
    frame = spark.createDataFrame([(1, " ".join(same + [one])), (2, " ".join(same + [other]))], "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.remove_repeats(frame).collect()] == [0, 0]
    apart = [(k, " ".join(f"w{i} {w}" for i in range(150))) for k, w in enumerate([one, other])]  # no n-gram in common
    assert all(r["near_next"] == 0 for r in sketches.fingerprints(spark.createDataFrame(apart, frame.schema)).collect())
    assert {r["class_id"] for r in jaccard.jaccard_join(spark.createDataFrame([(1, one), (2, other)], frame.schema)).collect()} == {1, 2}
    pieces = [x for n in (1, 7, 8, 9, 16, 17, 2000) for x in ("q" * n, "q" * (n - 1) + "r", "r" + "q" * (n - 1))]
    c = next(X.chunks(pa.array([" ".join(pieces), " ".join(reversed(pieces))])))
    assert len(set(c.hashes().tolist())) == len(set(pieces))


def test_lm_counts_of_different_long_words(spark):
    one = _thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    learn = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][:6]
    rows = [(i, one) for i in learn] + [(i, other) for i in range(200, 203) if zlib.crc32(str(i).encode()) % 5 == 1] + [(206, other)]
    got = {r["doc_id"]: r["n_known"] for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {i for i, t in rows if t == other and zlib.crc32(str(i).encode()) % 5 == 1}
    trained = {i for i, t in rows if t == other and i not in held}
    assert all(got[i] == (2 if trained else 1) for i in held) and all(got[i] == 2 for i in learn)
