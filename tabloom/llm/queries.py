"""Each operator of this subpackage as a query over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, exact, jaccard, licenses, mixing, packing, repeats, scoring, secrets, sketches, toxicity, tries, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def _(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents"))


SQL["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s)
  QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM r),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, list(word ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS k
  FROM words p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op2_mixing")
def _(spark, d):
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op3_ngram_jaccard")
def _(spark, d):
    return jaccard.jaccard_join(table(spark, d, "documents"))


@query("op4_toxicity")
def _(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_warc")
def _(spark, d):
    return archives.pages_through_warc(table(spark, d, "pages"))


@query("op6_license_scan")
def _(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@query("op7_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query("op8_fingerprints")
def _(spark, d):
    return sketches.fingerprints(table(spark, d, "documents"))


@query("op9_exact_dedup")
def _(spark, d):
    return exact.exact_duplicates(table(spark, d, "documents"))


SQL["op9_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


@query("op10_lm_scores")
def _(spark, d):
    return scoring.score(table(spark, d, "documents"))


@query("op11_secret_scan")
def _(spark, d):
    return secrets.scan(table(spark, d, "documents"))


@query("op12_prefix_trie")
def _(spark, d):
    return tries.conversation_trie(table(spark, d, "conversations"))


SQL["op12_prefix_trie"] = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS s),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, w, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a // 256, s[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h FROM own, steps),
rebuilt AS (SELECT h.c, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w
  FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
pre AS (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt),
node AS (SELECT w[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(w) = d), '')) AS ends_sha256 FROM pre GROUP BY w[1:d], d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY p[1:d - 1], d - 1),
own_part AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf,
  CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.d].t) END AS saving FROM node n LEFT JOIN kids k ON k.p = n.p AND k.d = n.d),
up AS (SELECT p, leaf, saving, unnest(range(0, d + 1)) AS k FROM own_part),
sums AS (SELECT p[1:k] AS p, k AS d, sum(leaf)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM up GROUP BY p[1:k], k)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM own_part n JOIN sums s ON s.p = n.p AND s.d = n.d LEFT JOIN node u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]"""


@query("op13_whitening")
def _(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"))
