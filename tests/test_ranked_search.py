"""Ranked search through blocks of postings against the search that reads them all."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.operators import lexical as L


@pytest.fixture(scope="module")
def index(spark):
    """3,000 documents of frequent and rare words, some of them equal."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [rng.choices(words, weights, k=rng.randint(3, 60)) for _ in range(2600)]
    texts += [texts[i % 50] for i in range(400)]
    docs = spark.createDataFrame([(f"d{i:05}", "t", t) for i, t in enumerate(texts)], "doc_id string, target_id string, tokens array<string>")
    return L.stored(L.bm25_index(docs), "test-index")


def rows(found):
    return sorted((r.source, r.place, r.doc_id, r.target_id, r.score) for r in found.collect())


def test_blocks_give_the_same_documents(spark, index):
    rng = random.Random(4)
    asked = [" ".join(f"w{rng.choice([0, 1, 2, rng.randint(0, 399)])}" for _ in range(rng.randint(1, 6))) for _ in range(60)]
    asked += ["w0 w0 w0 w7", "none of these", "", "W0, w399!"]
    sources = spark.createDataFrame([(s,) for s in [*asked, *asked[:3], None]], "source string")
    for size, k in ((16, 3), (128, 10), (16, 5000)):
        assert rows(L.bm25_search_blocks(sources, L.bm25_blocks(index, size), k)) == rows(L.bm25_search(sources, index, k))


def test_blocks_read_fewer_postings(spark, index):
    """A rare word beside the most frequent ones: most blocks of these stay closed."""
    blocks = L.bm25_blocks(index, 16)
    assert blocks.groupBy("token", "block").count().agg(F.max("count")).first()[0] == 16
    sources = spark.createDataFrame([(f"w0 w1 w{i}",) for i in range(300, 340)], "source string")
    terms = sources.select("source", F.explode(X.search_tokens(F.col("source"))).alias("token")).withColumn("times", F.lit(1))
    read = L.open_blocks(terms, blocks, 3).join(blocks, ["token", "block"]).count()
    assert 0 < read < terms.join(index, "token").count() / 3


def test_empty_tables(spark, index):
    sources = spark.createDataFrame([("w0",)], "source string")
    assert L.bm25_search_blocks(sources, L.bm25_blocks(index.limit(0)), 3).count() == 0
    assert L.bm25_search_blocks(sources.limit(0), L.bm25_blocks(index), 3).count() == 0
