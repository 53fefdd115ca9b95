import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, sha string, t string, k1 long, clump long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Texts with copies, near copies, shared passages, runs, repeats, nulls, a long one, and odd characters."""
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(40)]
    passage = " ".join(words(rng, 60))
    base = words(rng, 200)
    near = [list(base) for _ in range(5)]
    for i, x in enumerate(near):
        x[10 * i] = f"changed{i}"
    texts += [" ".join(x) for x in near] + [" ".join(base), "  ".join(base), "\t" + " ".join(base) + "\n"]
    texts += [texts[0] + " " + passage, passage + " " + texts[1], passage, " ".join(passage.split()[:34]), " ".join(passage.split()[1:36])]
    texts += ["a " * 100, "a " * 35, "a " * 34, "b a b a " * 30, " ".join(words(rng, 20_000)), passage + "\n" + passage]
    texts += ["", "   ", None, None, "é ü ñ naïve", "one two", "one two", "MIT License and Apache\nLicense", "x y z"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(len(texts), texts[3]), (5, texts[5]), (7, "another text with the same id"), (None, "no id here"), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def corpus_rows():
    return corpus()


@pytest.fixture(scope="session")
def frame_of(spark):
    """Rows (doc_id, text) with further columns, some null, some with names the operators use themselves."""
    def make(rows):
        full = [(i, t, "en" if k % 3 else None, None if k % 2 else "s", None, k, "x", None, 3, k) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, COLUMNS).repartition(3)
    return make


@pytest.fixture(scope="session")
def docs(frame_of, corpus_rows):
    return frame_of(corpus_rows).cache()


@pytest.fixture(scope="session")
def no_docs(frame_of):
    return frame_of([])
