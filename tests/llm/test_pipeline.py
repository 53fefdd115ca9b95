"""The stages one by one, each on what the one before it kept."""

import os
import random

import corpus_pipeline
from tabloom.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "su", "me"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join([word() for _ in range(80)] + (["grobian"] if i % 4 == 0 else [])) for i in range(240)]
    texts += [texts[1], texts[1] + "\n", texts[2] + " tail", None, ""]
    rows = [(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    toxic = {i for i in range(240) if i % 4 == 0}
    clean = set(range(240)) - toxic
    assert set(kept["toxicity"]) >= clean and len(set(kept["toxicity"]) & toxic) <= 3
    assert set(kept["exact_dedup"]) == set(kept["toxicity"]) - {240, 244}  # 241 ends in a blank; 243 is null and 244 empty
    assert set(kept["ngram_jaccard"]) == set(kept["exact_dedup"]) - {241, 242}
    assert len(kept["ngram_jaccard"]) == len(set(kept["ngram_jaccard"]))
    assert set(kept["mixing"]) == set(kept["ngram_jaccard"]) and len(kept["mixing"]) > len(kept["ngram_jaccard"])
    assert set(kept["packing"]) == set(kept["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == spark.read.parquet(f"{tmp_path}/packing").count()


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
