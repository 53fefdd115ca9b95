"""License scan by diagonal voting.

Every text gives all its rolling word 2-grams as hashes; Spark joins them to the positions of the same 2-grams in a
fixed list of license phrases and notices. Hits are counted by (text, template, diagonal), where the diagonal is the
place in the text less the place in the template. Neighbouring diagonals, which a word put in or left out makes, are
merged, and a span counts when its hits cover enough of the template.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any characters above ASCII. Null texts count as
empty. Repeated rows and repeated doc_ids are scanned each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import words as X

K = 2
#: The base phrases and the label each stands for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices with labels of the method's own.
NOTICES = {
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person": "mit-notice",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl",
}
#: Diagonals this close belong together; the share of a notice's words that its hits must cover.
NEAR, COVER = 2, 0.8
_MARK = -1


def _grams(text: str) -> np.ndarray:
    (chunk,) = X.chunks(pa.array([text]), X.NOT_ALNUM, X.LOWER)
    return X.as_long(X.rolling(chunk.hashes(), K))


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, t_pos, t_words, label, base): a few dozen rows, fixed by the lists above."""
    rows = [(_MARK, -1, 0, 1, "", False)]
    for n, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        rows += [(int(g), n, i, len(text.split()), label, n < len(PHRASES)) for i, g in enumerate(_grams(text))]
    return spark.createDataFrame(rows, "gram long, template int, t_pos int, t_words int, label string, base boolean")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in X.chunks(batch.column(2), X.NOT_ALNUM, X.LOWER):
            at, counts = c.windows(K)
            grams = X.rolling(c.hashes(), K)
            n = np.diff(c.first)
            ends = np.cumsum(counts + 1)
            lists = np.empty(int(ends[-1]), np.int64)
            marks = np.zeros(len(lists), bool)
            marks[ends - counts - 1] = True
            lists[marks] = _MARK
            lists[~marks] = X.as_long(grams)[at] if len(at) else 0
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            own = batch.slice(c.row, c.texts)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(lists))],
                names=["row_no", "doc_id", "n_words", "grams"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), docs[id_col].cast("long").alias("doc_id"),
                       docs[text_col].alias("text"))
    listed = rows.mapInArrow(_texts, "row_no long, doc_id long, n_words long, grams array<long>")
    # The first of each list is a mark that meets a row of its own, so a text without any hit keeps one row.
    grams = listed.select("row_no", "doc_id", "n_words", F.posexplode("grams").alias("pos", "gram"))
    hits = grams.join(F.broadcast(templates(docs.sparkSession)), "gram").withColumn("place", F.col("pos") - 1 - F.col("t_pos"))
    diagonals = hits.groupBy("row_no", "doc_id", "n_words", "template", "t_words", "label", "base", "place").agg(
        F.collect_set("t_pos").alias("seen"))
    whole = F.col("base") & (F.size("seen") == F.col("t_words") - (K - 1))
    line = W.partitionBy("row_no", "template").orderBy("place")
    apart = F.coalesce((F.col("place") - F.lag("place").over(line) > NEAR).cast("int"), F.lit(1))
    merged = (diagonals.withColumn("whole", whole).withColumn("apart", apart)
              .withColumn("group_no", F.sum("apart").over(line))
              .groupBy("row_no", "doc_id", "n_words", "template", "t_words", "label", "base", "group_no")
              .agg(F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"),
                   F.sum(F.col("whole").cast("long")).alias("places"),
                   F.min(F.when(F.col("whole"), F.col("place"))).alias("lo"),
                   F.max(F.when(F.col("whole"), F.col("place"))).alias("hi")))
    # A 2-gram at t covers the words t and t + 1 of its template.
    words = F.array_distinct(F.concat("seen", F.transform("seen", lambda t: t + 1)))
    cover = F.when(F.col("template") < 0, 0.0).otherwise(F.size(words) / F.col("t_words"))
    spans = merged.withColumn("cover", cover).withColumn(
        "found", F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("cover") >= COVER))
    named = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return (spans.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sum("places").alias("n_base"), F.min("lo").cast("long").alias("first_word"),
        F.max("hi").cast("long").alias("last_word"), named(F.col("base") & F.col("found")).alias("base_labels"),
        named(F.col("found") & (F.col("template") >= 0)).alias("labels"),
        F.max(F.when(F.col("found"), F.col("cover")).otherwise(F.col("cover") / 2)).alias("score")).drop("row_no"))
