"""Steps that must not grow faster than their input: what is worked out, moved or broadcast, and the same results."""

import re

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.functions import cells as C
from tabloom.operators import contextual, lexical, matching as M, reshape as R, structure as S
from tabloom.operators.review import apply_edits


def plan(frame, kind="optimizedPlan"):
    return getattr(frame._jdf.queryExecution(), kind)().toString()


def test_only_tokens_near_a_signature_have_fares(spark, lexicon):
    tokens = ["amount", "amounnt", "supplieer", "12345", "zzz", "total", "x", "ammount", "pay", "numbers", "citi"]
    weighted = F.get(X.weighted(F.array("token"), lexicon), F.lit(0))
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").withColumn("w", weighted)
    outcomes = rows.select("token", F.explode(X.signature_literal(lexicon)).alias("s")).join(rows, "token")
    want = {r.token for r in outcomes.where(X.token_outcome(F.col("w"), F.col("s"))["outcome"] != "noise").collect()}
    got = {r.token for r in rows.where(X.meets_signature(F.col("token"), lexicon)).collect()}
    assert got == want and {"amount", "total"} <= got and "12345" not in got
    fares = rows.where("token IN ('amount', '12345')").select("token", X.token_fares(F.col("token"), lexicon).alias("f")).collect()
    assert {r.token: 0 < len(r.f.hits) < 26 for r in fares} == {"amount": True, "12345": False}


def test_words_without_known_letters_stay_whole(spark, lexicon):
    words = spark.createDataFrame([("20241231",), ("totalamount",), ("7x7",)], "word string")
    got = {r.word: r.segments for r in M.segment_words(words, lexicon).collect()}
    walked = {r.word: r.s for r in words.select("word", X.deep_segments(F.col("word"), lexicon).alias("s")).collect()}
    assert got == walked and got["20241231"] == ["20241231"]


def test_cleansed_once_per_distinct_header(spark, lexicon, header_rows):
    headers = header_rows({"a": ["Vendor", "vendor "], "b": ["Vendor"]})
    found = lexical.exact_matches(headers, lexicon.alias_table(spark))
    below = plan(found).split("Aggregate [source")[1].split("\nAggregate")[0]
    assert "regexp_replace" not in below.split("+- Aggregate [cleansed")[0].split(":- ")[0]


def test_edits_leave_the_mapping_where_it_is(spark, lexicon):
    mapping = spark.createDataFrame([("f", 0, "supplier_id", ["A"], 1.0), ("f", 1, "supplier_name", [], 0.0)],
                                    "file_id string, target_pos int, target_id string, sources array<string>, confidence double")
    clicks = [("f", 1, "remove", "supplier_id", "A"), ("f", 5000, "add", "supplier_name", "A"), ("f", 9000, "remove", "supplier_id", "A"),
              ("f", 9001, "add", "supplier_name", "B"), ("g", 1, "add", "supplier_id", "C")]
    edits = spark.createDataFrame(clicks, "file_id string, seq long, action string, target_id string, source string")
    got = apply_edits(mapping, edits, lexicon)
    assert {r.target_id: r.sources for r in got.collect()} == {"supplier_id": [], "supplier_name": ["A", "B"]}
    assert not re.search(r"hashpartitioning\(file_id#\d+, target_id", plan(got, "executedPlan"))


@pytest.mark.parametrize("k", [1, 3])
def test_suggestions_move_no_pairs(spark, lexicon, header_rows, k):
    headers = header_rows({"a": ["Total Amount", "Vendor Name", "Amount Due"], "b": ["Total Amount", "x"]})
    scored = M.score_sources(headers, lexicon)
    few = M.suggest(M.pair_rows(headers, scored, lexicon, best=3), k)
    key = ["file_id", "source", "target_id", "score", "place"]
    assert sorted(few.select(key).collect()) == sorted(M.suggest(M.pair_rows(headers, scored, lexicon), k).select(key).collect())
    assert "Window" not in plan(few)


def test_short_rows_are_read_for_no_series(spark):
    grid = spark.createDataFrame([("f", i, row) for i, row in enumerate([["2019", "2020"], ["2019", "2020", "2021"], ["a", "1", "2"], ["5", "4", "3"]])],
                                 "file_id string, row_idx long, cells array<string>")
    scores = contextual.contextual_scores(grid)
    assert [r.is_series for r in scores.orderBy("row_idx").collect()] == [False, True, False, True]
    assert re.search(r"numeric_cells#?\S* >= 3", plan(scores))


def test_ranked_search_makes_no_row_per_word_of_a_pair(spark):
    docs = spark.createDataFrame([("d1", "t", ["a", "b", "b"]), ("d2", "t", ["b", "c"]), ("d2", "u", ["c"]), ("d3", "t", ["z"])],
                                 "doc_id string, target_id string, tokens array<string>")
    index = lexical.bm25_index(docs)
    asked = spark.createDataFrame([("b a b",), ("c y",), (None,), ("b a b",)], "source string")
    found = lexical.bm25_search_blocks(asked, lexical.bm25_blocks(index, 1), 5)
    key = ["source", "doc_id", "target_id", "score"]
    assert sorted(found.select(key).collect()) == sorted(lexical.bm25_search(asked, index, 5).select(key).collect())
    assert "Generate explode(asked" not in plan(found)


def test_trigrams_cleanse_and_meet_once(spark):
    texts = [(" Vendör  Name ",), ("ab",), ("",), (None,), ("aaaa",)]
    rows = spark.createDataFrame(texts, "source string")
    grams = rows.select("source", X.trigrams(X.cleanse(F.col("source"))).alias("g"))
    assert plan(grams).count("translate(") == 1
    want = {s[0]: None if s[0] is None else list(dict.fromkeys(p[i:i + 3] for p in [f"  {c}  "] for i in range(len(p) - 2)))
            for s, c in zip(texts, ["vendor_name", "ab", "", None, "aaaa"], strict=True)}
    assert {r.source: r.g for r in grams.collect()} == want
    aliases = spark.createDataFrame([(0, "a b", 0, "vendor name"), (1, "c", 0, "vendors")], "key_pos int, target_key string, alias_pos int, alias string")
    found = lexical.trigram_matches(rows, aliases, (0.5,))
    assert {r.source: (r.target_id, r.similarity) for r in found.collect()} == {" Vendör  Name ": ("a_b", 1.0)}


def test_cells_with_clean_ends_are_not_searched(spark):
    cells = ["a b", " a", "a\u3000", "", " ", None, "\ufeff\u00a0x y\n", "é", "\u2003", "\u200b"]
    rows = spark.createDataFrame([(c,) for c in cells], "v string")
    got = rows.select("v", C.clean(F.col("v")).alias("c"), F.btrim("v", F.lit(C.WHITE_SPACE)).alias("all"))
    assert all(r.c == r["all"] for r in got.collect()) and "CASE WHEN" in plan(got)


def test_context_takes_one_window(spark, grid_of):
    rows = S.with_context(S.typed_rows(grid_of({"f": [["a", "b"], ["1", None], [None]], "g": [["x"]]})))
    assert len(re.findall(r"(?m)^[ :+-]*Window ", plan(rows))) == 1
    assert [(r.width, r.last_row, r.data_below) for r in rows.orderBy("file_id", "row_idx").collect()] == [
        (2, 2, True), (2, 2, False), (2, 2, False), (1, 0, False)]


def test_rows_carry_only_the_targets_their_file_fills(spark, lexicon, grid_of):
    ids = lexicon.target_ids
    slots = [([1], " ") if t == "currency" else ([0, 7, 1], "/") if t == "supplier_name" else ([], " ") for t in ids]
    frame = spark.createDataFrame([("f", 0, slots), ("g", 0, [([], " ")] * len(ids))],
                                  "file_id string, header_row_index int, plan array<struct<columns:array<int>,separator:string>>")
    values = R.source_values(grid_of({"f": [["h", "i"], [" a ", "b"], [" ", None]], "g": [["h"], ["z"]]}), frame, lexicon)
    got = {(r.file_id, r.row_idx): {t: r[t] for t in ids if r[t] is not None} for r in values.collect()}
    assert got == {("f", 1): {"currency": "b", "supplier_name": "a/b"}, ("f", 2): {}, ("g", 1): {}}
    assert "at#" in plan(values) and not re.search(r"array_position|slots", plan(values).split("Join")[0])


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_written_tables_leave_no_shuffle_files(spark):
    from tabloom.operators.common import stored
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r["count"] for r in stored(counted, "counted").collect()) == [142] * 1 + [143] * 6
    assert shuffle_files(spark) <= before


def test_headers_move_by_text_and_by_file(spark, lexicon, header_rows):
    headers = header_rows({"a": ["Currency", "Supplier Name", "Supplier Name"], "b": ["x", "Country"], "c": []})
    mapping = M.assign(headers, M.score_sources(headers, lexicon), lexicon, 0.4, flags=True)
    assert not re.search(r"hashpartitioning\(file_id#\d+, s", plan(mapping, "executedPlan"))
    got = {r.target_id: (r.sources, r.ambiguous) for r in mapping.where("file_id = 'a' AND size(sources) > 0").collect()}
    assert got["supplier_name"] == (["Supplier Name"], True) and mapping.where("file_id = 'b'").count() == 26
    filled = spark.createDataFrame([("a", ["supplier_name"])], "file_id string, filled array<string>")
    left = M.assign(headers, M.score_sources(headers, lexicon), lexicon, 0.4, filled).where("size(sources) > 0").collect()
    assert {"currency", "country"} <= {r.target_id for r in left} and "supplier_name" not in {r.target_id for r in left}


def test_a_file_is_one_row_between_matchers(spark, lexicon, header_rows, monkeypatch):
    from tabloom.plans import mapping as P
    rows, plain = {}, P.stored

    def counted(frame, name):
        kept = plain(frame, name)
        rows[name] = kept.count()
        return kept
    monkeypatch.setattr(P, "stored", counted)
    files = {"a": ["Supplier ID", "totalamountx", None], "b": ["Currency"], "c": [None], "d": [t.label for t in lexicon.targets]}
    got = P.map_with_fallback(header_rows(files), lexicon, ("standard", "deep"), 0.4, 0.75, ambiguous=True).collect()
    assert len(got) == 4 * 26 and rows["mapping"] == 4
    by = {(r.file_id, r.target_id): (r.sources, r.matcher) for r in got}
    assert by[("a", "supplier_id")] == (["Supplier ID"], "standard") and by[("c", "currency")] == ([], None)
    assert sum(r.file_id == "d" and r.matcher is not None for r in got) == 26


def test_completed_mapping_moves_a_row_per_file(spark, lexicon, header_rows):
    from tabloom.operators.review import complete_mapping
    files = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "file_id string")
    rows = [("a", 0, "supplier_id", ["A"], 0.5), ("a", 0, "supplier_id", ["B"], None), ("a", 9, "no_target", ["C"], 1.0),
            ("z", 0, "supplier_id", ["D"], 1.0), (None, 0, "supplier_id", ["E"], 1.0)]
    mapping = spark.createDataFrame(rows, "file_id string, target_pos int, target_id string, sources array<string>, confidence double")
    got = complete_mapping(mapping, files, lexicon)
    assert "hashpartitioning(file_id" in plan(got, "executedPlan")
    assert not re.search(r"hashpartitioning\(file_id#\d+, target_id", plan(got, "executedPlan"))
    kept = sorted((r.file_id or "", r.sources, r.confidence) for r in got.collect() if r.sources)
    assert kept == [("a", ["A"], 0.5), ("a", ["B"], 0.0)] and got.count() == 3 * 26 + 1


def test_rows_with_what_follows_move_once(spark, grid_of):
    grid = grid_of({"f": [["a", "b"], ["1", "x"], [None]] + [["2", "y"]] * 2000, "g": [["x"]]})
    scores = contextual.contextual_scores(grid)
    assert len(re.findall(r"Exchange hashpartitioning", plan(scores, "executedPlan"))) == 1
    got = {(r.file_id, r.row_idx): (r.following, r.data_below) for r in scores.collect()}
    assert len(got) == 2004 and got[("f", 1999)] == (3, True) and got[("f", 2002)] == got[("g", 0)] == (0, False) and got[("f", 0)] == (5, True)


def test_clicks_and_held_sources_move_once(spark, lexicon, header_rows):
    headers = header_rows({"f": ["Supplier ID", "Country"], "g": ["Currency"], "h": ["Country", None]})
    clicks = [("f", 1, "remove", "country", "Country"), ("f", 9000, "add", "city_state", "Country"), ("g", 3, "clear", None, None),
              ("g", 4, "add", "tax_id", "Currency"), ("h", None, "remove", "country", "Country"), (None, 1, "add", "tax_id", "x")]
    edits = spark.createDataFrame(clicks, "file_id string, seq long, action string, target_id string, source string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "16"):  # without salts and with two
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = apply_edits(M.assign(headers, M.score_sources(headers, lexicon), lexicon, 0.4), edits, lexicon)
            assert {(r.file_id, r.target_id): r.sources for r in got.collect() if r.sources} == {
                ("f", "supplier_id"): ["Supplier ID"], ("f", "city_state"): ["Country"], ("g", "tax_id"): ["Currency"]}
            assert got.count() == 3 * 26 and not re.search(r"hashpartitioning\(file_id#\d+, source", plan(got, "executedPlan"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_move_once_to_their_candidates(spark, lexicon, header_rows):
    headers = header_rows({"a": ["Currency", "Country", "Country"], "b": ["Currency", None]})
    pairs = M.pair_rows(headers, M.score_sources(headers, lexicon), lexicon)
    assert not re.search(r"hashpartitioning\(file_id", plan(pairs, "executedPlan"))
    best = {(r.file_id, r.source, r.src_pos, r.repeats) for r in pairs.where("score > 0.99").collect()}
    assert best == {("a", "Currency", 0, 1), ("a", "Country", 1, 2), ("b", "Currency", 0, 1)}
    left = shuffle_files(spark)
    ranked = M.pair_ranks(pairs)
    assert shuffle_files(spark) <= left and {r["rank"] for r in ranked.where("file_id = 'b'").collect()} == set(range(1, pairs.where("file_id = 'b'").count() + 1))


def test_words_are_counted_where_documents_meet(spark):
    docs = spark.createDataFrame([("d1", "t", ["a", "b", "b"]), ("d1", "u", ["b"]), ("d2", "t", []), (None, "t", ["b"]), ("d3", "t", None)],
                                 "doc_id string, target_id string, tokens array<string>")
    index = lexical.bm25_index(docs)
    assert "Exchange" in plan(index, "executedPlan") and not re.search(r"hashpartitioning\(token#\d+, doc_id", plan(index, "executedPlan"))
    got = {(r.token, r.doc_id, r.target_id): round(r.weight, 6) for r in index.collect()}
    lengths = [4, 0, 1] + [r.n for r in docs.where("doc_id = 'd3'").select(F.size("tokens").alias("n")).collect() if r.n is not None]
    mean = sum(lengths) / len(lengths)

    def weight(tf, df, n_docs=4, k1=1.2, b=0.75):
        import math
        return round(math.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * 4 / mean)), 6)
    assert got == {("a", "d1", "t"): weight(1, 1), ("b", "d1", "t"): weight(2, 3), ("b", "d1", "u"): weight(1, 3)}
