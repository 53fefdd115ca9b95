from pyspark.sql import functions as F

from tabloom.functions.cells import cell_type, readable_size
from tabloom.operators.contextual import detect_headers_contextual
from tabloom.operators.detect import detect_headers, score_choice

HEADER = ["Vendor Code", "Firm", "Town", "Bills Value", "Booking Count"]


def data_row(i):
    return [f"K{i:04d}", f"Works {i} & Sons", "Porto" if i % 2 else "Graz", f"{i * 7 % 311}.50", str(i * i % 97)]


FILES = {
    "standard": [["Quarterly list"], ["printed on demand"], HEADER, *[data_row(i) for i in range(221)]],
    "deep": [*[[f"clause {i}"] for i in range(61)], HEADER, *[data_row(i) for i in range(170)]],
    "years": [["Plan"], ["Item", "Zone", "2016", "2017", "2018"],
              *[[f"T{i}", "North", str(3 * i), str(3 * i + 2), str(5 * i)] for i in range(40)]],
    "numbers": [[str(900 - i - 11 * k) for k in range(5)] for i in range(210)],
    "vertical": [["Supplier Name", "Works", "rest"], ["Country", "PT", "AT"], ["Currency", "EUR", "GBP"], ["Phone", "x", "y"]],
    "single": [["Supplier Name", "Works"]],
}


def test_cell_types(spark):
    expected = {
        " ": "empty", " ": "empty", "": "empty", "1,000": "string", "$5": "string", "1e5": "number", "0x1F": "number",
        "-0x1F": "string", "Infinity": "number", "-Infinity": "number", "NaN": "string", "5d": "string", ".5": "number",
        "5.": "number", ".": "string", "123-45-6789": "date", "2026/6-1": "date", " 42 ": "number", "+1": "number"}
    rows = spark.createDataFrame([(k,) for k in expected], "v string").select("v", cell_type(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == expected


def test_detection(grid_of, lexicon):
    found = {r.file_id: r for r in detect_headers(grid_of(FILES).repartition(3), lexicon).collect()}
    rows = {k: (r.header_row_index, r.confidence, r.keyword_confidence, r.is_pivoted) for k, r in found.items()}
    # text 30 points, unique 10 of them; typed cells below earn 60, text 40: (3 * 80 + 2 * 100) / 5 = 88
    assert rows["standard"][:2] == (2, 88) and rows["deep"][:2] == (61, 88)
    assert rows["standard"][3] is False and found["standard"].headers == HEADER
    assert rows["years"][:2] == (0, 16) and found["years"].state == "unpredictable"
    assert rows["numbers"] == (0, 0, 0, False)
    assert rows["vertical"] == (0, 80, 33, True) and found["vertical"].vertical_keyword_score == 100
    assert rows["single"][0] == -1 and found["single"].headers == []


def test_alias_table_gives_the_same(spark, grid_of, lexicon):
    grid = grid_of(FILES)
    a = detect_headers(grid, lexicon).orderBy("file_id").collect()
    b = detect_headers(grid, lexicon.alias_table(spark)).orderBy("file_id").collect()
    assert a == b


def test_choice_outside_file_is_null(spark, grid_of, lexicon):
    choices = spark.createDataFrame([("vertical", 1), ("single", 9)], "file_id string, row_idx int")
    got = {r.file_id: r for r in score_choice(grid_of(FILES), choices, lexicon).collect()}
    assert got["single"].confidence is None and got["single"].is_pivoted is None
    assert got["vertical"].confidence == 80 and got["vertical"].is_pivoted


def test_older_detector_accepts_year_series(grid_of):
    got = {r.file_id: r for r in detect_headers_contextual(grid_of({"years": FILES["years"]})).collect()}
    assert got["years"].is_pivoted and got["years"].header_row_index == 1


def test_older_detector_reads_all_rows_and_short_years(grid_of):
    deep = [[f"clause {i}"] for i in range(230)] + [["Item", "1/31/21", "2/28/21", "3/31/21"]] + [
        [f"T{i}", str(i), str(2 * i + 1), str(i + 9)] for i in range(2300)]
    got = detect_headers_contextual(grid_of({"deep": deep})).collect()
    assert (got[0].header_row_index, got[0].is_pivoted) == (230, True)


def test_ranges_see_the_rows_after_them(grid_of, monkeypatch):
    from tabloom.operators import contextual
    grid = grid_of({k: FILES[k] for k in ("standard", "years", "numbers", "single")})
    whole = contextual.contextual_scores(grid).select("file_id", "row_idx", "plain_score", "pivot_score").collect()
    monkeypatch.setattr(contextual, "RANGE", 7)
    parts = contextual.contextual_scores(grid).select("file_id", "row_idx", "plain_score", "pivot_score").collect()
    assert sorted(whole) == sorted(parts)


def test_sizes(spark):
    sizes = {0: "0 Bytes", 500: "500 Bytes", 1024: "1 KB", 1536: "1.5 KB", 653440: "638.13 KB", 10485760: "10 MB", 1075: "1.05 KB"}
    rows = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", readable_size(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == sizes
