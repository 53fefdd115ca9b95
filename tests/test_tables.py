import os

import pytest
from pyspark.sql import functions as F

from tabloom.operators.common import dense_index
from tabloom.operators.reshape import reshape
from tabloom.plans.mapping import map_headers, map_with_fallback
from tabloom.operators.detect import detect_headers, header_list
from tabloom.sources.grids import drop_blank_rows, head_rows, read_alias_dictionary, read_csv_grids, read_errors
from tabloom.sources.ledger import admit, new_files
from tabloom.workload import edges  # noqa: F401  (adds its queries)
from tabloom.workload.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def test_csv_keeps_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title\n\na,b,c,d\n1,,\n,,,\n"x, y",2\n')
    rows = read_csv_grids(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(5))
    assert [len(r.cells) for r in rows] == [1, 4, 3, 4, 2]
    assert rows[4].cells[0] == "x, y"


def test_csv_delimiters_quotes_width_and_bad_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_bytes(text.encode())
    put("semi.csv", '\ufeffa;b;c\r\n1;"x;""y""\nz";3\r\n')
    put("tab.csv", "p\tq,q\tr\n1\t2,2\t3\n")
    put("pipe.csv", 'p|q\n5" pipe|"q"tail\n')
    put("wide.csv", ",".join(f"c{i}" for i in range(700)) + "\n" + ",".join(f'"v,{i}"' for i in range(700)) + "\n")
    put("open.csv", 'a,b\n1,"open\n2,3\n')
    put("none.csv", "\n\n")
    put("big.csv", "a,b\n" * 4000)
    put("note.txt", "a,b\n")
    got = {}
    for r in read_csv_grids(spark, str(tmp_path), max_bytes=15_000).orderBy("row_idx").collect():
        got.setdefault(r.file_id.rsplit("/", 1)[1], []).append(r.cells)
    assert got.pop("wide.csv") == [[f"c{i}" for i in range(700)], [f"v,{i}" for i in range(700)]]
    assert got == {"semi.csv": [["a", "b", "c"], ["1", 'x;"y"\nz', "3"]], "tab.csv": [["p", "q,q", "r"], ["1", "2,2", "3"]],
                   "pipe.csv": [["p", "q"], ['5" pipe', "qtail"]]}
    errors = {r.file_id.rsplit("/", 1)[1]: r.error for r in read_errors(spark, str(tmp_path), max_bytes=15_000).collect()}
    assert set(errors) == {"open.csv", "none.csv", "big.csv", "note.txt"}


def test_alias_dictionary_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "supplier id": ["vendor no",\n  "code"],\n "country": []\n}')
    rows = read_alias_dictionary(spark, str(tmp_path)).orderBy("key_pos", "alias_pos").collect()
    assert [(r.target_key, r.alias) for r in rows] == [("supplier id", "vendor no"), ("supplier id", "code")]


def test_numbering_equals_plain_window(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37).alias("n"))
    got = dense_index(rows, ["g"], "n", "i", fan_out=8).collect()
    for g in range(3):
        part = sorted((r.n, r.i) for r in got if r.g == g)
        assert [i for _, i in part] == list(range(len(part)))


def test_head_of_blank_free_rows(spark):
    rows = spark.createDataFrame([("f", 0, [None]), ("f", 5, ["a"]), ("f", 9, ["b"])], "file_id string, line_no long, cells array<string>")
    got = head_rows(drop_blank_rows(rows), 1).collect()
    assert [(r.line_no, r.row_idx) for r in got] == [(5, 0)]


def test_admission(spark):
    ledger = spark.createDataFrame([("a.csv", 5, ""), ("b.XLSX", 5, ""), ("c.txt", 5, ""), ("csv", 5, ""), ("d.csv", 10485761, ""),
                                    ("e.bin", 5, "text/csv")], "file_name string, length long, mime_type string")
    bad = {r.file_name for r in admit(ledger).where("reject_reason is not null").collect()}
    assert bad == {"c.txt", "csv", "d.csv"}
    assert new_files(ledger, ledger.where("file_name = 'a.csv'")).count() == 5


def test_reshape_rejects_and_missing(grid_of, lexicon):
    names = [t.label for t in lexicon.targets]
    good = ["S1", "N", "A", "L", "1 Road", "X", "1", "US", "5", "a@b.c", "t", "Net", "ACH", "USD", *["7"] * 6, *["1.50"] * 6]
    bad = list(good)
    bad[0], bad[14], bad[20] = "", "One Hundred", "Wrong"
    grid = grid_of({"f": [names, good, bad]})
    detected = detect_headers(grid, lexicon)
    rows = reshape(grid, detected, map_headers(header_list(detected), lexicon, 0.4), lexicon).orderBy("row_idx").collect()
    assert rows[0].rejects == [] and rows[0].missing == [] and rows[0].total_invoices == 7
    assert rows[1].rejects == ["total_invoices", "total_amount_invoices"] and rows[1].missing == ["supplier_id"]


def test_fallback_fills_only_gaps(header_rows, lexicon):
    headers = header_rows({"f": ["Supplier ID", "supplienameemail", "telephonenumber"]})
    got = map_with_fallback(headers, lexicon, threshold=0.4)
    rows = {r.target_id: r for r in got.where(F.size("sources") > 0).collect()}
    assert rows["supplier_id"].matcher == "standard"
    assert got.count() == 26


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["detect_headers", "map_standard", "apply_edits", "reshape", "bm25_top", "stream_detect", "stream_status",
                                  "deep_tokens_corpus", "bm25_documents_top"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    ours = QUERIES[name](spark, SMALL)
    columns = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]()})").fetchall()

    def tidy(rows):
        return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert tidy(tuple(r) for r in ours.select(*columns).collect()) == tidy(theirs)


def test_streams_take_whole_files(spark, tmp_path):
    spark.range(10 * 450).selectExpr("id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "id % 10 AS user_id",
                                     "'view' AS event_type", "id / 7D AS value", """'{"k": 5}' AS props""").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["stream_rows"](spark, str(tmp_path)).where("state = 'confident'").collect()
    assert rows and all(r["n_rows"] == 450 - r["header_row_index"] and r["last_batch"] == 90 for r in rows)
    again = QUERIES["stream_skip_known"](spark, str(tmp_path)).collect()
    assert sorted((r["file_id"], r["times"], r["late_rows"]) for r in again) == [
        (f"u{u}", 1, 451 * ((u % 2 == 0) + (u % 3 == 0))) for u in range(10)]
