import pytest
from pyspark.sql import functions as F

from tabloom.streaming import arrivals as A

HEAD = ["Supplier ID", "Supplier Name", "Country"]


def put(spark, path, k, files, rows=6):
    grid = [(name, i, HEAD if i == 0 else [f"S{i}", f"{name} {k}", "PT"]) for name in files for i in range(rows)]
    spark.createDataFrame(grid, A.GRID_SCHEMA).repartition("file_id").write.parquet(f"{path}/part{k}")


def run(spark, path, out, lexicon, **options):
    A.run_arrivals(A.grid_stream(spark, f"{path}/part*"), out, f"{out}-checkpoint", lexicon, available_now=True, **options).awaitTermination()


def counts(frame, by="file_id"):
    return {r[by]: r["count"] for r in frame.groupBy(by).count().collect()}


def test_known_names_over_three_batches(spark, tmp_path, lexicon):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, files in enumerate([["a", "b"], ["b", "c"], ["a", "c", "d"]]):
        put(spark, path, k, files)
        run(spark, path, out, lexicon)
    assert counts(A.committed(spark, out, "detected")) == dict.fromkeys("abcd", 1)
    assert counts(A.committed(spark, out, "rows")) == dict.fromkeys("abcd", 5)
    late = A.committed(spark, out, "late")
    assert counts(late) == {"a": 6, "b": 6, "c": 6}
    assert late.where("file_id = 'b' AND row_idx = 3").first()["cells"] == ["S3", "b 1", "PT"]
    assert {r.supplier_name for r in A.committed(spark, out, "rows").where("file_id = 'c'").collect()} == {"c 1"}


def test_one_name_twice_in_a_batch(spark, tmp_path, lexicon):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, 0, ["a"])
    put(spark, path, 1, ["a"])
    run(spark, path, out, lexicon)
    assert counts(A.committed(spark, out, "rows")) == {"a": 5} and counts(A.committed(spark, out, "late")) == {"a": 6}


def test_a_batch_that_fails_is_unseen_and_replayed(spark, tmp_path, lexicon, monkeypatch):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, 0, ["a"])
    run(spark, path, out, lexicon)
    put(spark, path, 1, ["a", "b"])
    whole = A.reshape

    def fails(*_):
        raise RuntimeError("executor of this step went away")
    monkeypatch.setattr(A, "reshape", fails)
    with pytest.raises(Exception, match="went away"):
        run(spark, path, out, lexicon)
    assert spark.read.parquet(f"{out}/detected").count() == 2  # written, but not finished
    assert counts(A.committed(spark, out, "detected")) == {"a": 1} and counts(A.committed(spark, out, "late")) == {}
    monkeypatch.setattr(A, "reshape", whole)
    run(spark, path, out, lexicon)
    assert counts(A.committed(spark, out, "detected")) == {"a": 1, "b": 1}
    assert counts(A.committed(spark, out, "rows")) == {"a": 5, "b": 5} and counts(A.committed(spark, out, "late")) == {"a": 6}


def test_names_are_state_of_the_query(spark, tmp_path, lexicon):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, 0, ["a", "b", "c"], rows=50)
    query = A.run_arrivals(A.grid_stream(spark, f"{path}/part*"), out, f"{out}-checkpoint", lexicon, available_now=True, typed_rows=False)
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert states and max(s["numRowsTotal"] for s in states) == 3  # a row a name, not a row a row
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert A.committed(spark, str(tmp_path / "nothing"), "rows") is None


def status_batch(spark, k):
    rows = [(f"f{i}", f"s{k}-{i}", k - i % 3, i) for i in range(40) if i % 5 != k % 5] + [("tie", f"t{k % 2}", 1, 1)]
    return rows, spark.createDataFrame(rows, "file_id string, status string, ts long, seq long")


def test_status_merge_reads_files_not_batches(spark, tmp_path):
    out, seen = str(tmp_path), {}
    for k in range(2 * A.MERGE_EVERY + 3):
        rows, frame = status_batch(spark, k)
        A.merge_status(frame, k, out)
        for f, status, ts, seq in rows:
            seen[f] = max(seen.get(f, (ts, seq, status)), (ts, seq, status))
        if k in (0, A.MERGE_EVERY - 2, A.MERGE_EVERY - 1, A.MERGE_EVERY, 2 * A.MERGE_EVERY + 2):
            got = A.current_status(spark, out)
            assert {r.file_id: r.status for r in got.collect()} == {f: s[2] for f, s in seen.items()}
    A.merge_status(frame, k, out)  # a replay
    assert {r.file_id: r.status for r in A.current_status(spark, out).collect()} == {f: s[2] for f, s in seen.items()}
    files = got.inputFiles()
    places = {f.split("/")[-2] for f in files if "/changes/" in f}
    assert len(places) == 3  # only the batches since the last merge
    assert len(list((tmp_path / "changes").iterdir())) <= 2 * A.MERGE_EVERY and len(list((tmp_path / "merged").iterdir())) == 2


def test_a_half_written_status_batch_is_unseen(spark, tmp_path):
    out = str(tmp_path)
    for k in range(3):
        A.merge_status(status_batch(spark, k)[1], k, out)
    before = {r.file_id: r.status for r in A.current_status(spark, out).collect()}
    rows = spark.createDataFrame([("f1", "half", 99, 99)], "file_id string, status string, ts long, seq long")
    rows.withColumn("batch_id", F.lit(3).cast("long")).write.parquet(f"{out}/changes/slot=3")
    assert {r.file_id: r.status for r in A.current_status(spark, out).collect()} == before
    assert A.current_status(spark, str(tmp_path / "none")).count() == 0


def test_rows_are_told_apart_by_the_names_that_are_not_new(spark, tmp_path, lexicon):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, files in enumerate([["a", "b"], ["b", "c", None]]):
        put(spark, path, k, files)
        run(spark, path, out, lexicon)
    known = {r._name.file_id for k in (0, 1) for r in spark.read.parquet(f"{out}/known/slot={k}").collect()}
    assert known == {"b"}
    assert counts(A.committed(spark, out, "late")) == {"b": 6}
    assert counts(A.committed(spark, out, "detected")) == {"a": 1, "b": 1, "c": 1, None: 1}


def test_names_that_came_before_do_not_fill_the_driver(spark, tmp_path, monkeypatch):
    came = spark.createDataFrame([(f"f{i % 9}", i, "x") for i in range(60)] + [(None, 60, "x")], "file_id string, row_idx long, arrival string")
    came = came.withColumn("_name", F.struct("file_id", "arrival"))
    want = {(r.file_id, r.row_idx) for r in came.collect()}
    for names, few in (([], 5), (["f1", "f2"], 5), (["f1", "f2"], 1)):
        monkeypatch.setattr(A, "FEW_NAMES", few)
        spark.createDataFrame([((n, "x"),) for n in names], "_name struct<file_id:string,arrival:string>").write.parquet(str(tmp_path / f"{len(names)}-{few}"))
        old = spark.read.parquet(str(tmp_path / f"{len(names)}-{few}"))
        late, fresh = A.late_and_fresh(came, old, F.col("row_idx"))
        assert {r.file_id for r in late.collect()} == set(names)
        assert {(r.file_id, r.row_idx) for x in (late, fresh) for r in x.collect()} == want and late.count() + fresh.count() == 61
        joins = [x._jdf.queryExecution().executedPlan().toString() for x in (late, fresh)]
        assert all(("BroadcastHashJoin" in j, "SortMergeJoin" in j) == (0 < len(names) <= few, len(names) > few) for j in joins)


def test_a_query_of_errors_takes_whole_files(spark, tmp_path):
    """Events whose numbers lie far apart: the rows of a user come in one arrival, so none is late and all are scored."""
    from tabloom.workload.queries import QUERIES
    from tabloom.workload import edges
    n = 1 << 14  # a range of row numbers
    events = spark.range(40).select((F.col("id") * n).alias("event_id"), (F.col("id") % 2 * 4).alias("user_id"), F.timestamp_seconds("id").alias("ts"),
                                    F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    seen, plain = [], edges.A.run_arrivals

    def run_and_keep(stream, out, *more, **options):
        seen.append(out)
        return plain(stream, out, *more, **options)
    edges.A.run_arrivals = run_and_keep
    try:
        got = {r.file_id: r.error for r in QUERIES["stream_errors"](spark, str(tmp_path)).collect()}
    finally:
        edges.A.run_arrivals = plain
    assert got == {"u0": "", "u4": "", "x0": "no header row found", "x4": "no header row found"}
    assert A.committed(spark, seen[0], "late").count() == 0
