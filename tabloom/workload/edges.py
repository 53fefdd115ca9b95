"""Sources, sinks and streams as queries: written from the test tables, read back, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contextual as O
from ..operators import detect as D
from ..operators import lexical as L
from ..operators import reshape as R
from ..plans import mapping as P
from ..session import scratch_dir
from ..sources import grids as G
from ..sources import sinks as S
from ..streaming import arrivals as A
from . import inputs as I
from . import sql as Q
from .queries import (SQL, alias_ctes, cast_sql, cleanse_sql, event_grid, joined, lexicon, oracle, query, reject_list_sql,
                      reshape_ctes, statement_detected, statement_grid, statement_reshape, trigram_ctes)

DELIMITERS = [",", "\t", "|", ";"]
WIDE = 640


# --- CSV files ---

def _quoted(cell):
    risky = F.coalesce(cell, F.lit("")).rlike("[\",;|\t\r\n]")
    return F.when(cell.isNull(), "").when(risky, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_sources(spark, d):
    """(name, seq, cells): files of a hundred documents or parts each; every tenth part has WIDE cells more."""
    docs = I.table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 100).cast("string")).alias("name"), F.col("doc_id").alias("seq"),
        F.array(F.col("doc_id").cast("string"), F.nullif("text", F.lit("")), F.nullif("lang", F.lit("")), F.lit(None).cast("string")).alias("cells"))
    key = F.col("p_partkey")
    base = F.array(key.cast("string"), F.concat(F.lit('the "'), "p_name", F.lit('", in; stock|')), "p_brand",
                   F.when(key % 3 == 0, F.col("p_type")))
    more = F.transform(F.sequence(F.lit(1), F.lit(WIDE)), lambda i: F.concat(F.lit("x"), i.cast("string")))
    parts = I.table(spark, d, "part").select(
        F.concat(F.lit("p"), F.floor(key / 100).cast("string")).alias("name"), key.alias("seq"),
        F.when(key % 10 == 0, F.concat(base, more)).otherwise(base).alias("cells"))
    return docs.unionByName(parts)


def write_files(texts, spark, name):
    """One file per row of (name, value), below a folder of its name."""
    path = scratch_dir(spark, name)
    texts.select("name", "value").repartition("name").write.partitionBy("name").text(path)
    return path


@query("csv_grids")
def _(spark, d):
    sign = F.get(F.array(*[F.lit(x) for x in DELIMITERS]), (F.substring("name", 2, 9).cast("int") % 4))
    line = F.call_function("array_join", F.transform("cells", _quoted), sign)
    texts = csv_sources(spark, d).select("name", "seq", line.alias("line")).groupBy("name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda r: r["line"]), "\n").alias("value"))
    rows = G.read_csv_grids(spark, write_files(texts, spark, "csv"), extensions=[".txt"])
    return rows.select(F.regexp_extract("file_id", "name=([^/]+)", 1).alias("file"), "row_idx", "cells")


@oracle("csv_grids")
def _():
    return f"""WITH x AS (SELECT 'd' || doc_id // 100 AS file, doc_id AS seq,
        [doc_id::VARCHAR, nullif(text, ''), nullif(lang, ''), NULL] AS cells FROM documents
      UNION ALL SELECT 'p' || p_partkey // 100, p_partkey, [p_partkey::VARCHAR, 'the "' || p_name || '", in; stock|', p_brand,
        CASE WHEN p_partkey % 3 = 0 THEN p_type END] || CASE WHEN p_partkey % 10 = 0 THEN
        list_transform(generate_series(1, {WIDE}), lambda i: 'x' || i) ELSE [] END FROM part)
      SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS row_idx, {joined('cells')} AS cells FROM x"""


@query("read_errors")
def _(spark, d):
    group = F.floor(F.col("c_custkey") / 50)
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    lines = I.table(spark, d, "customer").groupBy(group.alias("g")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("v"))
    kind = F.col("g") % 4
    value = (F.when(kind == 1, F.concat(F.col("v"), F.lit('\n9,"open'))).when(kind == 2, "\n\n")
             .when(kind == 3, F.repeat("v", 20)).otherwise(F.col("v")))
    texts = lines.select(F.concat(F.lit("e"), F.col("g").cast("string")).alias("name"), value.alias("value"))
    errors = G.read_errors(spark, write_files(texts, spark, "broken"), max_bytes=5000, extensions=[".txt"])
    return errors.select(F.regexp_extract("file_id", "name=([^/]+)", 1).alias("file"),
                         F.regexp_replace("error", "^'[^']*' ", "").alias("error"))


@oracle("read_errors")
def _():
    return """SELECT * FROM (SELECT 'e' || c_custkey // 50 AS file, CASE c_custkey // 50 % 4 WHEN 1 THEN 'a quoted cell does not end'
      WHEN 2 THEN 'no rows' WHEN 3 THEN CASE WHEN 20 * (sum(length(c_custkey::VARCHAR || ',' || c_name)) + count(*) - 1) > 5000
      THEN 'exceeds the 10 MB limit.' END END AS error FROM customer GROUP BY c_custkey // 50) WHERE error IS NOT NULL"""


# --- sheets, dictionaries, sinks ---

@query("sheet_grids")
def _(spark, d):
    path = scratch_dir(spark, "sheets")
    I.statement_lines(spark, d).write.parquet(path)
    return G.read_sheet_grids(spark, path).select("file_id", "line_no", "cells")


@oracle("sheet_grids")
def _():
    c = Q.Ctes()
    Q.statement_lines(c)
    return c.sql(f"SELECT file_id, line_no, {joined('cells')} AS cells FROM statement_lines")


@query("alias_dictionary")
def _(spark, d):
    path = scratch_dir(spark, "aliases")
    brands = I.table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "types"))), lambda e: F.concat(
        F.to_json(F.array(e["p_brand"])), F.lit(":\n"), F.to_json(e["types"])))
    texts = brands.agg(entries.alias("e")).select(F.concat(F.lit("{\n"), F.array_join(F.transform(
        "e", lambda x: F.regexp_replace(x, "^\\[(.*)\\]:", "$1:")), ",\n"), F.lit("\n}")).alias("value"))
    texts.write.text(path)
    return G.read_alias_dictionary(spark, path)


@oracle("alias_dictionary")
def _():
    return """WITH b AS (SELECT DISTINCT p_brand, p_type FROM part)
      SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS key_pos, p_brand AS target_key,
      row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS alias_pos, p_type AS alias FROM b"""


@query("results_sink")
def _(spark, d):
    path = scratch_dir(spark, "results")
    S.write_results(statement_detected(spark, d).select("file_id", "header_row_index", "confidence", "state"), path, "csv", by="state")
    back = spark.read.option("header", True).schema("file_id string, header_row_index long, confidence long, state string").csv(path)
    return back.select("file_id", "header_row_index", "confidence", "state")


@oracle("results_sink")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    return c.sql("SELECT file_id, header_row_index, confidence, state FROM detected")


@query("batch_sink")
def _(spark, d):
    path = scratch_dir(spark, "batches")
    S.write_batches(statement_grid(spark, d).select("file_id", "row_idx", "cells"), path, 4)
    return spark.read.parquet(path).select("file_id", "batch_no", "row_idx", "cells")


@oracle("batch_sink")
def _():
    c = Q.Ctes()
    Q.statement_grid(c)
    return c.sql(f"SELECT file_id, row_idx // 4 AS batch_no, row_idx, {joined('cells')} AS cells FROM statement_grid")


# --- files whose header lies below the live detector's sample ---

def supplier_lines(spark, d):
    """(file_id, line_no, cells): per supplier some 205 to 244 notes, a header, then its lines."""
    lines = I.table(spark, d, "lineitem")
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_id")
    suppliers = lines.select("l_suppkey").distinct()
    notes = suppliers.select(name, F.explode(F.sequence(F.lit(0).cast("long"), 204 + F.col("l_suppkey") % 40)).alias("line_no")).select(
        "file_id", "line_no", F.array(F.concat(F.lit("note "), F.col("line_no").cast("string"))).alias("cells"))
    head = suppliers.select(name, F.lit(900).cast("long").alias("line_no"), F.when(F.col("l_suppkey") % 2 == 0, F.array(
        *map(F.lit, ["Item", "1/31/21", "2/28/21", "3/31/21"]))).otherwise(F.array(*map(F.lit, ["Flag", "Mail", "Net", "Price"]))).alias("cells"))
    body = lines.select(name, ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).cast("long").alias("line_no"), F.array(
        F.col("l_returnflag"), F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit("@mail.example")),
        F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("cells"))
    return notes.unionByName(head).unionByName(body)


def supplier_grid_sql(c):
    c.add("supplier_lines", f"""SELECT 's' || l_suppkey AS file_id, unnest(generate_series(0, 204 + l_suppkey % 40)) AS line_no,
        ['note ' || unnest(generate_series(0, 204 + l_suppkey % 40))] AS cells FROM (SELECT DISTINCT l_suppkey FROM lineitem)
      UNION ALL SELECT DISTINCT 's' || l_suppkey, 900, CASE WHEN l_suppkey % 2 = 0 THEN ['Item', '1/31/21', '2/28/21', '3/31/21']
        ELSE ['Flag', 'Mail', 'Net', 'Price'] END FROM lineitem
      UNION ALL SELECT 's' || l_suppkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey, [l_returnflag, 'u' || l_partkey || '@mail.example',
        {Q.money('l_quantity')}, {Q.money('l_extendedprice')}] FROM lineitem""")
    return Q.numbered(c, "supplier_lines", "supplier_grid")


@query("contextual_scores_deep")
def _(spark, d):
    return O.contextual_scores(G.number_rows(supplier_lines(spark, d))).select("file_id", "row_idx", "plain_score", "pivot_score")


@oracle("contextual_scores_deep")
def _():
    c = Q.Ctes()
    Q.contextual(c, supplier_grid_sql(c))
    return c.sql("SELECT file_id, row_idx, plain_score, pivot_score FROM o_rows")


@query("masked_sample_deep")
def _(spark, d):
    heads = I.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file_id"), (
        205 + F.col("l_suppkey") % 40).alias("header_row_index")).distinct()
    return R.masked_sample(G.number_rows(supplier_lines(spark, d)), heads)


@oracle("masked_sample_deep")
def _():
    c = Q.Ctes()
    grid = supplier_grid_sql(c)
    return c.sql(f"""SELECT g.file_id, g.row_idx, array_to_string([cells[1], 'user@example.com', '999.99', '999.99'], '|') AS cells
      FROM {grid} g JOIN (SELECT DISTINCT l_suppkey FROM lineitem) s ON g.file_id = 's' || l_suppkey
      WHERE g.row_idx BETWEEN 206 + l_suppkey % 40 AND 215 + l_suppkey % 40""")


# --- profiles of two clients, layouts in several scripts ---

LAYOUTS = [["Vendor ID", "Country"], ["vendor-id", "COUNTRY "], ["供应商", "国家"], ["Поставщик", "Страна"], ["ספק", "מדינה"]]


def layouts(spark, d):
    names = F.get(F.array(*[F.array(*map(F.lit, x)) for x in LAYOUTS]), (F.col("c_custkey") % 5).cast("int"))
    return I.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"), "c_custkey",
                                                F.lit(0).alias("header_row_index"), names.alias("headers"))


@query("layout_fingerprints")
def _(spark, d):
    return P.with_fingerprint(layouts(spark, d)).select("file_id", "fingerprint")


@oracle("layout_fingerprints")
def _():
    normal = [["vendorid", "country"], ["vendorid", "country"], ["供应商", "国家"], ["поставщик", "страна"], ["ספק", "מדינה"]]
    cases = " ".join(f"WHEN {k} THEN '{'|'.join(x)}'" for k, x in enumerate(normal))
    return f"SELECT 'c' || c_custkey AS file_id, sha256(CASE c_custkey % 5 {cases} END) AS fingerprint FROM customer"


@query("client_profiles")
def _(spark, d):
    """Client a saves all layouts but the last, later the third anew with the columns swapped; client b saves the fourth."""
    files = layouts(spark, d)

    def saved(some, client, at, column):
        mapped = some.select("file_id", F.lit(0).alias("target_pos"), F.lit("supplier_id").alias("target_id"),
                             F.array(F.get("headers", F.lit(column))).alias("sources"), F.lit(0.9).alias("confidence"))
        return P.confirmed_profiles(mapped, some, at, client)
    profiles = P.save_profiles(P.save_profiles(saved(files.where("c_custkey % 5 < 4"), "a", "2024-01-01 00:00:00", 0),
                                               saved(files.where("c_custkey % 5 = 2"), "a", "2024-03-01 00:00:00", 1)),
                               saved(files.where("c_custkey % 5 = 3"), "b", "2024-02-01 00:00:00", 1))
    hits = [P.cache_hits(files, profiles, c).select(F.lit(c).alias("client_id"), "file_id", F.coalesce(
        F.get(F.get("slots", F.lit(0))["columns"], F.lit(0)), F.lit(-1)).cast("long").alias("column_no")) for c in ("a", "b")]
    return hits[0].unionByName(hits[1])


@oracle("client_profiles")
def _():
    return """SELECT 'a' AS client_id, 'c' || c_custkey AS file_id, CASE c_custkey % 5 WHEN 4 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS column_no FROM customer
      UNION ALL SELECT 'b', 'c' || c_custkey, CASE c_custkey % 5 WHEN 3 THEN 1 ELSE -1 END FROM customer"""


# --- mappings of files without names; all columns of typed rows ---

@query("complete_mapping")
def _(spark, d):
    files = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file_id"))
    some = I.line_headers(spark, d).where("src_pos % 3 = 0")
    return P.map_headers(some, lexicon(), 0.4, files=files).groupBy("file_id").agg(
        F.count("*").alias("n_targets"), F.count_if(F.size("sources") > 0).alias("n_mapped"))


@oracle("complete_mapping")
def _():
    c = Q.Ctes()
    Q.line_headers(c)
    c.add("third", "SELECT * FROM line_headers WHERE src_pos % 3 = 0")
    Q.mapping(c, "third", lexicon(), "standard", 0.4)
    return c.sql("""SELECT 'o' || o_orderkey AS file_id, 26::BIGINT AS n_targets, count(m.source) AS n_mapped
      FROM orders LEFT JOIN mapping m ON m.file_id = 'o' || o_orderkey GROUP BY o_orderkey""")


@query("reshape_all")
def _(spark, d):
    grid, detected, mapped = statement_reshape(spark, d)
    rows = R.reshape(grid, detected, mapped, lexicon())
    text = [F.coalesce(F.col(t).cast("string"), F.lit("~")) for t in lexicon().target_ids]
    return rows.select("file_id", "row_idx", F.concat_ws("|", *text).alias("typed_values"), F.array_join("rejects", ",").alias("rejects"),
                       F.array_join("missing", ",").alias("missing"))


@oracle("reshape_all")
def _():
    values = ", '|', ".join(f"coalesce(({cast_sql(t)})::VARCHAR, '~')" for t in lexicon().target_ids)
    missing = "[" + ", ".join(f"CASE WHEN {t.target_id} IS NULL THEN '{t.target_id}' END" for t in lexicon().targets if t.required) + "]"
    return reshape_ctes().sql(f"""SELECT file_id, row_idx, concat({values}) AS typed_values, array_to_string({reject_list_sql()}, ',') AS rejects,
      array_to_string(list_filter({missing}, lambda x: x IS NOT NULL), ',') AS missing FROM wide""")


# --- accented and damaged headers ---

ACCENTED = ["Téléphone", "Paÿs ", "Country", "Währung", "Číslo", "Ταχύς", "Tax ID", "Émail Addréss", "Cu\ufffdrency", "\u0301Cíty State"]


def accented_headers(spark, d):
    names = F.get(F.array(*map(F.lit, ACCENTED)), (F.col("s_suppkey") % len(ACCENTED)).cast("int"))
    return I.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_id"), "s_suppkey", names.alias("source"))


def accented_aliases(spark):
    """The default aliases, and some as people in other countries write them."""
    own = lexicon().alias_table(spark)
    more = [(1000 + k, key, 0, alias) for k, (key, alias) in enumerate([("phone number", "telephone"), ("country", "pays"), ("currency", "währung"),
                                                                        ("supplier id", "cislo"), ("country", "ταχυς")])]
    return own.unionByName(spark.createDataFrame(more, own.schema))


@query("accented_alias_match")
def _(spark, d):
    """Headers with accents meet aliases with and without them."""
    return (L.alias_match(accented_headers(spark, d), accented_aliases(spark)).select("source", "target_id", "method", F.round("score", 6).alias("score")))


@oracle("accented_alias_match")
def _():
    c = alias_ctes()
    more = ", ".join(f"({1000 + k}, '{key}', 0, '{alias}')" for k, (key, alias) in enumerate([
        ("phone_number", "telephone"), ("country", "pays"), ("currency", "währung"), ("supplier_id", "cislo"), ("country", "ταχυς")]))
    names = ", ".join(f"'{x}'" for x in ACCENTED)
    c.add("every", f"SELECT key_pos, target_id, alias_pos, alias FROM alias UNION ALL SELECT * FROM (VALUES {more}) v(key_pos, target_id, alias_pos, alias)")
    c.add("src2", f"SELECT DISTINCT ([{names}])[s_suppkey % {len(ACCENTED)} + 1] AS source FROM supplier")
    c.add("first2", f"SELECT {cleanse_sql('alias')} AS cleansed, arg_min(target_id, key_pos) AS target_id FROM every GROUP BY ALL")
    c.add("exact", f"SELECT source, target_id FROM src2 JOIN first2 ON cleansed = {cleanse_sql('source')}")
    c.add("rest", "SELECT source FROM src2 WHERE source NOT IN (SELECT source FROM exact)")
    trigram_ctes(c, "rest", "every")
    return c.sql("""SELECT source, target_id, 'exact' AS method, 1.0::DOUBLE AS score FROM exact
      UNION ALL SELECT r.source, CASE WHEN similarity >= 0.5 THEN t.target_id END, CASE WHEN similarity >= 0.5 THEN 'trigram' ELSE 'none' END,
      round(coalesce(similarity, 0.0), 6) FROM rest r LEFT JOIN trigram t ON t.source = r.source""")


@query("header_readability")
def _(spark, d):
    """Detections of files whose header row is whole, damaged or missing."""
    top = accented_headers(spark, d).withColumn("second", F.when(F.col("s_suppkey") % 3 == 0, F.lit("ID\x02")).otherwise("ID"))
    lines = [F.struct(F.lit(0).cast("long").alias("row_idx"), F.array("source", "second").alias("cells"))] + [
        F.struct(F.lit(k).cast("long").alias("row_idx"), F.array(F.lit(f"x{k}"), F.lit(str(k))).alias("cells")) for k in (1, 2, 3)]
    whole = top.where("s_suppkey % 7 <> 0").select("file_id", F.explode(F.array(*lines)).alias("r")).select("file_id", "r.*")
    alone = top.where("s_suppkey % 7 = 0").select("file_id", F.lit(0).cast("long").alias("row_idx"), F.array("source").alias("cells"))
    return D.detect_headers(whole.unionByName(alone), lexicon()).select("file_id", F.col("header_row_index").cast("long").alias("header_row_index"),
                                                                       "readability")


@oracle("header_readability")
def _():
    damaged = " OR ".join([f"s_suppkey % {len(ACCENTED)} = {k}" for k, x in enumerate(ACCENTED) if "\ufffd" in x] + ["s_suppkey % 3 = 0"])
    return f"""SELECT 's' || s_suppkey AS file_id, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE 0 END::BIGINT AS header_row_index,
      CASE WHEN s_suppkey % 7 = 0 THEN 'blocking' WHEN {damaged} THEN 'recoverable' ELSE 'ok' END AS readability FROM supplier"""


# --- streams ---

def _event_arrivals(spark, d, rounds, typed_rows=False, batch_size=1000):
    """Events of users as grid files over three arrivals: in round k come the users ``rounds(k)``; whole files, dealt by name."""
    grid = event_grid(spark, d).select("file_id", "row_idx", "cells")  # detection samples by itself
    number = F.substring("file_id", 2, 9).cast("long")
    out, path = scratch_dir(spark, "arrivals"), scratch_dir(spark, "arriving")
    for k in range(3):
        grid.where(rounds(k, number)).repartition("file_id").write.parquet(f"{path}/part{k}")
        A.run_arrivals(A.grid_stream(spark, f"{path}/part*"), out, f"{out}-checkpoint", lexicon(), available_now=True,
                       typed_rows=typed_rows, batch_size=batch_size).awaitTermination()
    return out


@query("stream_rows")
def _(spark, d):
    """Typed rows of whole files, a third of the users in each arrival."""
    out = _event_arrivals(spark, d, lambda k, number: number % 3 == k, True, 5)
    found = A.committed(spark, out, "detected").select("file_id", F.col("header_row_index").cast("long").alias("header_row_index"), "state")
    rows = A.committed(spark, out, "rows").groupBy("file_id").agg(F.count("*").alias("n"), F.max("batch_no").alias("last_batch"))
    return found.join(rows, "file_id", "left").select("file_id", "header_row_index", "state", F.coalesce("n", F.lit(0)).alias("n_rows"),
                                                      F.coalesce("last_batch", F.lit(-1)).alias("last_batch"))


@oracle("stream_rows")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.event_grid(c), lexicon())
    return c.sql("""SELECT d.file_id, d.header_row_index, d.state, count(g.row_idx) AS n_rows, coalesce(max(g.row_idx // 5), -1) AS last_batch
      FROM detected d LEFT JOIN event_grid g ON g.file_id = d.file_id AND d.state = 'confident' AND g.row_idx > d.header_row_index GROUP BY ALL""")


@query("stream_skip_known")
def _(spark, d):
    """All users come at first, every second one again, every third one once more: known names, whose rows are kept as late."""
    out = _event_arrivals(spark, d, lambda k, number: number % (k + 1) == 0)
    late = A.committed(spark, out, "late").groupBy("file_id").agg(F.count("*").alias("late_rows"), F.sum("row_idx").alias("late_places"))
    return (A.committed(spark, out, "detected").groupBy("file_id").agg(F.count("*").alias("times")).join(late, "file_id", "left")
            .select("file_id", "times", F.coalesce("late_rows", F.lit(0)).alias("late_rows"), F.coalesce("late_places", F.lit(0)).alias("late_places")))


@oracle("stream_skip_known")
def _():
    c = Q.Ctes()
    Q.event_grid(c)
    return c.sql("""SELECT file_id, 1::BIGINT AS times, k * count(*) AS late_rows, (k * sum(row_idx))::BIGINT AS late_places FROM (
      SELECT *, CASE WHEN u % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN u % 3 = 0 THEN 1 ELSE 0 END AS k FROM (
        SELECT *, substr(file_id, 2)::BIGINT AS u FROM event_grid)) GROUP BY file_id, k""")


@query("stream_status_batches")
def _(spark, d):
    """Orders arrive in twenty parts; merges and changes since the last one together give the newest status."""
    out, path = scratch_dir(spark, "status"), scratch_dir(spark, "arriving")
    orders = I.table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    orders.repartitionByRange(20, F.hash("seq")).write.parquet(path)
    history = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(path)
    A.run_latest_status(history, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    return A.current_status(spark, out)


SQL["stream_status_batches"] = lambda: SQL["stream_status"]()


@query("stream_errors")
def _(spark, d):
    """Files without a usable row end with an error text and do not hold up the others."""
    out = scratch_dir(spark, "arrivals")
    path = scratch_dir(spark, "arriving")
    events = I.table(spark, d, "events")
    good = event_grid(spark, d).select("file_id", "row_idx", "cells")
    bad = events.select(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("file_id")).distinct().select(
        "file_id", F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("alone")).alias("cells"))
    good.unionByName(bad).repartition("file_id").write.parquet(f"{path}/part0")  # a file arrives whole
    A.run_arrivals(A.grid_stream(spark, f"{path}/part*"), out, f"{out}-checkpoint", lexicon(), available_now=True,
                   typed_rows=False).awaitTermination()
    return A.committed(spark, out, "detected").select("file_id", F.coalesce("error", F.lit("")).alias("error"))


@oracle("stream_errors")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.event_grid(c), lexicon())
    return c.sql("""SELECT file_id, CASE WHEN header_row_index < 0 THEN 'no header row found' ELSE '' END AS error FROM detected
      UNION ALL SELECT DISTINCT 'x' || user_id, 'no header row found' FROM events""")
