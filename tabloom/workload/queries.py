"""Every operator as a query over the whole TPC-H-like tables, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import lexicon as lex
from ..functions import cells as C
from ..functions import text as X
from ..operators import contextual as O
from ..operators import detect as D
from ..operators import keywords as K
from ..operators import lexical as L
from ..operators import matching as M
from ..operators import reshape as R
from ..operators import review as V
from ..operators import structure as S
from ..operators import vocabulary as VO
from ..operators.common import range_rank
from ..plans import mapping as P
from ..session import scratch_dir
from ..sources import grids as G
from ..sources import ledger as FL
from ..sources.sinks import tagged_batches
from ..streaming import arrivals as A
from . import inputs as I
from . import sql as Q

THRESHOLD = 0.4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, Callable[[], str]] = {}


@cache
def lexicon() -> lex.Lexicon:
    return lex.default_lexicon()


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, decimals as double, lists as text, so both engines print the same."""
    def out(field) -> Column:
        kind = field.dataType.simpleString()
        col = F.col(field.name)
        if kind in ("int", "smallint", "tinyint"):
            return col.cast("bigint").alias(field.name)
        if kind.startswith("decimal"):
            return col.cast("double").alias(field.name)
        if kind == "array<string>":
            return F.array_join(col, "|", "~").alias(field.name)
        if kind == "double":
            return F.round(col, 6).alias(field.name)
        return col
    return df.select([out(f) for f in df.schema.fields])


def comparable(df: DataFrame) -> DataFrame:
    """-1 for absent whole numbers and false for absent flags: engines differ in how they print those."""
    def out(field) -> Column:
        kind = field.dataType.simpleString()
        col = F.col(field.name)
        if kind in ("int", "bigint"):
            return F.coalesce(col, F.lit(-1)).alias(field.name)
        return F.coalesce(col, F.lit(False)).alias(field.name) if kind == "boolean" else col
    return df.select([out(f) for f in df.schema.fields])


def query(name: str):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        return fn
    return wrap


def oracle(name: str):
    def wrap(fn):
        SQL[name] = fn
        return fn
    return wrap


def joined(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: coalesce(x, '~')), '|')"


# --- inputs ---

def statement_head(spark, d):
    return G.head_rows(G.drop_blank_rows(I.statement_lines(spark, d)))


def statement_grid(spark, d):
    return G.number_rows(G.drop_blank_rows(I.statement_lines(spark, d)))


def event_head(spark, d):
    return G.head_rows(I.event_lines(I.table(spark, d, "events")))


def event_grid(spark, d):
    return G.number_rows(I.event_lines(I.table(spark, d, "events")))


def line_mapping(spark, d, mode="standard"):
    return P.map_headers(I.line_headers(spark, d), lexicon(), THRESHOLD, mode)


def distinct_sources(spark, d):
    return I.line_headers(spark, d).select("source").distinct()


def statement_detected(spark, d):
    return D.detect_headers(statement_head(spark, d), lexicon())


def ledger(spark, d):
    ext = F.get(F.array(*[F.lit(e) for e in (".csv", ".XLSX", ".txt", ".xls", "")]), (F.col("doc_id") % 5).cast("int"))
    return I.table(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext).alias("file_name"),
        (F.col("n_chars") * 1021).alias("length"),
        F.when(F.col("doc_id") % 3 == 0, "text/csv").otherwise("").alias("mime_type"))


LEDGER_SQL = """ledger AS (SELECT doc_id, source || '_' || doc_id || ['.csv', '.XLSX', '.txt', '.xls', ''][(doc_id % 5) + 1]
  AS file_name, n_chars * 1021 AS length, CASE WHEN doc_id % 3 = 0 THEN 'text/csv' ELSE '' END AS mime_type FROM documents)"""


# --- cells and rows ---

@query("cell_types")
def _(spark, d):
    return G.cells_of(statement_grid(spark, d)).withColumn("cell_key", C.cell_key(F.col("value")))


@oracle("cell_types")
def _():
    c = Q.Ctes()
    Q.statement_grid(c)
    c.add("x", "SELECT file_id, row_idx, i - 1 AS col_idx, cells[i] AS value FROM "
               "(SELECT *, unnest(generate_series(1, len(cells))) AS i FROM statement_grid)")
    return c.sql(f"SELECT *, {Q.cell_type('value')} AS cell_type, nullif(lower({Q.trim('value')}), '') AS cell_key FROM x")


@query("cell_type_counts")
def _(spark, d):
    grids = I.document_grid(spark, d).unionByName(I.chat_grid(spark, d))
    cells = grids.select(F.explode("cells").alias("value")).select(C.cell_type(F.col("value")).alias("cell_type"))
    return cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"))


@oracle("cell_type_counts")
def _():
    c = Q.Ctes()
    Q.document_grid(c), Q.chat_grid(c)
    c.add("x", "SELECT unnest(cells) AS value FROM document_grid UNION ALL SELECT unnest(cells) FROM chat_grid")
    return c.sql(f"SELECT {Q.cell_type('value')} AS cell_type, count(*) AS n_cells FROM x GROUP BY ALL")


@query("file_width")
def _(spark, d):
    typed = S.typed_rows(S.head_sample(I.document_grid(spark, d)))
    return typed.groupBy("file_id").agg(F.greatest(F.max("filled"), F.lit(1)).alias("width"),
                                        F.max("row_idx").alias("last_row"))


@oracle("file_width")
def _():
    c = Q.Ctes()
    Q.typed(c, Q.document_grid(c))
    return c.sql("SELECT * FROM t_file")


@query("row_fill")
def _(spark, d):
    return S.typed_rows(statement_grid(spark, d)).select("file_id", "row_idx", "filled", "numeric_cells")


@oracle("row_fill")
def _():
    c = Q.Ctes()
    Q.typed(c, Q.statement_grid(c), sample=False)
    return c.sql("SELECT file_id, row_idx, filled, numeric_cells FROM t_rows")


@query("row_unique")
def _(spark, d):
    rows = S.typed_rows(I.chat_grid(spark, d))
    return rows.select("file_id", "row_idx", S.unique_string_cells(
        F.col("types"), F.col("keys"), F.size("cells")).alias("unique_texts"))


@oracle("row_unique")
def _():
    c = Q.Ctes()
    Q.typed(c, Q.chat_grid(c))
    c.add("x", "SELECT *, count(*) OVER (PARTITION BY file_id, row_idx, k) AS same FROM t_cells")
    return c.sql("SELECT file_id, row_idx, count(*) FILTER (t = 'string' AND same = 1) AS unique_texts FROM x GROUP BY ALL")


@query("first_type_below")
def _(spark, d):
    rows = O.with_following(statement_grid(spark, d))
    return rows.select("file_id", "row_idx", F.posexplode("cells").alias("col_idx", "value"), "below").select(
        "file_id", "row_idx", "col_idx", S.first_type_below(F.col("below"), F.col("col_idx")).alias("type_below"))


@oracle("first_type_below")
def _():
    c = Q.Ctes()
    Q.structural(c, Q.statement_grid(c), sample=False)
    return c.sql("SELECT file_id, row_idx, col_idx, below AS type_below FROM s_cells")


@query("has_data_below")
def _(spark, d):
    return O.with_following(I.document_grid(spark, d)).select("file_id", "row_idx", "data_below")


@oracle("has_data_below")
def _():
    c = Q.Ctes()
    Q.structural(c, Q.document_grid(c), sample=False)
    return c.sql("SELECT file_id, row_idx, data_below FROM s_below")


ROW_SCORE_COLUMNS = ["file_id", "row_idx", "width", "filled", "numeric_cells", "present", "texts", "unique_texts",
                     "boundaries", "consistent", "base", "score"]
ROW_SCORE_SQL = "SELECT " + ", ".join("round(base, 6) AS base" if x == "base" else x for x in ROW_SCORE_COLUMNS) + " FROM s_rows"


def _row_scores(name, spark_grid, sql_grid):
    @query(name)
    def _(spark, d):
        return S.score_rows(spark_grid(spark, d)).select(*ROW_SCORE_COLUMNS)

    @oracle(name)
    def _():
        c = Q.Ctes()
        Q.structural(c, sql_grid(c))
        return c.sql(ROW_SCORE_SQL)


_row_scores("row_scores", statement_head, Q.statement_grid)
_row_scores("row_scores_documents", I.document_grid, Q.document_grid)
_row_scores("row_scores_chats", I.chat_grid, Q.chat_grid)
_row_scores("row_scores_events", event_head, Q.event_grid)


@query("best_row")
def _(spark, d):
    scored = S.score_rows(I.document_grid(spark, d), keep=("cells",)).withColumn(
        "first_key", F.get(C.row_keys(F.col("cells")), F.lit(0)))
    return D.best_rows(scored).select("file_id", "best.row_idx", "best.score").where("row_idx is not null")


@oracle("best_row")
def _():
    c = Q.Ctes()
    Q.structural(c, Q.document_grid(c))
    Q.best(c)
    return c.sql("SELECT file_id, row_idx, score FROM b_rows")


@query("header_names")
def _(spark, d):
    return I.chat_grid(spark, d).select("file_id", "row_idx", C.header_names(F.col("cells")).alias("names"))


@oracle("header_names")
def _():
    c = Q.Ctes()
    Q.chat_grid(c)
    return c.sql(f"SELECT file_id, row_idx, array_to_string({Q.NAMES}, '|') AS names FROM chat_grid")


# --- detection ---

@query("keyword_scores")
def _(spark, d):
    return K.score_keywords(statement_grid(spark, d), lexicon())


@query("keyword_scores_by_join")
def _(spark, d):
    return K.score_keywords(statement_grid(spark, d), lexicon().alias_table(spark))


def _keyword_sql():
    c = Q.Ctes()
    Q.typed(c, Q.statement_grid(c), sample=False)
    Q.keyword_rows(c, lexicon())
    return c.sql("SELECT file_id, row_idx, block, matches AS keyword_matches, keyword_score FROM k_rows")


SQL["keyword_scores"] = _keyword_sql
SQL["keyword_scores_by_join"] = _keyword_sql


@query("vertical_scores")
def _(spark, d):
    grid = I.card_lines(spark, d)
    keys = grid.withColumn("first_key", F.get(C.row_keys(F.col("cells")), F.lit(0)))
    files = keys.groupBy("file_id").agg(D.first_keys().alias("first_column")).withColumn("header_row", F.lit(0))
    files = K.vertical_columns(files.withColumn("row_idx", F.lit(0)), lexicon())
    return files.select("file_id", "vertical_cells", "vertical_matches", "vertical_repeats", "vertical_score", "vertical_pivot")


@oracle("vertical_scores")
def _():
    c = Q.Ctes()
    Q.typed(c, Q.card_grid(c))
    Q.keyword_table(c, lexicon())
    c.add("starts", "SELECT DISTINCT file_id, 0 AS row_idx FROM card_grid")
    Q.vertical(c, "starts")
    return c.sql("SELECT file_id, n AS vertical_cells, hits AS vertical_matches, repeats AS vertical_repeats, "
                 "vertical_score, vertical_score >= 50 AND repeats = 0 AS vertical_pivot FROM v_files")


DETECTED = ["file_id", "header_row_index", "headers", "confidence", "keyword_confidence", "vertical_keyword_score",
            "is_pivoted", "state"]
DETECTED_SQL = ("SELECT file_id, header_row_index, array_to_string(names, '|') AS headers, confidence, keyword_confidence, "
                "coalesce(vertical_keyword_score, -1) AS vertical_keyword_score, is_pivoted, state FROM detected")


def _detect(name, spark_grid, sql_grid):
    @query(name)
    def _(spark, d):
        return comparable(D.detect_headers(spark_grid(spark, d), lexicon()).select(*DETECTED))

    @oracle(name)
    def _():
        c = Q.Ctes()
        Q.detected(c, sql_grid(c), lexicon())
        return c.sql(DETECTED_SQL)


_detect("detect_headers", statement_head, Q.statement_grid)
_detect("detect_cards", I.card_lines, Q.card_grid)
_detect("detect_events", event_head, Q.event_grid)
_detect("detect_documents", I.document_grid, Q.document_grid)


@query("confidence_states")
def _(spark, d):
    found = D.detect_headers(I.card_lines(spark, d), lexicon()).unionByName(statement_detected(spark, d))
    warned = found.withColumn("low", C.low_header_warning(F.col("confidence"))).withColumn(
        "visible", C.headers_visible(F.lit("mapping"), F.col("confidence"), F.col("is_pivoted"), F.col("headers")))
    return warned.groupBy("state", "low", "visible").agg(F.count(F.lit(1)).alias("n_files"))


@oracle("confidence_states")
def _():
    parts = []
    for grid in (Q.card_grid, Q.statement_grid):
        c = Q.Ctes()
        Q.detected(c, grid(c), lexicon())
        parts.append("(" + c.sql("SELECT state, confidence < 40 AS low, confidence >= 50 AND NOT is_pivoted AND len(names) > 0 AS visible FROM detected") + ")")
    return f"SELECT state, low, visible, count(*) AS n_files FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def choices(spark, d):
    return I.table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"), (F.col("c_custkey") % 6).alias("row_idx"))


@query("rescore_choice")
def _(spark, d):
    scores = D.score_choice(statement_head(spark, d), choices(spark, d), lexicon())
    return comparable(scores.select("file_id", "row_idx", "headers", "confidence", "keyword_confidence", "vertical_keyword_score", "is_pivoted"))


@oracle("rescore_choice")
def _():
    c = Q.Ctes()
    Q.structural(c, Q.statement_grid(c))
    Q.keyword_rows(c, lexicon())
    c.add("chosen", "SELECT 'c' || c_custkey AS file_id, c_custkey % 6 AS row_idx FROM customer")
    c.add("starts", "SELECT c.* FROM chosen c JOIN s_rows s ON s.file_id = c.file_id AND s.row_idx = c.row_idx")
    Q.vertical(c, "starts")
    return c.sql(f"""SELECT c.file_id, c.row_idx, array_to_string({Q.NAMES}, '|') AS headers, coalesce(s.score, -1) AS confidence,
      coalesce(k.keyword_score, -1) AS keyword_confidence,
      CASE WHEN s.score IS NULL THEN -1 WHEN k.keyword_score < 50 THEN v.vertical_score ELSE 0 END AS vertical_keyword_score,
      coalesce(k.keyword_score < 50 AND v.vertical_score >= 50 AND v.repeats = 0, false) AS is_pivoted
      FROM chosen c LEFT JOIN s_rows s ON s.file_id = c.file_id AND s.row_idx = c.row_idx
      LEFT JOIN k_rows k ON k.file_id = c.file_id AND k.row_idx = c.row_idx LEFT JOIN v_files v ON v.file_id = c.file_id""")


@query("score_breakdown")
def _(spark, d):
    explained = D.explain_choice(D.score_choice(event_head(spark, d), I.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_id"), (F.col("user_id") % 3).alias("row_idx")).distinct(),
        lexicon()))
    return explained.where("breakdown is not null").select("file_id", F.posexplode("breakdown").alias("part", "b")).select(
        "file_id", "part", "b.name", "b.score")


@oracle("score_breakdown")
def _():
    c = Q.Ctes()
    Q.structural(c, Q.event_grid(c))
    Q.keyword_rows(c, lexicon())
    c.add("chosen", "SELECT DISTINCT 'u' || user_id AS file_id, user_id % 3 AS row_idx FROM events")
    c.add("x", """SELECT s.file_id, list_filter([
        {'name': 'Base Average Score (' || filled || '/' || width || ' cols)', 'score': floor(base + 0.5)},
        CASE WHEN base > 0 AND numeric_cells::DOUBLE / filled >= 0.5 THEN {'name': 'Critical Penalty: Pure Data Row (0.0x)', 'score': -floor(base + 0.5)} END,
        CASE WHEN base > 0 AND numeric_cells > 0 AND numeric_cells::DOUBLE / filled < 0.5 THEN {'name': 'Critical Penalty: Mixed Numeric Data (0.5x)', 'score': -floor(base * 0.5 + 0.5)} END,
        CASE WHEN after_numeric > 0 AND NOT data_below THEN {'name': 'Critical Penalty: Orphan Header / No Data Below (0.0x)', 'score': -floor(after_numeric + 0.5)} END,
        {'name': '---', 'score': 0.0}, {'name': 'Total Structural %', 'score': s.score::DOUBLE}, {'name': '---', 'score': 0.0},
        {'name': 'Contiguous Keyword Matches (' || k.matches || '/' || k.block || ')', 'score': k.keyword_score::DOUBLE}],
        lambda p: p IS NOT NULL) AS parts
      FROM chosen c JOIN s_rows s ON s.file_id = c.file_id AND s.row_idx = c.row_idx
      JOIN k_rows k ON k.file_id = c.file_id AND k.row_idx = c.row_idx""")
    return c.sql("SELECT file_id, i - 1 AS part, parts[i].name AS name, parts[i].score::BIGINT AS score FROM "
                 "(SELECT *, unnest(generate_series(1, len(parts))) AS i FROM x)")


@query("contextual_scores")
def _(spark, d):
    return O.contextual_scores(event_grid(spark, d)).select("file_id", "row_idx", "plain_score", "pivot_score")


@oracle("contextual_scores")
def _():
    c = Q.Ctes()
    Q.contextual(c, Q.event_grid(c))
    return c.sql("SELECT file_id, row_idx, plain_score, pivot_score FROM o_rows")


@query("contextual_scores_unscaled")
def _(spark, d):
    return O.contextual_scores(statement_grid(spark, d), scaling=False).select("file_id", "row_idx", "plain_score", "pivot_score")


@oracle("contextual_scores_unscaled")
def _():
    c = Q.Ctes()
    Q.contextual(c, Q.statement_grid(c), scaling=False)
    return c.sql("SELECT file_id, row_idx, plain_score, pivot_score FROM o_rows")


@query("monotonic_rows")
def _(spark, d):
    return O.contextual_scores(event_grid(spark, d)).where("is_series").select("file_id", "row_idx")


@oracle("monotonic_rows")
def _():
    c = Q.Ctes()
    Q.contextual(c, Q.event_grid(c))
    return c.sql("SELECT file_id, row_idx FROM o_rows WHERE is_series")


@query("detect_contextual")
def _(spark, d):
    return O.detect_headers_contextual(event_grid(spark, d))


@oracle("detect_contextual")
def _():
    c = Q.Ctes()
    Q.contextual(c, Q.event_grid(c))
    for kind in ("plain", "pivot"):
        c.add(f"o_{kind}", f"""SELECT file_id, row_idx, cells, {kind}_score AS s FROM o_rows WHERE row_idx < last_row
          QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {kind}_score DESC, row_idx) = 1""")
    c.add("o_pick", """SELECT a.file_id, coalesce(a.s < 50 AND p.s >= 50 AND p.s > a.s, false) AS is_pivoted,
      CASE WHEN is_pivoted THEN p.row_idx ELSE a.row_idx END AS header_row_index,
      CASE WHEN is_pivoted THEN p.s ELSE a.s END AS score, CASE WHEN is_pivoted THEN p.cells ELSE a.cells END AS cells
      FROM o_plain a JOIN o_pivot p ON a.file_id = p.file_id""")
    return c.sql(f"""SELECT f.file_id, coalesce(header_row_index, -1) AS header_row_index, score,
      coalesce(is_pivoted, false) AS is_pivoted, coalesce(array_to_string({Q.NAMES}, '|'), '') AS headers
      FROM t_file f LEFT JOIN o_pick p ON f.file_id = p.file_id""")


def _ranked(name, keyword_first):
    @query(name)
    def _(spark, d):
        return O.detect_headers_ranked(statement_grid(spark, d), lexicon(), keyword_first)

    @oracle(name)
    def _():
        c = Q.Ctes()
        Q.contextual(c, Q.statement_grid(c))
        Q.keyword_table(c, lexicon())
        c.add("o_kw", """SELECT r.*, CASE WHEN filled = 0 THEN 0 ELSE floor((SELECT count(*) FROM t_cells x WHERE x.file_id = r.file_id
          AND x.row_idx = r.row_idx AND x.k IN (SELECT k FROM kw))::DOUBLE / filled * 100 + 0.5) END::BIGINT AS kws FROM o_rows r""")
        for kind, extra in (("plain", ""), ("pivot", "AND row_idx < 20")):
            order = f"kws DESC, {kind}_score DESC" if keyword_first else f"{kind}_score DESC, kws DESC"
            c.add(f"o_{kind}", f"""SELECT file_id, row_idx, cells, {kind}_score AS s, kws,
              {'kws' if keyword_first else kind + '_score'} AS lead FROM o_kw WHERE row_idx < last_row {extra}
              QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {order}, row_idx) = 1""")
        c.add("o_pick", """SELECT a.file_id, coalesce(a.lead < 50 AND p.lead >= 50 AND p.lead > a.lead, false) AS is_pivoted,
          CASE WHEN is_pivoted THEN p.row_idx ELSE a.row_idx END AS header_row_index,
          CASE WHEN is_pivoted THEN p.s - 100 ELSE a.s END AS score, CASE WHEN is_pivoted THEN p.kws ELSE a.kws END AS kws,
          CASE WHEN is_pivoted THEN p.cells ELSE a.cells END AS cells FROM o_plain a LEFT JOIN o_pivot p ON a.file_id = p.file_id""")
        return c.sql(f"""SELECT f.file_id, coalesce(header_row_index, -1) AS header_row_index,
          coalesce(array_to_string({Q.NAMES}, '|'), '') AS headers, coalesce(least(100, greatest(0, score)), 0) AS confidence,
          coalesce(kws, 0) AS keyword_confidence, coalesce(is_pivoted, false) AS is_pivoted
          FROM t_file f LEFT JOIN o_pick p ON f.file_id = p.file_id""")


_ranked("detect_keyword_first", True)
_ranked("detect_points_first", False)


@query("preview_rows")
def _(spark, d):
    grid = statement_head(spark, d)
    return D.preview_rows(grid, D.detect_headers(grid, lexicon())).select("file_id", "row_idx", "label", "cells")


@oracle("preview_rows")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    return c.sql(f"""SELECT g.file_id, g.row_idx, ['Header Row', 'Data Row 1', 'Data Row 2'][(g.row_idx - header_row_index) + 1] AS label,
      {joined('g.cells')} AS cells FROM t_sample g JOIN detected d ON g.file_id = d.file_id
      WHERE header_row_index >= 0 AND g.row_idx BETWEEN header_row_index AND header_row_index + 2""")


@query("page_rows")
def _(spark, d):
    return D.page_rows(I.document_grid(spark, d))


@oracle("page_rows")
def _():
    c = Q.Ctes()
    Q.document_grid(c)
    return c.sql(f"SELECT file_id, row_idx, row_idx // 15 AS page, row_idx % 15 AS slot, {joined('cells')} AS cells FROM document_grid")


@query("head_rows")
def _(spark, d):
    return statement_head(spark, d).select("file_id", "line_no", "row_idx")


@query("reindexed_rows")
def _(spark, d):
    return statement_grid(spark, d).select("file_id", "line_no", "row_idx")


@oracle("head_rows")
def _():
    c = Q.Ctes()
    Q.statement_grid(c)
    return c.sql("SELECT file_id, line_no, row_idx FROM statement_grid WHERE row_idx < 200")


@oracle("reindexed_rows")
def _():
    c = Q.Ctes()
    Q.statement_grid(c)
    return c.sql("SELECT file_id, line_no, row_idx FROM statement_grid")


@query("sheet_profile")
def _(spark, d):
    return D.sheet_profile(I.document_grid(spark, d)).select("file_id", "n_rows", F.transform(
        "first_rows", lambda r: F.array_join(r, ",", "~")).alias("first_rows"))


@oracle("sheet_profile")
def _():
    c = Q.Ctes()
    Q.document_grid(c)
    return c.sql("SELECT file_id, count(*) AS n_rows, array_to_string(list(array_to_string(cells, ',') ORDER BY row_idx) "
                 "FILTER (row_idx < 5), '|') AS first_rows FROM document_grid GROUP BY file_id")


@query("readability")
def _(spark, d):
    return I.chat_grid(spark, d).select("file_id", "row_idx", C.readability(F.col("cells")).alias("state"),
                                        F.array_join(F.transform("cells", C.fold_accents), ",").alias("folded"))


@oracle("readability")
def _():
    c = Q.Ctes()
    Q.chat_grid(c)
    return c.sql(f"""SELECT file_id, row_idx, CASE WHEN len(list_filter(cells, lambda x: coalesce({Q.trim('x')}, '') <> '')) = 0 THEN 'blocking'
      WHEN len(list_filter(cells, lambda x: regexp_matches(x, '[\\x{{FFFD}}\\x00-\\x08\\x0e-\\x1f\\x7f]'))) > 0 THEN 'recoverable'
      ELSE 'ok' END AS state, {folded_sql("array_to_string(cells, ',')")} AS folded FROM chat_grid""")


# --- header text ---

@query("header_tokens")
def _(spark, d):
    return distinct_sources(spark, d).select("source", X.words(F.col("source")).alias("words"),
                                             X.words(F.col("source"), camel=False).alias("plain_words"))


@oracle("header_tokens")
def _():
    c = Q.Ctes()
    Q.line_headers(c)
    c.add("src", "SELECT DISTINCT source FROM line_headers")
    return c.sql(f"SELECT source, array_to_string({Q.word_list('source', True)}, '|') AS words, "
                 f"array_to_string({Q.word_list('source', False)}, '|') AS plain_words FROM src")


@query("dictionary_splits")
def _(spark, d):
    return distinct_sources(spark, d).select("source", X.standard_tokens(F.col("source"), lexicon()).alias("tokens"))


@oracle("dictionary_splits")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    return c.sql("SELECT source, array_to_string(toks, '|') AS tokens FROM tokens")


def _stages(name, mode):
    @query(name)
    def _(spark, d):
        return M.tokenise(distinct_sources(spark, d), lexicon(), mode)

    @oracle(name)
    def _():
        c = Q.Ctes()
        (Q.deep_tokens if mode == "deep" else Q.standard_tokens)(c, Q.line_headers(c), lexicon())
        Q.lemma_tables(c)
        return c.sql("SELECT l.source, array_to_string(toks, '|') AS tokens, array_to_string(lems, '|') AS lemmas, "
                     "array_to_string(kept_toks, '|') AS kept FROM lemma l JOIN kept k ON l.source = k.source")


_stages("lemmas", "standard")
_stages("deep_tokens", "deep")


@query("deep_moves")
def _(spark, d):
    words = M.distinct_words(distinct_sources(spark, d), camel=False)
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("offset"))
    return M.computed_here(at, "m", X.deep_move(F.col("word"), F.col("offset"), lexicon())).where("m is not null").select(
        "word", "offset", "m.taken", "m.token")


@oracle("deep_moves")
def _():
    c = Q.Ctes()
    Q.lexicon_tables(c, lexicon())
    Q.placed_words(c, Q.line_headers(c), False)
    Q.deep_moves(c)
    return c.sql("SELECT word, i AS \"offset\", n AS taken, token FROM moves WHERE n IS NOT NULL")


@query("deep_moves_table")
def _(spark, d):
    """The same moves through the index of the vocabulary as a table."""
    inverse, signatures = _lexicon_frames(spark)
    known = lex.vocabulary_table(lexicon().stop_word_table(spark), lexicon().synonym_table(spark), signatures)
    moves = VO.word_moves(M.distinct_words(distinct_sources(spark, d), camel=False), known)
    return moves.select("word", "offset", "taken", "token")


SQL["deep_moves_table"] = SQL["deep_moves"]


def corpus_vocabulary(spark, d):
    """The lexicon's words, then all others of the documents by text."""
    words = I.table(spark, d, "documents").select(F.explode(F.expr("regexp_extract_all(text, '[a-z]+', 0)")).alias("word")).distinct()
    base = spark.createDataFrame(list(enumerate(lexicon().vocabulary)), "vocab_pos long, word string")
    others = range_rank(words.join(base, "word", "left_anti"), [], [F.asc("word")], "n")
    return base.select("word", "vocab_pos").unionByName(others.select("word", (F.col("n") + 1_000_000).alias("vocab_pos")))


@query("deep_tokens_corpus")
def _(spark, d):
    return M.deep_tokens(distinct_sources(spark, d), lexicon(), corpus_vocabulary(spark, d))


@oracle("deep_tokens_corpus")
def _():
    c = Q.Ctes()
    Q.corpus_vocabulary(c, lexicon())
    Q.segmented_tokens(c, Q.line_headers(c))
    return c.sql("SELECT source, array_to_string(toks, '|') AS tokens FROM tokens")


def kept_tokens(spark, d):
    return M.tokenise(distinct_sources(spark, d), lexicon()).select("source", F.explode("kept").alias("token"))


def _lexicon_frames(spark):
    inverse = lex.synonym_inverse(lexicon().synonym_table(spark))
    return inverse, lex.lemmatised_signatures(lexicon().signature_table(spark), inverse)


@query("token_weights")
def _(spark, d):
    inverse, signatures = _lexicon_frames(spark)
    used = kept_tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    weights = lex.token_weights(signatures)
    return used.join(weights, "token", "left").select("token", "uses", F.coalesce("n_signatures", F.lit(0)).alias("n_signatures"),
                                                      F.coalesce("weight", F.lit(lex.UNKNOWN_WEIGHT)).alias("weight"))


@oracle("token_weights")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c)
    return c.sql("SELECT token, count(*) AS uses, coalesce(any_value(n), 0) AS n_signatures, round(coalesce(1.0 / any_value(n), 0.2)::DOUBLE, 6) AS weight "
                 "FROM (SELECT unnest(kept_toks) AS token FROM kept) LEFT JOIN (SELECT word, count(DISTINCT target_id) AS n FROM sig "
                 "GROUP BY word) s ON s.word = token GROUP BY token")


@query("synonym_inverse")
def _(spark, d):
    words = M.distinct_words(distinct_sources(spark, d), camel=True)
    inverse, _ = _lexicon_frames(spark)
    return words.join(inverse.withColumnRenamed("synonym", "word"), "word")


@oracle("synonym_inverse")
def _():
    c = Q.Ctes()
    Q.lexicon_tables(c, lexicon())
    Q.placed_words(c, Q.line_headers(c), True)
    return c.sql("SELECT DISTINCT word, base AS base_token FROM placed JOIN syn ON phrase = word")


@query("vocabulary")
def _(spark, d):
    inverse, signatures = _lexicon_frames(spark)
    known = lex.vocabulary_table(lexicon().stop_word_table(spark), lexicon().synonym_table(spark), signatures)
    return comparable(M.distinct_words(distinct_sources(spark, d), camel=True).join(known, "word", "left"))


@oracle("vocabulary")
def _():
    c = Q.Ctes()
    Q.lexicon_tables(c, lexicon())
    Q.placed_words(c, Q.line_headers(c), True)
    return c.sql("SELECT DISTINCT p.word, coalesce(v.pos, -1) AS vocab_pos FROM placed p LEFT JOIN vocab v ON p.word = v.word")


@query("typo_variants")
def _(spark, d):
    return G.with_typo_sets(I.line_headers(spark, d).distinct())


@oracle("typo_variants")
def _():
    c = Q.Ctes()
    Q.line_headers(c)
    c.add("x", "SELECT DISTINCT * FROM line_headers")
    return c.sql("SELECT * FROM x UNION ALL SELECT file_id || ' (variant)', src_pos, translate(source, 'ao', 'eu') FROM x")


@query("unpivot_headers")
def _(spark, d):
    wide = I.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("File Name"), F.col("p_name").alias("Header 1"),
                                            F.col("p_brand").alias("Header 2"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("Header 3"))
    return G.unpivot_headers(wide)


@oracle("unpivot_headers")
def _():
    return """SELECT * FROM (SELECT CAST(p_partkey AS VARCHAR) AS file_id, 0::BIGINT AS src_pos, p_name AS source FROM part
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, p_brand FROM part
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, p_type FROM part WHERE p_size > 10) WHERE source <> ''"""


# --- matching ---

def scored_pairs(spark, d, mode="standard", best=None):
    headers = I.line_headers(spark, d)
    return M.pair_rows(headers, M.score_sources(headers, lexicon(), mode), lexicon(), best)


@query("pair_scores")
def _(spark, d):
    scored = M.score_sources(I.line_headers(spark, d), lexicon())
    return scored.select("source", F.explode("candidates").alias("c")).select("source", "c.sig_pos", "c.score")


@oracle("pair_scores")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c), Q.pair_scores(c)
    return c.sql("SELECT source, sig_pos, round(score, 6) AS score FROM scores")


@query("fuzzy_tokens")
def _(spark, d):
    tokens = kept_tokens(spark, d).select("token").distinct()
    weighted = F.get(X.weighted(F.array("token"), lexicon()), F.lit(0))
    rows = tokens.withColumn("w", weighted).select("token", "w", F.explode(X.signature_literal(lexicon())).alias("s"))
    return M.computed_here(rows, "o", X.token_outcome(F.col("w"), F.col("s"))).where("o.outcome = 'fuzzy'").select(
        "token", "s.sig_pos", "o.against", "o.similarity")


@oracle("fuzzy_tokens")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c), Q.pair_scores(c)
    return c.sql("SELECT DISTINCT word AS token, sig_pos, against, round(sim, 6) AS similarity FROM outcome WHERE outcome = 'fuzzy'")


@query("ambiguous_sources")
def _(spark, d):
    headers = I.line_headers(spark, d)
    scored = M.score_sources(headers, lexicon()).select("source", "candidates")
    found = M.salted_lookup(M.file_sources(headers), scored, "source", F.col("file_id"))
    return M.mark_ambiguous(found, THRESHOLD).where("ambiguous").select("file_id", "source", "top")


@oracle("ambiguous_sources")
def _():
    c = Q.Ctes()
    Q.mapping(c, Q.line_headers(c), lexicon(), "standard", THRESHOLD)
    return c.sql("SELECT DISTINCT file_id, source, round(top, 6) AS top FROM ambig WHERE ambiguous")


@query("pair_ranks")
def _(spark, d):
    return M.pair_ranks(scored_pairs(spark, d)).select("file_id", "source", "target_id", "score", "rank")


@oracle("pair_ranks")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c), Q.pair_scores(c), Q.pairs(c, "line_headers")
    return c.sql("SELECT file_id, source, target_id, round(score, 6) AS score, row_number() OVER (PARTITION BY file_id "
                 "ORDER BY score DESC, src_pos, sig_pos) AS rank FROM pairs")


@query("suggestions")
def _(spark, d):
    return M.suggest(scored_pairs(spark, d, best=3), 3).select("file_id", "source", "target_id", "score", "place")


@oracle("suggestions")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c), Q.pair_scores(c), Q.pairs(c, "line_headers")
    return c.sql("SELECT file_id, source, target_id, round(score, 6) AS score, row_number() OVER (PARTITION BY file_id, source "
                 "ORDER BY score DESC, sig_pos) AS place FROM pairs QUALIFY place <= 3")


def mapping_ctes(mode="standard"):
    c = Q.Ctes()
    Q.mapping(c, Q.line_headers(c), lexicon(), mode, THRESHOLD)
    return c


def _map(name, mode):
    @query(name)
    def _(spark, d):
        return line_mapping(spark, d, mode)

    @oracle(name)
    def _():
        return mapping_ctes(mode).sql("SELECT file_id, target_pos, target_id, coalesce(source, '') AS sources, "
                                      "round(confidence, 6) AS confidence FROM mapping")


_map("map_standard", "standard")
_map("map_deep", "deep")


@query("match_log")
def _(spark, d):
    headers = I.line_headers(spark, d)
    scored = M.score_sources(headers, lexicon())
    log = M.match_log(M.assign(headers, scored, lexicon(), THRESHOLD), scored, lexicon())
    return log.select("file_id", "target_id", "source", "tokens", "lemmas", "kept", "target_weight", "input_weight", "matched_weight",
                      F.transform("outcomes", lambda o: F.concat_ws(":", o["token"], o["outcome"], o["against"])).alias("outcomes"))


@oracle("match_log")
def _():
    c = mapping_ctes()
    c.add("sums", """SELECT source, sig_pos, sum(added ORDER BY tpos) AS a, sum(matched ORDER BY tpos) AS m,
      array_to_string(list(concat_ws(':', word, outcome, against) ORDER BY tpos), '|') AS outcomes FROM outcome GROUP BY ALL""")
    return c.sql("""SELECT k.file_id, t.target_id, k.source, array_to_string(l.toks, '|') AS tokens,
      array_to_string(l.lems, '|') AS lemmas, array_to_string(p.kept_toks, '|') AS kept, round(g.total::DOUBLE, 6) AS target_weight,
      round(s.a, 6) AS input_weight, round(s.m, 6) AS matched_weight, s.outcomes
      FROM taken k JOIN target t ON t.sig_pos = k.sig_pos JOIN lemma l ON l.source = k.source JOIN kept p ON p.source = k.source
      JOIN sig_total g ON g.sig_pos = k.sig_pos JOIN sums s ON s.source = k.source AND s.sig_pos = k.sig_pos""")


# --- alias search ---

def alias_ctes():
    c = Q.Ctes()
    c.add("alias(key_pos, target_id, alias_pos, alias)", "VALUES " + Q.values(
        [(i, key.replace(" ", "_"), j, a) for i, (key, phrases) in enumerate(lexicon().aliases.items()) for j, a in enumerate(phrases)]))
    c.add("src", "SELECT DISTINCT source FROM " + Q.line_headers(c))
    return c


def folded_sql(v):
    marked, plain = C.accents()
    return f"regexp_replace(translate({v}, '{marked}', '{plain}'), '\\p{{Mn}}', '', 'g')"


def cleanse_sql(v):
    return (f"regexp_replace(regexp_replace({folded_sql(f'lower({Q.trim(v)})')}, '[^a-z0-9_{C.WHITE_SPACE}]', '', 'g'), "
            f"'[{C.WHITE_SPACE}]+', '_', 'g')")


def exact_ctes():
    c = alias_ctes()
    c.add("alias_first", f"SELECT {cleanse_sql('alias')} AS cleansed, arg_min(target_id, key_pos) AS target_id FROM alias GROUP BY ALL")
    c.add("exact", f"SELECT source, target_id FROM src JOIN alias_first ON cleansed = {cleanse_sql('source')}")
    return c


def trigram_ctes(c, sources, aliases="alias"):
    def grams(v):
        return f"list_distinct(list_transform(generate_series(1, len({v}) + 2), lambda i: substr('  ' || {v} || '  ', i, 3)))"
    c.add("sg", f"SELECT source, {grams('z')} AS g FROM (SELECT source, {cleanse_sql('source')} AS z FROM {sources})")
    c.add("ag", f"SELECT key_pos, target_id, alias_pos, alias, {grams('z')} AS g FROM (SELECT *, {cleanse_sql('alias')} AS z FROM {aliases})")
    c.add("trigram", """SELECT source, target_id, alias, s AS similarity FROM (SELECT source, target_id, alias, key_pos, alias_pos,
        len(list_intersect(x.g, y.g)) AS both_n, both_n::DOUBLE / (len(x.g) + len(y.g) - both_n) AS s FROM sg x, ag y)
      WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, key_pos, alias_pos) = 1""")
    return c


@query("alias_exact")
def _(spark, d):
    return L.exact_matches(I.line_headers(spark, d), lexicon().alias_table(spark))


@oracle("alias_exact")
def _():
    return exact_ctes().sql("SELECT source, target_id FROM exact")


@query("trigram_best")
def _(spark, d):
    return L.trigram_matches(I.line_headers(spark, d), lexicon().alias_table(spark))


@oracle("trigram_best")
def _():
    return trigram_ctes(alias_ctes(), "src").sql("SELECT source, target_id, alias, round(similarity, 6) AS similarity FROM trigram")


SEARCH_TOKENS = "list_filter(list_transform(regexp_split_to_array(lower({v}), '\\s+'), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: t <> '')"


def bm25_ctes(c, sources, per_alias):
    if per_alias:
        return bm25_tables(c, sources, "SELECT target_id || '#' || alias_pos AS doc_id, target_id, {toks} AS toks FROM alias", "alias")
    return bm25_tables(c, sources, "SELECT target_id AS doc_id, target_id, {toks} AS toks FROM "
                       "(SELECT target_id, string_agg(alias, ' ' ORDER BY alias_pos) AS text FROM alias GROUP BY target_id)", "text")


def bm25_tables(c, sources, documents, text):
    toks = SEARCH_TOKENS
    c.add("docs", documents.format(toks=toks.format(v=text)))
    c.add("terms", "SELECT doc_id, target_id, len(toks) AS n, unnest(toks) AS token FROM docs")
    c.add("tf", "SELECT token, doc_id, target_id, n, count(*) AS tf FROM terms GROUP BY ALL")
    c.add("idx", """SELECT token, doc_id, target_id, ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1)
        / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / al)) AS w
      FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM tf), (SELECT count(*) AS nd, avg(len(toks)) AS al FROM docs)""")
    c.add("sw", f"SELECT source, i AS p, ws[i] AS token FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM "
                f"(SELECT source, {toks.format(v='source')} AS ws FROM {sources}))")
    c.add("bm", "SELECT source, doc_id, target_id, sum(w ORDER BY p) AS score FROM sw JOIN idx ON sw.token = idx.token GROUP BY ALL")
    return c


def _bm25(name, per_alias, k):
    @query(name)
    def _(spark, d):
        index = L.bm25_index(L.bm25_documents(lexicon().alias_table(spark), per_alias))
        return L.bm25_search(I.line_headers(spark, d), index, k).select("source", "doc_id", "target_id", F.round("score", 4).alias("score"))

    @oracle(name)
    def _():
        return bm25_ctes(alias_ctes(), "src", per_alias).sql(
            f"SELECT source, doc_id, target_id, round(score, 4) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= {k}")


_bm25("bm25_top", False, 3)
_bm25("bm25_top_alias", True, 3)


@query("bm25_documents_top")
def _(spark, d):
    """The five best documents for each benchmark text, over whole documents, through blocks."""
    docs = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("target_id"),
                                                 X.search_tokens(F.col("text")).alias("tokens"))
    asked = I.table(spark, d, "benchmark").select(F.col("text").alias("source"))
    return L.bm25_search_blocks(asked, L.bm25_blocks(L.bm25_index(docs)), 5).select("source", "doc_id", "target_id", F.round("score", 4).alias("score"))


@oracle("bm25_documents_top")
def _():
    c = Q.Ctes()
    bm25_tables(c, "(SELECT DISTINCT text AS source FROM benchmark)", "SELECT doc_id::VARCHAR AS doc_id, source AS target_id, {toks} AS toks FROM documents", "text")
    return c.sql("SELECT source, doc_id, target_id, round(score, 4) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 5")


@query("alias_match")
def _(spark, d):
    return L.alias_match(I.line_headers(spark, d), lexicon().alias_table(spark)).withColumn("bm25_score", F.round("bm25_score", 4))


@oracle("alias_match")
def _():
    c = exact_ctes()
    c.add("rest", "SELECT source FROM src WHERE source NOT IN (SELECT source FROM exact)")
    trigram_ctes(c, "rest")
    bm25_ctes(c, "rest", False)
    c.add("bm1", "SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1")
    return c.sql("""SELECT source, target_id, 'exact' AS method, 1.0::DOUBLE AS score, NULL AS bm25_target_id, NULL::DOUBLE AS bm25_score FROM exact
      UNION ALL SELECT r.source, CASE WHEN similarity >= 0.5 THEN t.target_id END, CASE WHEN similarity >= 0.5 THEN 'trigram' ELSE 'none' END,
      round(coalesce(similarity, 0.0), 6), b.target_id, round(b.score, 4) FROM rest r LEFT JOIN trigram t ON t.source = r.source
      LEFT JOIN bm1 b ON b.source = r.source""")


# --- review ---

@query("mapping_review")
def _(spark, d):
    return V.review(line_mapping(spark, d), lexicon()).withColumn("tier", C.confidence_tier(F.col("confidence")))


@oracle("mapping_review")
def _():
    return mapping_ctes().sql("""SELECT m.file_id, m.target_pos + 1 AS position, m.target_id, t.label, t.required = 1 AS required,
      coalesce(m.source, '') AS sources, round(m.confidence, 6) AS confidence,
      CASE WHEN m.source IS NULL THEN 'Unmapped' WHEN m.confidence >= 0.99 THEN 'Exact Match'
        WHEN m.confidence >= 0.4 THEN 'Lexical (' || floor(m.confidence * 100 + 0.5)::BIGINT || '%)' ELSE 'High' END AS badge,
      CASE WHEN m.confidence > 0.9 THEN 'high' WHEN m.confidence >= 0.7 THEN 'medium' ELSE 'unmapped' END AS tier
      FROM mapping m JOIN target t ON t.target_id = m.target_id""")


@query("mapping_stats")
def _(spark, d):
    return V.mapping_stats(line_mapping(spark, d))


@oracle("mapping_stats")
def _():
    return mapping_ctes().sql("SELECT file_id, count(source) AS mapped, 0::BIGINT AS merged, count(*) - count(source) AS unmapped, "
                              "count(*) AS total FROM mapping GROUP BY file_id")


@query("source_availability")
def _(spark, d):
    return comparable(V.source_availability(I.line_headers(spark, d), line_mapping(spark, d)))


@oracle("source_availability")
def _():
    return mapping_ctes().sql("""SELECT f.file_id, f.src_pos, f.source, m.target_id, coalesce(m.target_pos + 1, -1) AS position
      FROM fs f LEFT JOIN mapping m ON m.file_id = f.file_id AND m.source = f.source""")


@query("unmapped")
def _(spark, d):
    return V.unmapped_headers(I.line_headers(spark, d), line_mapping(spark, d))


@oracle("unmapped")
def _():
    return mapping_ctes().sql("""SELECT h.file_id, h.source, h.src_pos FROM line_headers h
      WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.file_id = h.file_id AND m.source = h.source)""")


@query("report_rows")
def _(spark, d):
    return V.report_rows(I.line_headers(spark, d), line_mapping(spark, d))


@oracle("report_rows")
def _():
    return mapping_ctes().sql("""SELECT file_id, source, target_id, round(confidence, 6) AS score, (floor(confidence * 1000 + 0.5)::BIGINT // 10) || '.' || (floor(confidence * 1000 + 0.5)::BIGINT % 10) || '%' AS percent,
      'mapped' AS status FROM mapping WHERE source IS NOT NULL UNION ALL SELECT h.file_id, h.source, NULL, NULL, NULL, 'unmapped' FROM line_headers h
      WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.file_id = h.file_id AND m.source = h.source)""")


@query("batch_report")
def _(spark, d):
    return V.batch_report(I.line_headers(spark, d), line_mapping(spark, d))


@oracle("batch_report")
def _():
    return mapping_ctes().sql("""SELECT file_id, sum(headers)::BIGINT AS headers, sum(mapped)::BIGINT AS mapped,
      round(sum(mapped)::DOUBLE / sum(headers), 4) AS share FROM (
        SELECT h.file_id, h.headers, m.mapped FROM (SELECT file_id, count(*) AS headers FROM line_headers GROUP BY file_id) h
        JOIN (SELECT file_id, count(source) AS mapped FROM mapping GROUP BY file_id) m ON h.file_id = m.file_id)
      GROUP BY ROLLUP (file_id)""")


def edit_events(headers):
    """Clicks derived from header rows: take a name away from its own target, give it to the next, now and then clear."""
    part = F.col("src_pos") % 10_000_000
    ids = X.strings(lexicon().target_ids)
    rows = headers.distinct().withColumn("part", part)
    own, following = F.get(ids, (F.col("part") % 26).cast("int")), F.get(ids, ((F.col("part") + 1) % 26).cast("int"))
    first = rows.where("part % 2 = 0").select("file_id", (F.col("src_pos") * 2).alias("seq"), F.when(
        F.col("part") % 38 == 0, "clear").otherwise("remove").alias("action"), own.alias("target_id"), "source")
    second = rows.where("part % 3 = 0").select("file_id", (F.col("src_pos") * 2 + 1).alias("seq"), F.lit("add").alias("action"),
                                               following.alias("target_id"), "source")
    return first.unionByName(second)


@query("apply_edits")
def _(spark, d):
    return V.apply_edits(line_mapping(spark, d), edit_events(I.line_headers(spark, d)), lexicon())


@oracle("apply_edits")
def _():
    c = mapping_ctes()
    ids = "[" + ", ".join(Q.q(t) for t in lexicon().target_ids) + "]"
    c.add("hd", "SELECT DISTINCT *, src_pos % 10000000 AS part FROM line_headers")
    c.add("ed", f"""SELECT file_id, seq, action, target_id, source, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS n FROM (
      SELECT file_id, src_pos * 2 AS seq, CASE WHEN part % 38 = 0 THEN 'clear' ELSE 'remove' END AS action,
        {ids}[(part % 26) + 1] AS target_id, source FROM hd WHERE part % 2 = 0
      UNION ALL SELECT file_id, src_pos * 2 + 1, 'add', {ids}[((part + 1) % 26) + 1], source FROM hd WHERE part % 3 = 0)""")
    c.add("ed_walk", """SELECT file_id, 0::BIGINT AS n, coalesce(list(target_id || chr(1) || source ORDER BY target_pos)
        FILTER (source IS NOT NULL), []) AS st FROM mapping GROUP BY file_id
      UNION ALL SELECT w.file_id, w.n + 1, CASE WHEN e.action = 'clear' THEN []
        WHEN e.action = 'remove' THEN list_filter(w.st, lambda x: x <> e.target_id || chr(1) || e.source)
        WHEN list_contains(list_transform(w.st, lambda x: split_part(x, chr(1), 2)), e.source) THEN w.st
        ELSE w.st || [e.target_id || chr(1) || e.source] END
      FROM ed_walk w JOIN ed e ON e.file_id = w.file_id AND e.n = w.n + 1""")
    c.add("ed_end", "SELECT * FROM ed_walk QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC) = 1")
    return c.sql("""SELECT m.file_id, m.target_pos, m.target_id, array_to_string(list_transform(list_filter(e.st,
        lambda x: split_part(x, chr(1), 1) = m.target_id), lambda x: split_part(x, chr(1), 2)), '|') AS sources,
      round(m.confidence, 6) AS confidence FROM mapping m JOIN ed_end e ON e.file_id = m.file_id""")


@query("collisions")
def _(spark, d):
    return V.collisions(scored_pairs(spark, d), THRESHOLD)


@oracle("collisions")
def _():
    c = Q.Ctes()
    Q.standard_tokens(c, Q.line_headers(c), lexicon())
    Q.lemma_tables(c), Q.pair_scores(c), Q.pairs(c, "line_headers")
    return c.sql(f"""SELECT file_id, target_id, count(*) AS n_sources FROM (SELECT * FROM pairs WHERE score >= {THRESHOLD} QUALIFY
      row_number() OVER (PARTITION BY file_id, source ORDER BY score DESC, sig_pos) = 1) GROUP BY ALL HAVING count(*) > 1""")


@query("missing_required")
def _(spark, d):
    return V.missing_required(line_mapping(spark, d), lexicon())


@oracle("missing_required")
def _():
    return mapping_ctes().sql("SELECT m.file_id, m.target_id FROM mapping m JOIN target t ON t.target_id = m.target_id "
                              "WHERE t.required = 1 AND m.source IS NULL")


@query("duplicate_headers")
def _(spark, d):
    return V.duplicate_headers(I.line_headers(spark, d))


@oracle("duplicate_headers")
def _():
    c = Q.Ctes()
    Q.line_headers(c)
    return c.sql("SELECT file_id, source, count(*) AS occurrences FROM line_headers GROUP BY ALL HAVING count(*) > 1")


SURE = 0.75


@query("map_fallback")
def _(spark, d):
    return P.map_with_fallback(I.line_headers(spark, d), lexicon(), ("standard", "deep"), THRESHOLD, SURE, ambiguous=True)


@oracle("map_fallback")
def _():
    c = mapping_ctes()
    c.add("first_pass", f"""SELECT m.*, m.source IS NOT NULL AND m.confidence >= {SURE} AND NOT coalesce(a.ambiguous, false) AS settled
      FROM mapping m LEFT JOIN (SELECT DISTINCT file_id, source, ambiguous FROM ambig) a ON a.file_id = m.file_id AND a.source = m.source""")
    c.add("open_files", """SELECT f.file_id FROM first_pass f JOIN target t ON t.target_id = f.target_id GROUP BY f.file_id
      HAVING count(*) FILTER ((t.required = 1 AND source IS NULL) OR (source IS NOT NULL AND NOT settled)) > 0""")
    c.add("todo", """SELECT h.* FROM line_headers h WHERE file_id IN (SELECT file_id FROM open_files) AND NOT EXISTS
      (SELECT 1 FROM first_pass f WHERE f.settled AND f.file_id = h.file_id AND f.source = h.source)""")
    free = "WHERE NOT EXISTS (SELECT 1 FROM first_pass p WHERE p.settled AND p.file_id = f.file_id AND p.target_id = t.target_id)"
    c.append_renamed(Q.mapping_parts("todo", lexicon(), "deep", THRESHOLD, free), "_b")
    back = "f.source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mapping_b x WHERE x.file_id = f.file_id AND x.source_b_ = f.source)"
    final = c.sql(f"""SELECT f.file_id, f.target_pos, f.target_id,
      coalesce(CASE WHEN settled THEN f.source WHEN b.source IS NOT NULL THEN b.source WHEN {back} THEN f.source END, '') AS sources,
      round(CASE WHEN settled THEN f.confidence WHEN b.source IS NOT NULL THEN b.confidence WHEN {back} THEN f.confidence ELSE 0 END, 6) AS confidence,
      CASE WHEN settled THEN 'standard' WHEN b.source IS NOT NULL THEN 'deep' WHEN {back} THEN 'standard' END AS matcher
      FROM first_pass f LEFT JOIN mapping_b b ON b.file_id = f.file_id AND b.target_id = f.target_id""")
    return final.replace("source_b_", "source")


# --- ledger ---

@query("admission")
def _(spark, d):
    return FL.admit(ledger(spark, d)).select("file_name", FL.file_kind(F.col("file_name")).alias("kind"),
                                             FL.icon_kind(F.col("file_name")).alias("icon"), "reject_reason")


@oracle("admission")
def _():
    return f"""WITH {LEDGER_SQL} SELECT file_name, CASE WHEN file_name LIKE '%.xlsx' OR file_name LIKE '%.xls' THEN 'workbook' ELSE 'text' END AS kind,
      CASE WHEN lower(file_name) LIKE '%.csv' THEN 'csv' ELSE 'sheet' END AS icon,
      CASE WHEN length > 10485760 THEN '''' || file_name || ''' exceeds the 10 MB limit.'
      WHEN NOT regexp_matches(lower(file_name), '\\.(csv|xls|xlsx)$') AND mime_type <> 'text/csv'
      THEN '''' || file_name || ''' is an invalid file type.' END AS reject_reason FROM ledger"""


def known_files(spark, d):
    return ledger(spark, d).join(I.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("new_files")
def _(spark, d):
    return FL.new_files(ledger(spark, d), known_files(spark, d)).select("file_name", "length")


@oracle("new_files")
def _():
    return f"WITH {LEDGER_SQL} SELECT file_name, length FROM ledger WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


@query("kept_files")
def _(spark, d):
    everything = FL.add_files(known_files(spark, d), ledger(spark, d))
    return FL.remove_files(everything, ledger(spark, d).where("doc_id % 4 = 1")).select("file_name", "length")


@oracle("kept_files")
def _():
    return f"WITH {LEDGER_SQL} SELECT file_name, length FROM ledger WHERE doc_id % 4 <> 1"


@query("size_text")
def _(spark, d):
    return ledger(spark, d).select("file_name", C.readable_size(F.col("length")).alias("size_text"))


@oracle("size_text")
def _():
    return f"""WITH {LEDGER_SQL}, x AS (SELECT file_name, length, CASE WHEN length < 1024 THEN 0 WHEN length < 1048576 THEN 1
      WHEN length < 1073741824 THEN 2 ELSE 3 END AS step FROM ledger)
      , y AS (SELECT *, [1, 1024, 1048576, 1073741824][step + 1] AS unit FROM x)
      , z AS (SELECT *, (length * 100 + unit // 2) // unit AS h FROM y)
      SELECT file_name, CASE WHEN length = 0 THEN '0 Bytes' ELSE (h // 100)::VARCHAR || CASE h % 100 WHEN 0 THEN ''
        ELSE '.' || rtrim(lpad((h % 100)::VARCHAR, 2, '0'), '0') END || ' ' || ['Bytes', 'KB', 'MB', 'GB'][step + 1] END AS size_text FROM z"""


@query("file_status")
def _(spark, d):
    files = I.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"), "c_custkey")
    return FL.file_status(files, statement_detected(spark, d).where("substring(file_id, -1, 1) <> '7'"),
                          files.where("c_custkey % 2 = 0"), files.where("c_custkey % 4 = 0"), files.where("c_custkey % 8 = 0"))


@oracle("file_status")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    return c.sql("""SELECT 'c' || c_custkey AS file_id, CASE WHEN d.file_id IS NULL THEN 'queued' WHEN len(names) = 0 THEN 'error'
      WHEN c_custkey % 8 = 0 THEN 'completed' WHEN c_custkey % 4 = 0 THEN 'mapping_confirm' WHEN c_custkey % 2 = 0 THEN 'mapping'
      ELSE 'confirming_header' END AS status FROM customer LEFT JOIN (SELECT * FROM detected WHERE right(file_id, 1) <> '7') d
      ON d.file_id = 'c' || c_custkey""")


# --- reuse and reshaping ---

def fingerprint_sql(names):
    return (f"sha256(array_to_string(list_transform({names}, lambda h: regexp_replace(lower(h), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), '|'))")


@query("fingerprint")
def _(spark, d):
    return P.with_fingerprint(statement_detected(spark, d)).select("file_id", "fingerprint")


@oracle("fingerprint")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    return c.sql(f"SELECT file_id, {fingerprint_sql('names')} AS fingerprint FROM detected")


def statement_profiles(detected):
    confirmed = detected.where("state = 'confident' and substring(file_id, -1, 1) in ('0', '1', '2')")
    mapped = P.map_headers(D.header_list(confirmed), lexicon(), THRESHOLD)
    return P.confirmed_profiles(mapped, confirmed, "2024-01-01 00:00:00")


def statement_mapping_ctes():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    c.add("sh", "SELECT file_id, i - 1 AS src_pos, names[i] AS source FROM (SELECT *, unnest(generate_series(1, len(names))) AS i FROM detected WHERE header_row_index >= 0)")
    Q.mapping(c, "sh", lexicon(), "standard", THRESHOLD)
    c.add("fp", f"SELECT *, {fingerprint_sql('names')} AS fingerprint FROM detected")
    c.add("saved", "SELECT DISTINCT fingerprint FROM fp WHERE state = 'confident' AND right(file_id, 1) IN ('0', '1', '2') "
                   "AND file_id IN (SELECT file_id FROM taken)")
    return c


@query("cache_hits")
def _(spark, d):
    detected = P.stored(statement_detected(spark, d), "detected")
    profiles = statement_profiles(detected)
    hits = P.cache_hits(detected, P.save_profiles(profiles, profiles))
    return hits.select("file_id", "fingerprint", F.col("slots").isNotNull().alias("hit"))


@oracle("cache_hits")
def _():
    return statement_mapping_ctes().sql("SELECT file_id, fingerprint, fingerprint IN (SELECT fingerprint FROM saved) AS hit FROM fp")


@query("reuse_or_map")
def _(spark, d):
    detected = P.stored(statement_detected(spark, d), "detected")
    return P.reuse_or_map(detected, statement_profiles(detected), lexicon(), THRESHOLD)


@oracle("reuse_or_map")
def _():
    return statement_mapping_ctes().sql("""SELECT m.file_id, m.target_pos, m.target_id, coalesce(m.source, '') AS sources,
      round(m.confidence, 6) AS confidence, f.fingerprint IN (SELECT fingerprint FROM saved) AS reused
      FROM mapping m JOIN fp f ON f.file_id = m.file_id""")


@query("masked_sample")
def _(spark, d):
    grid = statement_grid(spark, d)
    return R.masked_sample(grid, D.detect_headers(grid, lexicon()))


@oracle("masked_sample")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    mask = (f"CASE WHEN ({Q.cell_type('x')}) = 'number' AND contains(x, '.') THEN '999.99' "
            "ELSE regexp_replace(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 'user@example.com', 'g') END")
    return c.sql(f"""SELECT g.file_id, g.row_idx, {joined(f'list_transform(g.cells, lambda x: {mask})')} AS cells
      FROM statement_grid g JOIN detected d ON g.file_id = d.file_id WHERE header_row_index >= 0 AND g.row_idx > header_row_index
      AND g.row_idx <= header_row_index + 10""")


def statement_reshape(spark, d):
    detected = P.stored(statement_detected(spark, d), "detected").where("state = 'confident'")
    mapped = P.map_headers(D.header_list(detected), lexicon(), THRESHOLD)
    return statement_grid(spark, d), detected, mapped


RESHAPED = ["supplier_id", "supplier_name", "currency", "payment_method", "payment_terms", "transaction_count",
            "total_purchase_orders", "total_amount_invoices", "total_amount_payments_due"]


def reshape_ctes():
    c = statement_mapping_ctes()
    c.add("placed_at", """SELECT m.file_id, m.target_id, list_position(d.names, m.source) AS col, d.header_row_index FROM mapping m
      JOIN detected d ON d.file_id = m.file_id WHERE m.source IS NOT NULL AND d.state = 'confident'""")
    c.add("vals", f"""SELECT g.file_id, g.row_idx, a.target_id, nullif({Q.trim('g.cells[a.col]')}, '') AS v FROM statement_grid g
      JOIN placed_at a ON a.file_id = g.file_id WHERE g.row_idx > a.header_row_index""")
    c.add("wide", "SELECT g.file_id, g.row_idx, " + ", ".join(
        f"max(v) FILTER (target_id = '{t}') AS {t}" for t in lexicon().target_ids) +
        " FROM (SELECT g.file_id, g.row_idx FROM statement_grid g JOIN detected d ON d.file_id = g.file_id WHERE d.state = 'confident' "
        "AND g.row_idx > d.header_row_index) g LEFT JOIN vals v ON v.file_id = g.file_id AND v.row_idx = g.row_idx GROUP BY ALL")
    return c


def cast_sql(t):
    kind = next(x.data_type for x in lexicon().targets if x.target_id == t)
    whole = f"CASE WHEN regexp_matches({t}, '^[+-]?[0-9]+$') THEN try_cast({t} AS BIGINT) END"
    return {"integer": whole, "decimal": f"try_cast({t} AS DECIMAL(18,2))"}.get(kind, t)


def reject_list_sql():
    return ("list_filter([" + ", ".join(f"CASE WHEN {t.target_id} IS NOT NULL AND ({cast_sql(t.target_id)}) IS NULL THEN '{t.target_id}' END"
                                        for t in lexicon().targets if t.data_type in ("integer", "decimal")) + "], lambda x: x IS NOT NULL)")


@query("reshape")
def _(spark, d):
    grid, detected, mapped = statement_reshape(spark, d)
    return comparable(R.reshape(grid, detected, mapped, lexicon()).select(
        "file_id", "row_idx", *RESHAPED, "rejects", F.size("missing").alias("n_missing")))


@oracle("reshape")
def _():
    missing = " + ".join(f"CASE WHEN {t.target_id} IS NULL THEN 1 ELSE 0 END" for t in lexicon().targets if t.required)
    whole = ("transaction_count", "total_purchase_orders")
    cast = ", ".join(f"coalesce({cast_sql(t)}, -1) AS {t}" if t in whole else
                     f"({cast_sql(t)}){'::DOUBLE' if t.startswith('total_amount') else ''} AS {t}" for t in RESHAPED)
    return reshape_ctes().sql(f"SELECT file_id, row_idx, {cast}, array_to_string({reject_list_sql()}, '|') AS rejects, "
                              f"({missing})::BIGINT AS n_missing FROM wide")


@query("typed_rejects")
def _(spark, d):
    grid, detected, mapped = statement_reshape(spark, d)
    return R.rejected_values(R.source_values(grid, R.reshape_plan(detected, mapped, lexicon()), lexicon()), lexicon())


@oracle("typed_rejects")
def _():
    parts = [f"SELECT file_id, row_idx, '{t.target_id}' AS target_id, {t.target_id} AS value FROM wide WHERE {t.target_id} IS NOT NULL "
             f"AND ({cast_sql(t.target_id)}) IS NULL" for t in lexicon().targets if t.data_type in ("integer", "decimal")]
    return reshape_ctes().sql(" UNION ALL ".join(parts))


@query("merge_columns")
def _(spark, d):
    grid, detected, mapped = statement_reshape(spark, d)
    first = F.get("headers", F.lit(0))
    both = detected.select("file_id", F.lit("supplier_name").alias("target_id"), F.array(first, F.get("headers", F.lit(1))).alias("pair"))
    merged = mapped.join(both, ["file_id", "target_id"], "left").select(
        "file_id", "target_pos", "target_id", F.coalesce("pair", "sources").alias("sources"), "confidence")
    merges = both.select("file_id", "target_id", F.lit(" / ").alias("separator"))
    values = R.source_values(grid, R.reshape_plan(detected, merged, lexicon(), merges), lexicon())
    return values.select("file_id", "row_idx", "supplier_name")


@oracle("merge_columns")
def _():
    c = Q.Ctes()
    Q.detected(c, Q.statement_grid(c), lexicon())
    one, two = (f"nullif({Q.trim(f'cells[list_position(names, names[{i}])]')}, '')" for i in (1, 2))
    return c.sql(f"""SELECT g.file_id, g.row_idx, nullif(concat_ws(' / ', {one}, CASE WHEN len(names) > 1 THEN {two} END), '') AS supplier_name
      FROM statement_grid g JOIN detected d ON d.file_id = g.file_id WHERE d.state = 'confident' AND g.row_idx > d.header_row_index""")


@query("batches")
def _(spark, d):
    return tagged_batches(statement_grid(spark, d), 4).groupBy("file_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"))


@oracle("batches")
def _():
    c = Q.Ctes()
    Q.statement_grid(c)
    return c.sql("SELECT file_id, row_idx // 4 AS batch_no, count(*) AS n_rows, min(row_idx) AS first_row FROM statement_grid GROUP BY ALL")


# --- streams ---

@query("stream_detect")
def _(spark, d):
    schema = I.table(spark, d, "events").schema
    out = scratch_dir(spark, "arrivals")
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn(
        "file_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    A.run_arrivals(stream, out, f"{out}-checkpoint", lexicon(), to_grid=lambda batch: G.head_rows(I.event_lines(batch)),
                   available_now=True, typed_rows=False).awaitTermination()
    return comparable(A.committed(spark, out, "detected").select(*DETECTED))


SQL["stream_detect"] = lambda: SQL["detect_events"]()


@query("stream_status")
def _(spark, d):
    schema = I.table(spark, d, "orders").schema
    out = scratch_dir(spark, "status")
    stream = spark.readStream.schema(schema).parquet(f"{d}/order[s].parquet")
    history = stream.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id"),
                            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    A.run_latest_status(history, out, f"{out}-checkpoint", available_now=True).awaitTermination()
    return A.current_status(spark, out)


@oracle("stream_status")
def _():
    return ("SELECT 'c' || o_custkey AS file_id, arg_max(o_orderstatus, struct_pack(ts := o_orderdate, k := o_orderkey)) AS status "
            "FROM orders GROUP BY o_custkey")
