"""ANSI-style SQL for the same results, worked out a different way: one row per cell, windows and recursion.

``Ctes`` collects named subqueries in order. Functions add the subqueries of one operator on top of a named input.
"""

from __future__ import annotations

import re

from ..functions.cells import DATE_PATTERN, NUMBER_PATTERN, WHITE_SPACE
from ..functions.text import FUZZY_BAR, MIN_SLICE, TOKEN_GAP, VOCABULARY_GAP
from ..lexicon import UNKNOWN_WEIGHT, Lexicon
from .inputs import EVENT_STYLES, LABELS, STATEMENT_STYLES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def text(v):
        return q(v) if isinstance(v, str) else f"{v}::BIGINT" if isinstance(v, int) else f"{v!r}::DOUBLE"
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


# Read by recursive steps or several times over; without this DuckDB works them out anew each time.
STORED = {"cand", "moves", "tokens", "ed", "mapping", "taken", "detected", "s_rows", "pairs", "scores", "outcome", "sims", "bonus"}


class Ctes:
    def __init__(self):
        self.parts: list[str] = []
        self.names: set[str] = set()

    def add(self, name: str, body: str) -> "Ctes":
        if name.split("(")[0] not in self.names:
            self.names.add(name.split("(")[0])
            kept = "MATERIALIZED " if name.split("(")[0] in STORED else ""
            self.parts.append(f"{name} AS {kept}({body})")
        return self

    def append_renamed(self, other: "Ctes", ending: str) -> None:
        """Another set of subqueries, all their names with an ending so that both can stand together."""
        names = re.compile(r"\b(" + "|".join(sorted(map(re.escape, other.names), key=len, reverse=True)) + r")\b")
        for part in other.parts:
            pieces = part.split("'")  # every second piece is a literal
            self.parts.append("'".join(names.sub(rf"\1{ending}", x) if k % 2 == 0 else x for k, x in enumerate(pieces)))

    def sql(self, final: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + final


TRIM_CHARS = q(WHITE_SPACE)


def trim(v: str) -> str:
    return f"trim({v}, {TRIM_CHARS})"


def cell_type(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {trim(v)} = '' THEN 'empty' WHEN regexp_matches({trim(v)}, {q(NUMBER_PATTERN)}) "
            f"THEN 'number' WHEN regexp_matches({trim(v)}, {q(DATE_PATTERN)}) THEN 'date' ELSE 'string' END")


def money(v: str) -> str:
    return f"CAST(CAST({v} AS DECIMAL(18,2)) AS VARCHAR)"


def _style(styles, key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN [" + ", ".join(q(s) for s in style) + "]" for i, style in enumerate(styles) if style)
    return f"CASE {key} % {len(styles)} {cases} ELSE NULL END"


# --- inputs -------------------------------------------------------------------------------------------------------

def statement_lines(c: Ctes) -> str:
    c.add("statement_lines", f"""
      SELECT * FROM (
        SELECT 'c' || c_custkey AS file_id, 0::BIGINT AS line_no, ['Statement of ' || c_name] AS cells FROM customer
        UNION ALL SELECT 'c' || c_custkey, 1, ['Segment: ' || c_mktsegment] FROM customer
        UNION ALL SELECT 'c' || c_custkey, 3, {_style(STATEMENT_STYLES, 'c_custkey')} FROM customer
        UNION ALL SELECT 'c' || o_custkey, o_orderkey + 10, [CAST(o_orderkey AS VARCHAR),
          strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderstatus END,
          {money('o_totalprice')}, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END] FROM orders)
      WHERE cells IS NOT NULL""")
    return "statement_lines"


def numbered(c: Ctes, lines: str, out: str) -> str:
    # A running count, because DuckDB 2.0 loses the "- 1" of a row_number() when a limit on it is pushed down.
    c.add(out, f"SELECT file_id, line_no, cells, count(*) OVER (PARTITION BY file_id ORDER BY line_no "
               f"ROWS UNBOUNDED PRECEDING) - 1 AS row_idx FROM {lines}")
    return out


def statement_grid(c: Ctes) -> str:
    return numbered(c, statement_lines(c), "statement_grid")


def card_grid(c: Ctes) -> str:
    c.add("card_grid", f"""
      SELECT 'k' || c_custkey AS file_id, 0::BIGINT AS row_idx, ['Company Name', c_name, c_mktsegment] AS cells FROM customer
      UNION ALL SELECT 'k' || c_custkey, 1, ['Account ID', 'A-' || c_custkey, 'open'] FROM customer
      UNION ALL SELECT 'k' || c_custkey, 2, [CASE WHEN c_custkey % 3 = 0 THEN 'Company Name' ELSE 'Phone' END,
        't' || c_custkey, 'main'] FROM customer
      UNION ALL SELECT 'k' || c_custkey, 3, ['Country', 'N' || c_nationkey, 'home'] FROM customer
      UNION ALL SELECT 'k' || c_custkey, 4, ['Balance', {money('c_acctbal')}, 'USD'] FROM customer""")
    return "card_grid"


def event_grid(c: Ctes) -> str:
    c.add("event_lines", f"""
      SELECT DISTINCT 'u' || user_id AS file_id, 0::BIGINT AS line_no, {_style(EVENT_STYLES, 'user_id')} AS cells FROM events
      UNION ALL SELECT 'u' || user_id, event_id + 1, [strftime(ts, '%Y-%m-%d'), event_type, {money('value')},
        json_extract_string(props, '$.k')] FROM events""")
    return numbered(c, "event_lines", "event_grid")


def document_grid(c: Ctes) -> str:
    c.add("document_lines", "SELECT CAST(doc_id AS VARCHAR) AS file_id, "
          "list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents")
    c.add("document_grid", "SELECT file_id, (i - 1)::BIGINT AS row_idx, string_split(lines[i], ',') AS cells FROM "
          "(SELECT *, unnest(generate_series(1, len(lines))) AS i FROM document_lines)")
    return "document_grid"


def chat_grid(c: Ctes) -> str:
    c.add("chat_grid", "SELECT 'v' || conv_id AS file_id, turn::BIGINT AS row_idx, string_split(text, ',') AS cells "
                       "FROM conversations")
    return "chat_grid"


def line_headers(c: Ctes) -> str:
    labels = "[" + ", ".join(q(x) for x in LABELS) + "]"
    c.add("line_base", f"""
      SELECT 'o' || l_orderkey AS file_id, l_linenumber * 10000000::BIGINT + l_partkey AS src_pos, l_partkey AS part,
        {labels}[(l_partkey % {len(LABELS)}) + 1] AS label, (l_partkey // {len(LABELS)} + l_linenumber) % 8 AS style
      FROM lineitem""")
    c.add("line_headers", """
      SELECT file_id, src_pos, CASE style
        WHEN 0 THEN label WHEN 1 THEN replace(lower(label), ' ', '_') WHEN 2 THEN replace(label, ' ', '')
        WHEN 3 THEN lower(replace(label, ' ', ''))
        WHEN 4 THEN replace(replace(replace(label, 'Supplier', 'Vendor'), 'Amount', 'Value'), 'Number', 'Count')
        WHEN 5 THEN translate(lower(label), 'ao', 'eu') WHEN 6 THEN 'info ' || lower(label) || ' data'
        ELSE label || ' ' || part END AS source FROM line_base""")
    return "line_headers"


# --- detection ----------------------------------------------------------------------------------------------------

def keyword_table(c: Ctes, lexicon: Lexicon) -> None:
    c.add("kw(k)", "VALUES " + values([(k,) for k in lexicon.keywords]))


def typed(c: Ctes, grid: str, sample: bool = True) -> None:
    """``t_sample`` (all rows unless ``sample``), ``t_cells``, ``t_rows``, ``t_file``."""
    c.add("t_sample", f"SELECT file_id, row_idx, cells FROM {grid}" + (" WHERE row_idx < 200" if sample else ""))
    c.add("t_cells", f"""
      SELECT *, {cell_type('value')} AS t, nullif(lower({trim('value')}), '') AS k FROM (
        SELECT file_id, row_idx, i - 1 AS col_idx, cells[i] AS value FROM
          (SELECT *, unnest(generate_series(1, len(cells))) AS i FROM t_sample))""")
    c.add("t_rows", """
      SELECT s.file_id, s.row_idx, s.cells, count(t) FILTER (t <> 'empty') AS filled,
        count(t) FILTER (t IN ('number', 'date')) AS numeric_cells, count(t) FILTER (t = 'string') AS texts_all
      FROM t_sample s LEFT JOIN t_cells x ON s.file_id = x.file_id AND s.row_idx = x.row_idx GROUP BY ALL""")
    c.add("t_file", "SELECT file_id, greatest(max(filled), 1) AS width, max(row_idx) AS last_row FROM t_rows GROUP BY file_id")


def structural(c: Ctes, grid: str, sample: bool = True) -> None:
    """``s_rows``: structural counts and score of every row."""
    typed(c, grid, sample)
    c.add("s_cells", """
      SELECT file_id, row_idx, col_idx, t, k, count(*) OVER (PARTITION BY file_id, row_idx, k) AS same,
        first_value(nullif(t, 'empty') IGNORE NULLS) OVER (PARTITION BY file_id, col_idx ORDER BY row_idx
          RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS below FROM t_cells""")
    c.add("s_below", """
      SELECT file_id, row_idx, coalesce(max(filled) OVER (PARTITION BY file_id ORDER BY row_idx
        ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) > 0 AS data_below FROM t_rows""")
    c.add("s_counts", """
      SELECT r.file_id, r.row_idx, count(*) FILTER (t <> 'empty') AS present, count(*) FILTER (t = 'string') AS texts,
        count(*) FILTER (t = 'string' AND same = 1) AS unique_texts,
        count(*) FILTER (t = 'string' AND below IN ('number', 'date')) AS boundaries,
        count(*) FILTER (t = 'string' AND below = 'string') AS consistent
      FROM s_cells r JOIN t_file f ON r.file_id = f.file_id WHERE col_idx < width GROUP BY ALL""")
    c.add("s_base", """
      SELECT r.file_id, r.row_idx, r.cells, r.filled, r.numeric_cells, f.width, f.last_row, b.data_below,
        coalesce(present, 0) AS present, coalesce(texts, 0) AS texts, coalesce(unique_texts, 0) AS unique_texts,
        coalesce(boundaries, 0) AS boundaries, coalesce(consistent, 0) AS consistent,
        CASE WHEN filled = 0 THEN 0.0::DOUBLE ELSE (20 * present + 10 * texts + 10 * unique_texts + 60 * boundaries
          + 40 * consistent)::DOUBLE / width END AS base
      FROM t_rows r JOIN t_file f ON r.file_id = f.file_id
      JOIN s_below b ON b.file_id = r.file_id AND b.row_idx = r.row_idx
      LEFT JOIN s_counts x ON x.file_id = r.file_id AND x.row_idx = r.row_idx""")
    c.add("s_rows", """
      SELECT *, least(100, floor(CASE WHEN data_below THEN after_numeric ELSE 0 END + 0.5))::BIGINT AS score FROM (
        SELECT *, CASE WHEN filled > 0 AND numeric_cells::DOUBLE / filled >= 0.5 THEN 0.0::DOUBLE
          WHEN numeric_cells > 0 THEN base * 0.5 ELSE base END AS after_numeric FROM s_base)""")


def keyword_rows(c: Ctes, lexicon: Lexicon) -> None:
    """``k_rows``: leading block and its keyword ratio for every typed row."""
    keyword_table(c, lexicon)
    c.add("k_gap", "SELECT file_id, row_idx, min(col_idx) FILTER (t = 'empty') AS gap, count(*) AS n FROM t_cells GROUP BY ALL")
    c.add("k_rows", """
      SELECT r.file_id, r.row_idx, coalesce(any_value(gap), any_value(n), 0) AS block,
        count(*) FILTER (x.col_idx < coalesce(gap, n) AND x.k IN (SELECT k FROM kw)) AS matches,
        CASE WHEN block = 0 THEN 0 ELSE floor(matches::DOUBLE / block * 100 + 0.5) END::BIGINT AS keyword_score
      FROM t_rows r LEFT JOIN t_cells x ON r.file_id = x.file_id AND r.row_idx = x.row_idx
      LEFT JOIN k_gap g ON g.file_id = r.file_id AND g.row_idx = r.row_idx GROUP BY r.file_id, r.row_idx""")


def vertical(c: Ctes, starts: str) -> None:
    """``v_files``: first-column block from each file's start row (``starts``: file_id, row_idx)."""
    c.add("v_cells", f"""
      SELECT s.file_id, s.row_idx AS start, r.row_idx, coalesce(x.t, 'empty') AS t, x.k FROM {starts} s
      JOIN t_rows r ON r.file_id = s.file_id AND r.row_idx >= s.row_idx AND r.row_idx < s.row_idx + 200
      LEFT JOIN t_cells x ON x.file_id = r.file_id AND x.row_idx = r.row_idx AND x.col_idx = 0""")
    c.add("v_stop", "SELECT file_id, min(row_idx) FILTER (t = 'empty') AS stop FROM v_cells GROUP BY file_id")
    c.add("v_counts", """
      SELECT v.file_id, count(*) AS n, count(*) FILTER (k IN (SELECT k FROM kw)) AS hits, count(DISTINCT k) AS kinds
      FROM v_cells v JOIN v_stop s ON v.file_id = s.file_id WHERE stop IS NULL OR row_idx < stop GROUP BY v.file_id""")
    c.add("v_files", f"""
      SELECT s.file_id, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, coalesce(n - kinds, 0) AS repeats,
        CASE WHEN n IS NULL THEN 0 ELSE floor(hits::DOUBLE / n * 100 + 0.5) END::BIGINT AS vertical_score
      FROM {starts} s LEFT JOIN v_counts c ON s.file_id = c.file_id""")


NAMES = (f"list_transform(cells, lambda x, i: CASE WHEN x IS NULL OR {trim('x')} = '' THEN 'Column_' || i "
         f"ELSE {trim('x')} END)")


def best(c: Ctes) -> None:
    c.add("b_rows", """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, row_idx) AS place
        FROM s_rows WHERE row_idx < last_row) WHERE place = 1""")


def detected(c: Ctes, grid: str, lexicon: Lexicon) -> str:
    """``detected``: file_id, header_row_index, names, confidence, keyword_confidence, vertical, is_pivoted, state."""
    structural(c, grid)
    keyword_rows(c, lexicon)
    best(c)
    vertical(c, "b_rows")
    c.add("d_files", """
      SELECT f.file_id, b.row_idx, b.cells, b.score, k.keyword_score, k.block, k.matches, v.vertical_score, v.repeats,
        coalesce(len(b.cells) > 0, false) AS usable
      FROM t_file f LEFT JOIN b_rows b ON f.file_id = b.file_id
      LEFT JOIN k_rows k ON k.file_id = b.file_id AND k.row_idx = b.row_idx LEFT JOIN v_files v ON v.file_id = b.file_id""")
    c.add("detected", f"""
      SELECT *, CASE WHEN is_pivoted THEN 'pivoted' WHEN confidence >= 50 THEN 'confident' ELSE 'unpredictable' END AS state
      FROM (SELECT file_id, CASE WHEN usable THEN row_idx ELSE -1 END AS header_row_index,
        CASE WHEN usable THEN {NAMES} ELSE [] END AS names, CASE WHEN usable THEN score ELSE 0 END AS confidence,
        CASE WHEN usable THEN keyword_score ELSE 0 END AS keyword_confidence,
        CASE WHEN usable AND score >= 50 AND keyword_score < 50 THEN vertical_score END AS vertical_keyword_score,
        coalesce(usable AND score >= 50 AND keyword_score < 50 AND vertical_score >= 50 AND repeats = 0, false) AS is_pivoted
        FROM d_files)""")
    return "detected"


# --- older detectors ----------------------------------------------------------------------------------------------

def contextual(c: Ctes, grid: str, scaling: bool = True) -> None:
    """``o_rows``: plain and pivot-aware points of every row."""
    typed(c, grid, sample=False)
    date = f"""CASE WHEN regexp_matches({trim('value')}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}$') THEN
        try_cast(replace({trim('value')}, '/', '-') AS DATE)
      WHEN regexp_matches({trim('value')}, '^[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}}$') THEN
        try_cast(regexp_replace({trim('value')}, '^([0-9]+)[-/]([0-9]+)[-/]([0-9]+)$', '\\3-\\1-\\2') AS DATE)
      WHEN regexp_matches({trim('value')}, '^[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2}}$') THEN
        try_cast(CASE WHEN right({trim('value')}, 2) >= '50' THEN '19' ELSE '20' END ||
          regexp_replace({trim('value')}, '^([0-9]+)[-/]([0-9]+)[-/]([0-9]+)$', '\\3-\\1-\\2') AS DATE) END"""
    c.add("o_values", f"""
      SELECT file_id, row_idx, col_idx, t, v, lag(v) OVER (PARTITION BY file_id, row_idx ORDER BY col_idx) AS before FROM (
        SELECT *, CASE WHEN t = 'number' THEN try_cast({trim('value')} AS DOUBLE)
          WHEN t = 'date' THEN epoch_ms({date}::TIMESTAMP)::DOUBLE END AS v FROM t_cells) WHERE v IS NOT NULL""")
    c.add("o_series", """
      SELECT x.file_id, x.row_idx, count(*) >= 3 AND (bool_and(v > before) OR bool_and(v < before))
        AND (bool_or(t = 'date') OR bool_and(abs(v - before) = 1) OR bool_and(v = floor(v) AND v BETWEEN 1900 AND 2100)
          OR bool_and(v = floor(v) AND v BETWEEN 1 AND 12)) AS is_series
      FROM o_values x GROUP BY ALL""")
    frame = "PARTITION BY file_id, col_idx ORDER BY row_idx RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING"
    one = "PARTITION BY file_id, col_idx ORDER BY row_idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING"
    c.add("o_cells", f"""
      SELECT *, count(*) OVER (PARTITION BY file_id, row_idx, k) AS same,
        count(*) FILTER (t IN ('number', 'date')) OVER ({frame}) AS typed,
        count(*) FILTER (t = 'string') OVER ({frame}) AS text, count(*) OVER ({frame}) AS present,
        coalesce(first_value(t) OVER ({one}) = 'string', false) AS text_first FROM t_cells""")
    c.add("o_sums", """
      SELECT file_id, row_idx, count(*) FILTER (t = 'string' AND typed > text AND NOT text_first) AS strong,
        count(*) FILTER (t = 'string' AND typed + text > 0) AS touched,
        count(*) FILTER (t IN ('number', 'date') AND present > 0 AND typed::DOUBLE / present >= 0.6 AND same = 1) AS series_cells,
        count(k) - count(DISTINCT k) AS duplicates FROM o_cells GROUP BY ALL""")
    c.add("o_next", """
      SELECT file_id, row_idx, count(*) OVER w AS following, coalesce(max(filled) OVER w, 0) > 0 AS data_below FROM t_rows
      WINDOW w AS (PARTITION BY file_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
    scale = "CASE WHEN following < 3 THEN 0.6::DOUBLE ELSE 1 END" if scaling else "1.0::DOUBLE"

    def total(series: str) -> str:
        return f"""(2 * filled + strong * floor(15 * scale + 0.5) + (touched - strong) * floor(5 * scale + 0.5)
          + CASE WHEN {series} THEN series_cells * floor(10 * scale + 0.5) + 25 ELSE 0 END
          + CASE WHEN NOT {series} AND filled > 0 AND numeric_cells::DOUBLE / nullif(filled, 0) > 0.5 THEN -50 ELSE 0 END
          + CASE WHEN NOT {series} AND numeric_cells > 0 THEN -20 ELSE 0 END
          + CASE WHEN filled > 0 AND texts_all = filled THEN 10 ELSE 0 END
          + CASE WHEN duplicates > 0 THEN -5 * duplicates WHEN filled > 1 THEN 5 ELSE 0 END
          + CASE WHEN filled > 0 AND NOT data_below THEN -50 ELSE 0 END)::BIGINT"""

    c.add("o_all", f"""
      SELECT r.*, f.last_row, coalesce(strong, 0) AS strong, coalesce(touched, 0) AS touched,
        coalesce(series_cells, 0) AS series_cells, coalesce(duplicates, 0) AS duplicates, following, data_below,
        coalesce(is_series, false) AS is_series, {scale} AS scale
      FROM t_rows r JOIN t_file f ON r.file_id = f.file_id JOIN o_next n ON n.file_id = r.file_id AND n.row_idx = r.row_idx
      LEFT JOIN o_sums s ON s.file_id = r.file_id AND s.row_idx = r.row_idx
      LEFT JOIN o_series p ON p.file_id = r.file_id AND p.row_idx = r.row_idx""")
    c.add("o_rows", f"SELECT *, {total('false')} AS plain_score, {total('is_series')} AS pivot_score FROM o_all")


# --- matching -----------------------------------------------------------------------------------------------------

def lexicon_tables(c: Ctes, lexicon: Lexicon) -> None:
    c.add("vocab(word, pos)", "VALUES " + values([(w, i) for i, w in enumerate(lexicon.vocabulary)]))
    c.add("stop(word)", "VALUES " + values([(w,) for w in lexicon.stop_words]))
    c.add("syn(phrase, base)", "VALUES " + values([(p, " ".join(b)) for p, b in lexicon.synonyms.items()]))
    rows = [(i, t, j, w, lexicon.weights[w]) for i, (t, ws) in enumerate(lexicon.signatures.items()) for j, w in enumerate(ws)]
    c.add("sig(sig_pos, target_id, tok_pos, word, weight)", "VALUES " + values(rows))
    c.add("weight(word, weight)", "VALUES " + values(list(lexicon.weights.items())))
    totals = []
    for i, ws in enumerate(lexicon.signatures.values()):
        total = 0.0
        for w in ws:
            total += lexicon.weights[w]
        totals.append((i, total))
    c.add("sig_total(sig_pos, total)", "VALUES " + values(totals))
    order = {t: i for i, t in enumerate(lexicon.target_ids)}
    labels = {t.target_id: t.label.lower() for t in lexicon.targets}
    req = {t.target_id: t.required for t in lexicon.targets}
    c.add("target(sig_pos, target_id, target_pos, counts, amounts, label, required)", "VALUES " + values([
        (i, t, order[t], int(any(w in labels[t] for w in ("number", "count", "transaction"))),
         int(any(w in labels[t] for w in ("amount", "value"))), dict((x.target_id, x.label) for x in lexicon.targets)[t],
         int(req[t])) for i, t in enumerate(lexicon.signatures)]))


def word_list(text: str, camel: bool) -> str:
    spaced = f"regexp_replace({text}, '[_-]', ' ', 'g')"
    if camel:
        spaced = f"regexp_replace({spaced}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split(regexp_replace(lower({spaced}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


SIMILARITY = "CASE WHEN greatest(len({a}), len({b})) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(len({a}), len({b})) END"


def placed_words(c: Ctes, headers: str, camel: bool) -> None:
    c.add("src", f"SELECT DISTINCT source FROM {headers}")
    c.add("src_words", f"SELECT source, {word_list('source', camel)} AS ws FROM src")
    c.add("placed", "SELECT source, i AS pos, ws[i] AS word FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM src_words)")


def standard_tokens(c: Ctes, headers: str, lexicon: Lexicon) -> None:
    """``tokens``: source, toks."""
    lexicon_tables(c, lexicon)
    placed_words(c, headers, True)
    c.add("cuts", """
      SELECT word, min(i) AS cut FROM (SELECT word, unnest(generate_series(1, len(word) - 1)) AS i FROM
        (SELECT DISTINCT word FROM placed WHERE word NOT IN (SELECT word FROM vocab)))
      WHERE left(word, i) IN (SELECT word FROM vocab) AND substr(word, i + 1) IN (SELECT word FROM vocab) GROUP BY word""")
    c.add("tokens", """
      SELECT s.source, coalesce(t.toks, []) AS toks FROM src s LEFT JOIN (
        SELECT source, flatten(list(CASE WHEN cut IS NULL THEN [p.word] ELSE [left(p.word, cut), substr(p.word, cut + 1)] END
          ORDER BY pos)) AS toks FROM placed p LEFT JOIN cuts c ON p.word = c.word GROUP BY source) t ON s.source = t.source""")


def deep_moves(c: Ctes) -> None:
    """``moves``: the segmenter's choice at every offset of every distinct word of ``placed``."""
    c.add("dw", "SELECT DISTINCT word FROM placed")
    c.add("slices", f"""
      SELECT word, i, n, substr(word, i + 1, n) AS piece FROM (SELECT word, i, unnest(generate_series({MIN_SLICE},
        least(len(word) - i, (SELECT max(len(word)) FROM vocab) + {VOCABULARY_GAP}))) AS n FROM
        (SELECT word, unnest(generate_series(0, len(word) - 1)) AS i FROM dw))""")
    c.add("exact_moves", "SELECT word, i, max(n) AS n FROM slices WHERE piece IN (SELECT word FROM vocab) GROUP BY ALL")
    c.add("piece_best", f"""
      SELECT piece, v.word AS vw, v.pos, {SIMILARITY.format(a='piece', b='v.word')} AS s
      FROM (SELECT DISTINCT piece FROM slices) p JOIN vocab v ON abs(len(p.piece) - len(v.word)) <= {VOCABULARY_GAP}
      WHERE s >= {FUZZY_BAR}
      QUALIFY row_number() OVER (PARTITION BY piece ORDER BY s DESC, v.pos) = 1""")
    c.add("fuzzy_moves", """
      SELECT word, i, n, vw FROM slices x JOIN piece_best b ON x.piece = b.piece
      QUALIFY row_number() OVER (PARTITION BY word, i ORDER BY s DESC, n DESC, b.pos) = 1""")
    c.add("moves", """
      SELECT w.word, w.i, CASE WHEN e.n IS NOT NULL THEN e.n ELSE f.n END AS n,
        CASE WHEN e.n IS NOT NULL THEN substr(w.word, w.i + 1, e.n) ELSE f.vw END AS token
      FROM (SELECT word, unnest(generate_series(0, len(word) - 1)) AS i FROM dw) w
      LEFT JOIN exact_moves e ON e.word = w.word AND e.i = w.i LEFT JOIN fuzzy_moves f ON f.word = w.word AND f.i = w.i""")


def deep_tokens(c: Ctes, headers: str, lexicon: Lexicon) -> None:
    """``tokens`` by walking the moves."""
    lexicon_tables(c, lexicon)
    segmented_tokens(c, headers)


def corpus_vocabulary(c: Ctes, lexicon: Lexicon) -> None:
    """``vocab``: the lexicon's words, then all others of the documents by text."""
    c.add("base_words(word, pos)", "VALUES " + values([(w, i) for i, w in enumerate(lexicon.vocabulary)]))
    c.add("doc_words", "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents")
    c.add("vocab", """SELECT word, pos FROM base_words UNION ALL SELECT word, 1000000 + row_number() OVER (ORDER BY word)
      FROM doc_words WHERE word NOT IN (SELECT word FROM base_words)""")


def segmented_tokens(c: Ctes, headers: str) -> None:
    """``tokens`` by walking the moves of ``vocab``."""
    placed_words(c, headers, False)
    deep_moves(c)
    c.add("seg_walk", """
      SELECT word, 0 AS i, '' AS unk, []::VARCHAR[] AS toks FROM dw
      UNION ALL
      SELECT w.word, CASE WHEN m.n IS NULL THEN w.i + 1 ELSE w.i + m.n END,
        CASE WHEN m.n IS NULL THEN w.unk || substr(w.word, w.i + 1, 1) ELSE '' END,
        CASE WHEN m.n IS NULL THEN w.toks WHEN w.unk = '' THEN w.toks || [m.token] ELSE w.toks || [w.unk] || [m.token] END
      FROM seg_walk w JOIN moves m ON m.word = w.word AND m.i = w.i""")
    c.add("segments", "SELECT word, CASE WHEN unk = '' THEN toks ELSE toks || [unk] END AS segs FROM seg_walk WHERE i = len(word)")
    c.add("tokens", """
      SELECT s.source, coalesce(t.toks, []) AS toks FROM src s LEFT JOIN (
        SELECT source, flatten(list(segs ORDER BY pos)) AS toks FROM placed p JOIN segments g ON p.word = g.word
        GROUP BY source) t ON s.source = t.source""")


def lemma_tables(c: Ctes) -> None:
    """``lemma`` (source, toks, lems) and ``kept`` (source, kept)."""
    c.add("lem_walk", """
      SELECT source, toks, 1 AS i, []::VARCHAR[] AS lems FROM tokens
      UNION ALL
      SELECT l.source, l.toks, l.i + CASE WHEN s3.base IS NOT NULL THEN 3 WHEN s2.base IS NOT NULL THEN 2 ELSE 1 END,
        l.lems || CASE WHEN coalesce(s3.base, s2.base, s1.base) IS NULL THEN [l.toks[l.i]]
          ELSE string_split(coalesce(s3.base, s2.base, s1.base), ' ') END
      FROM lem_walk l
      LEFT JOIN syn s3 ON s3.phrase = l.toks[l.i] || ' ' || l.toks[l.i + 1] || ' ' || l.toks[l.i + 2]
      LEFT JOIN syn s2 ON s2.phrase = l.toks[l.i] || ' ' || l.toks[l.i + 1]
      LEFT JOIN syn s1 ON s1.phrase = l.toks[l.i] WHERE l.i <= len(l.toks)""")
    c.add("lemma", "SELECT source, toks, lems FROM lem_walk WHERE i = len(toks) + 1")
    c.add("kept", "SELECT source, list_filter(lems, lambda t: NOT list_contains(words, t)) AS kept_toks FROM lemma, "
                  "(SELECT list(word) AS words FROM stop)")


def pair_scores(c: Ctes) -> None:
    """``outcome`` per (source, token, signature) and ``scores`` (source, sig_pos, score) above 0."""
    c.add("kept_words", "SELECT source, i AS tpos, kept_toks[i] AS word FROM (SELECT *, unnest(generate_series(1, len(kept_toks))) AS i FROM kept)")
    c.add("sims", f"""
      SELECT w.word, s.sig_pos, bool_or(w.word = s.word) AS exact,
        max(CASE WHEN abs(len(w.word) - len(s.word)) <= {TOKEN_GAP} THEN {SIMILARITY.format(a='w.word', b='s.word')} ELSE 0 END) AS sim,
        arg_max(s.weight, struct_pack(a := CASE WHEN abs(len(w.word) - len(s.word)) <= {TOKEN_GAP}
          THEN {SIMILARITY.format(a='w.word', b='s.word')} ELSE 0 END, b := -s.tok_pos)) AS sw,
        arg_max(s.word, struct_pack(a := CASE WHEN abs(len(w.word) - len(s.word)) <= {TOKEN_GAP}
          THEN {SIMILARITY.format(a='w.word', b='s.word')} ELSE 0 END, b := -s.tok_pos)) AS against
      FROM (SELECT DISTINCT word FROM kept_words) w, sig s GROUP BY ALL""")
    c.add("outcome", f"""
      SELECT k.source, k.tpos, k.word, s.sig_pos, CASE WHEN exact THEN 'exact' WHEN sim >= {FUZZY_BAR} THEN 'fuzzy' ELSE 'noise' END AS outcome,
        CASE WHEN exact OR sim >= {FUZZY_BAR} THEN against END AS against, sim,
        CASE WHEN exact THEN w.weight WHEN sim >= {FUZZY_BAR} THEN sim * sw ELSE 0.0 END::DOUBLE AS matched,
        CASE WHEN exact THEN w.weight WHEN sim >= {FUZZY_BAR} THEN sw ELSE coalesce(w.weight, {UNKNOWN_WEIGHT}) END::DOUBLE AS added
      FROM kept_words k JOIN sims s ON k.word = s.word LEFT JOIN weight w ON w.word = k.word""")
    c.add("scores", """
      SELECT * FROM (SELECT source, o.sig_pos, CASE WHEN total + a - m <= 0 THEN 0.0 ELSE least(1.0, m / (total + a - m)) END::DOUBLE AS score
        FROM (SELECT source, sig_pos, sum(matched ORDER BY tpos) AS m, sum(added ORDER BY tpos) AS a FROM outcome GROUP BY ALL) o
        JOIN sig_total t ON t.sig_pos = o.sig_pos) WHERE score > 0""")


def pairs(c: Ctes, headers: str) -> None:
    """``pairs``: every scored pair of every file."""
    c.add("fs", f"SELECT file_id, source, min(src_pos) AS src_pos, count(*) AS repeats FROM {headers} GROUP BY ALL")
    c.add("pairs", """SELECT f.file_id, f.source, f.src_pos, f.repeats, s.sig_pos, t.target_id, s.score
      FROM fs f JOIN scores s ON s.source = f.source JOIN target t ON t.sig_pos = s.sig_pos""")


def mapping_parts(headers: str, lexicon: Lexicon, mode: str, threshold: float, condition: str) -> Ctes:
    """The subqueries of ``mapping`` alone, with a further condition on the pairs (f: file's source, t: target)."""
    c = Ctes()
    mapping(c, headers, lexicon, mode, threshold)
    c.parts = [p + "" if not p.startswith("pairs AS") else p[:-1] + " " + condition + ")" for p in c.parts]
    return c


def mapping(c: Ctes, headers: str, lexicon: Lexicon, mode: str, threshold: float) -> str:
    """``mapping``: 26 rows per file (file_id, target_pos, target_id, source or NULL, confidence)."""
    (deep_tokens if mode == "deep" else standard_tokens)(c, headers, lexicon)
    lemma_tables(c)
    pair_scores(c)
    pairs(c, headers)
    c.add("ambig", f"""
      SELECT *, bool_or(rival) OVER (PARTITION BY file_id, source) AS ambiguous FROM (
        SELECT *, max(score) OVER (PARTITION BY file_id, source) AS top, (repeats > 1 OR (row_number() OVER
          (PARTITION BY file_id, source ORDER BY score DESC, sig_pos) > 1 AND max(score) OVER
          (PARTITION BY file_id, source) - score <= 0.05)) AS rival FROM pairs WHERE score >= {threshold})""")
    c.add("bonus", """
      SELECT a.*, CASE WHEN NOT ambiguous OR regexp_matches(lower(source), 'amount|value|cost|sum|number|count|qty|freq') THEN 0.0
        WHEN regexp_matches(source, 's([^A-Za-z0-9_]|$)') OR regexp_matches(lower(source), 'orders|invoices|payments')
          THEN CASE WHEN counts = 1 THEN 0.1 ELSE 0.0 END
        ELSE CASE WHEN amounts = 1 THEN 0.1 ELSE 0.0 END END::DOUBLE AS extra
      FROM ambig a JOIN target t ON t.sig_pos = a.sig_pos""")
    c.add("cand", """
      SELECT file_id, source, sig_pos, score + extra AS final, row_number() OVER (PARTITION BY file_id ORDER BY ambiguous,
        CASE WHEN ambiguous THEN -top ELSE -score END, src_pos, CASE WHEN ambiguous THEN -(score + extra) ELSE 0 END,
        -score, sig_pos) AS ord FROM bonus""")
    c.add("walk", """
      SELECT DISTINCT file_id, 0::BIGINT AS n, []::BIGINT[] AS sigs, []::VARCHAR[] AS srcs, []::DOUBLE[] AS conf FROM fs
      UNION ALL
      SELECT w.file_id, w.n + 1,
        CASE WHEN list_contains(sigs, k.sig_pos) OR list_contains(srcs, k.source) THEN sigs ELSE sigs || [k.sig_pos] END,
        CASE WHEN list_contains(sigs, k.sig_pos) OR list_contains(srcs, k.source) THEN srcs ELSE srcs || [k.source] END,
        CASE WHEN list_contains(sigs, k.sig_pos) OR list_contains(srcs, k.source) THEN conf ELSE conf || [k.final] END
      FROM walk w JOIN cand k ON k.file_id = w.file_id AND k.ord = w.n + 1""")
    c.add("walked", "SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC) = 1")
    c.add("taken", "SELECT file_id, sigs[i] AS sig_pos, srcs[i] AS source, conf[i] AS confidence FROM "
                   "(SELECT *, unnest(generate_series(1, len(sigs))) AS i FROM walked)")
    c.add("mapping", """
      SELECT f.file_id, t.target_pos, t.target_id, k.source, coalesce(k.confidence, 0.0) AS confidence
      FROM (SELECT DISTINCT file_id FROM fs) f CROSS JOIN target t
      LEFT JOIN taken k ON k.file_id = f.file_id AND k.sig_pos = t.sig_pos""")
    return "mapping"
