"""Grids and header lists derived from the TPC-H-like tables; every one grows with its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..lexicon import TARGETS
from ..sources.grids import text_grids

STATEMENT_STYLES = [
    ["Order Number", "Order Date", "Status", "Total Amount", "Priority"],
    ["Transaction Count", "Due Days", "Payment Method", "Amount Due", "Terms"],
    None,
    ["Vendor ID", "Company Name", "Currency", "Invoice Total", "PO Count"],
]
EVENT_STYLES = [
    ["When", "Event Type", "Value", "Key"],
    ["Region", "Kind", "2021", "2022"],
    ["2019", "2020", "2021", "2022"],
]
LABELS = [label for _, label, _, _ in TARGETS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lines(*lines) -> Column:
    """Array of (line_no, cells)."""
    return F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), cells.alias("cells")) for n, cells in lines])


def _style(styles, index: Column) -> Column:
    known = F.array(*[_texts(s) if s else F.lit(None).cast("array<string>") for s in styles])
    return F.get(known, (index % len(styles)).cast("int"))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line_no, cells): per customer a title, a note, a blank line, a header (some have none), its orders."""
    customer = table(spark, sf_dir, "customer")
    top = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"), F.explode(_lines(
        (0, F.array(F.concat(F.lit("Statement of "), "c_name"))),
        (1, F.array(F.concat(F.lit("Segment: "), "c_mktsegment"))),
        (2, F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))),
        (3, _style(STATEMENT_STYLES, F.col("c_custkey"))))).alias("l")).select("file_id", "l.line_no", "l.cells")
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    body = orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file_id"),
        (F.col("o_orderkey") + 10).cast("long").alias("line_no"),
        F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), status,
                F.col("o_totalprice").cast("decimal(18,2)").cast("string"), priority).alias("cells"))
    return top.unionByName(body).where("cells is not null")


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, row_idx, cells): one sheet per customer with labels down the first column."""
    key = F.col("c_custkey").cast("string")
    third = F.when(F.col("c_custkey") % 3 == 0, F.lit("Company Name")).otherwise(F.lit("Phone"))
    rows = _lines(
        (0, F.array(F.lit("Company Name"), F.col("c_name"), F.col("c_mktsegment"))),
        (1, F.array(F.lit("Account ID"), F.concat(F.lit("A-"), key), F.lit("open"))),
        (2, F.array(third, F.concat(F.lit("t"), key), F.lit("main"))),
        (3, F.array(F.lit("Country"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit("home"))),
        (4, F.array(F.lit("Balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("USD"))))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("k"), key).alias("file_id"), F.explode(rows).alias("l")).select(
            "file_id", F.col("l.line_no").alias("row_idx"), "l.cells")


def event_lines(events: DataFrame) -> DataFrame:
    """(file_id, line_no, cells): per user a header and the events."""
    users = events.select("user_id").distinct()
    name = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_id")
    top = users.select(name, F.lit(0).cast("long").alias("line_no"), _style(EVENT_STYLES, F.col("user_id")).alias("cells"))
    body = events.select(name, (F.col("event_id") + 1).cast("long").alias("line_no"), F.array(
        F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.col("value").cast("decimal(18,2)").cast("string"),
        F.get_json_object("props", "$.k")).alias("cells"))
    return top.unionByName(body)


def document_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_grids(table(spark, sf_dir, "documents"), "doc_id", "text")


def chat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per conversation, one row per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("file_id"), F.col("turn").cast("long").alias("row_idx"),
        F.split("text", ",").alias("cells"))


def line_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, src_pos, source): each order is a file and each of its lines a header in one of eight spellings."""
    part = F.col("l_partkey")
    label = F.get(_texts(LABELS), (part % len(LABELS)).cast("int"))
    style = ((F.floor(part / len(LABELS)) + F.col("l_linenumber")) % 8).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_id"),
        (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + part).alias("src_pos"),
        part.alias("part"), label.alias("label"), style.alias("style"))
    low, tight = F.lower("label"), F.replace("label", F.lit(" "), F.lit(""))
    swapped = F.replace(F.replace(F.replace("label", F.lit("Supplier"), F.lit("Vendor")), F.lit("Amount"), F.lit("Value")),
                        F.lit("Number"), F.lit("Count"))
    source = (F.when(F.col("style") == 0, F.col("label")).when(F.col("style") == 1, F.replace(low, F.lit(" "), F.lit("_")))
              .when(F.col("style") == 2, tight).when(F.col("style") == 3, F.lower(tight))
              .when(F.col("style") == 4, swapped).when(F.col("style") == 5, F.translate(low, "ao", "eu"))
              .when(F.col("style") == 6, F.concat(F.lit("info "), low, F.lit(" data")))
              .otherwise(F.concat("label", F.lit(" "), F.col("part").cast("string"))))
    return lines.select("file_id", "src_pos", source.alias("source"))
