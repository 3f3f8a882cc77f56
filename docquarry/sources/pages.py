"""Tables as pages: rows (doc_id, page, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes and rows of a table for each task and core: rows of tables that a few bytes hold take long to work on, and how many a MB holds depends on how the
#: table is compressed.
SHARE, ROWS = 1 << 20, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows dealt to all cores and, the larger it is, to more tasks, so that no task grows with it. A table is often a few row groups, which
    as few tasks would read and work on alone; dealing rows costs little beside that work."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size, cores = int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), spark.sparkContext.defaultParallelism
    # rows are counted from the files' footers
    return found.repartition(cores * max(1, -(-size // (SHARE * cores)), -(-found.count() // (ROWS * cores))))


def paged(rows: DataFrame, *columns: Column, text: Column) -> DataFrame:
    """Columns and text of dealt rows. The text goes through a generator of one row: else filters on it would be judged, with all that renders it, before the
    rows are dealt, in the few tasks that read the table."""
    return rows.select(*columns, F.inline(F.array(F.struct(text.alias("text")))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one page."""
    return paged(table(spark, sf_dir, "documents"), F.col("doc_id"), F.lit(1).alias("page"), text=F.col("text"))


def conversations(spark: SparkSession, sf_dir: str, footer: bool = False) -> DataFrame:
    """A conversation is a document, a turn a page; with a running footer on request."""
    text = F.concat("text", F.lit("\nPage "), F.col("turn") + 1, F.lit(" of 99, 12.03.2026")) if footer else F.col("text")
    return paged(table(spark, sf_dir, "conversations"), F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), text=text)


def orders(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders as prose: an amount in one of three ways of writing, and two dates; with more columns of the order on request."""
    grouped = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    amount = F.when(F.col("o_orderstatus") == "F", F.concat(F.translate(grouped, ",.", ".,"), F.lit(" zł"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("USD "), grouped)).otherwise(F.concat(F.translate(grouped, ",.", " ,"), F.lit(" EUR")))
    text = F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" amounts to "), amount, F.lit(", payable by "), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"), F.lit("."))
    return paged(table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), *more, text=text)


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of orders, for what is not made of their text: a text that goes through a generator is rendered even where no one asks for it."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages with a heading, a labelled line, a table of one row and a sentence."""
    grouped = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", " ,")
    due, placed = F.date_format(F.date_add("o_orderdate", 30), "dd.MM.yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(
        F.lit("FAKTURA SPRZEDAŻY nr "), "o_orderkey", F.lit("\nTermin płatności: "), due, F.lit("\nPozycja Wartość Dnia\nTowar  "), grouped, F.lit(" zł "), placed,
        F.lit("\n\nStrony uznają,\nże dopłata nie przekroczy "), F.col("o_orderkey") % 900 + 100, F.lit(",50 EUR w tym roku. Dalej nic."),
    )
    return paged(table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text=text)
