"""Which documents may be analysed. Pages are rows (doc_id, page, text); sums combine on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_letter, letters

LEAST_LETTERS, MOST_CHARS = 200, 30_000


def totals(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, total_chars, total_letters, pages_without_text, in_order)."""
    text = F.coalesce("text", F.lit(""))
    blank = F.when(~has_letter(F.col("text")), F.col("page"))
    found = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.char_length(text)).alias("total_chars"), F.sum(letters(text)).alias("total_letters"),
        F.array_sort(F.collect_list(blank)).alias("pages_without_text"), F.min("page").alias("_a"), F.max("page").alias("_b"), F.count_distinct("page").alias("_n"),
    )
    in_order = (F.col("_a") == 1) & (F.col("_b") == F.col("n_pages")) & (F.col("_n") == F.col("n_pages"))
    return found.withColumn("in_order", in_order).drop("_a", "_b", "_n")


def admit(pages: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """totals() with verdict: the first rule that a document fails, or ADMITTED."""
    verdict = (
        F.when(F.col("total_chars") > most_chars, "DOCUMENT_TOO_LONG")
        .when(F.size("pages_without_text") == F.col("n_pages"), "NO_TEXT_LAYER")
        .when(F.col("total_letters") < LEAST_LETTERS, "INSUFFICIENT_CONTENT")
        .otherwise("ADMITTED")
    )
    return totals(pages).withColumn("verdict", verdict)
