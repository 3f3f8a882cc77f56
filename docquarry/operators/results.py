"""Marked documents, selected facts without repeats, and the results that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import without_tags
from ..functions.text import collapse

# How many results are kept, and how many characters they may take in all.
MOST_RESULTS, MOST_RESULT_CHARS = 10, 1_000_000
WRAPPER = '{"version":1,"entries":[]}'
# End of the fixed values.


def marked_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, text): each candidate of found has its mark ⟦A n⟧ or ⟦D n⟧ before it; marks of the source are defused."""
    tag = F.concat(F.lit("⟦"), F.when(F.col("kind") == "amount", "A").otherwise("D"), F.col("candidate_id").cast("string"), F.lit("⟧"))
    marks = found.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("start", "candidate_id", tag.alias("tag")))).alias("marks"))
    joined = pages.join(marks, ["doc_id", "page"], "left").withColumn("body", F.translate("text", "⟦⟧", "[]"))
    none = F.array().cast("array<struct<start:int,candidate_id:int,tag:string>>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, m: Column) -> Column:
        return F.struct(m["start"].alias("at"), F.concat(acc["parts"], F.array(F.substring(F.col("body"), acc["at"] + 1, m["start"] - acc["at"]), m["tag"])).alias("parts"))

    text = F.aggregate(F.coalesce("marks", none), start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("body"), acc["at"] + 1, F.char_length("body"))))
    return joined.select("doc_id", "page", without_tags(text).alias("text"))


def first_of_each(facts: DataFrame) -> DataFrame:
    """Facts (doc_id, candidate_id, kind, value, currency, date, context): of equal ones in a document, the smallest id stays.

    Amounts are equal by value, currency and context, dates by date and context without marks.
    """
    plain = F.when(F.col("kind") == "date", F.translate("context", "»«", "")).otherwise(F.col("context"))
    same = Window.partitionBy("doc_id", "kind", "value", "currency", "date", plain).orderBy("candidate_id")
    return facts.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")


def kept_results(history: DataFrame, most: int = MOST_RESULTS, most_chars: int = MOST_RESULT_CHARS) -> DataFrame:
    """Of results (owner, id, saved_at, entry), those that are kept: the newest that fit together, and none that fits alone not.

    Ranks are cut to `most` within partial sorts, so an owner with very many results stays cheap.
    """
    fitting = history.filter(F.char_length("entry") + len(WRAPPER) <= most_chars)
    order = Window.partitionBy("owner").orderBy(F.desc("saved_at"), "id")
    newest = fitting.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    chars = F.sum(F.char_length("entry") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1 + len(WRAPPER)
    return newest.withColumn("chars", chars).filter(F.col("chars") <= most_chars)
