"""Positioned items of a page as lines of text, and recognised text put into pages without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import composed
from ..functions.text import clean_recognised, has_letter

# Parts of an item's height within which it is on a line, and beyond which a gap is a blank.
ON_LINE, GAP = 0.5, 0.18
# End of the fixed values.

_ITEM = "struct<up:double,x:double,n:long,str:string,w:double,h:double>"


def _joined(line: Column) -> Column:
    """Items of one line, sorted by x, as text."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("edge"), F.lit(0.0).alias("h"))

    def step(acc: Column, i: Column) -> Column:
        wide = (i["x"] - acc["edge"]) > F.greatest(i["h"], acc["h"], F.lit(1.0)) * GAP
        spaced = acc["text"].rlike(r"(?U)\s\z") | i["str"].rlike(r"(?U)\A\s")
        return F.struct(F.concat(acc["text"], F.when(wide & ~spaced, " ").otherwise(""), i["str"]).alias("text"), (i["x"] + i["w"]).alias("edge"), i["h"].alias("h"))

    text = F.aggregate(line, start, step, lambda acc: acc["text"])
    return F.trim(F.regexp_replace(text, "[ \t ]+", " "))


def page_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) of items (doc_id, page, n, str, x, y, w, h); n: an item's place in its page, which breaks ties.

    From the top down, an item is on the line of the item that began it if it is near enough in height. Lines depend on
    the items before, so they are folded within the page's array; a page is as large as a sheet of paper can be.
    """
    seen = items.filter(F.char_length("str") > 0)
    item = F.struct((-F.col("y")).cast("double").alias("up"), F.col("x").cast("double").alias("x"), F.col("n").cast("long").alias("n"), "str", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    sheets = seen.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).cast(f"array<{_ITEM}>").alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(f"array<{_ITEM}>").alias("line"))

    def flushed(acc: Column) -> Column:
        by_x = F.array_sort(F.transform(acc["line"], lambda i: F.struct(i["x"].alias("x"), i["up"].alias("up"), i["n"].alias("n"), i["str"].alias("str"), i["w"].alias("w"), i["h"].alias("h"))))
        return F.concat(acc["done"], F.array(_joined(by_x)))

    def step(acc: Column, i: Column) -> Column:
        anchor = F.get(acc["line"], F.lit(0))
        same = F.abs(anchor["up"] - i["up"]) <= F.greatest(i["h"], anchor["h"], F.lit(1.0)) * ON_LINE
        return (
            F.when(F.size(acc["line"]) == 0, F.struct(acc["done"].alias("done"), F.array(i).alias("line")))
            .when(same, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.array(i)).alias("line")))
            .otherwise(F.struct(flushed(acc).alias("done"), F.array(i).alias("line")))
        )

    lines = F.aggregate("items", start, step, flushed)
    return sheets.select("doc_id", "page", composed(F.array_join(F.filter(lines, lambda x: x != ""), "\n")).alias("text"))


def with_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """(doc_id, page, text, recognised): pages without a letter take the text found for them, edited text before machine text.

    recognised: (doc_id, page, machine, edited). Pages that have text keep it.
    """
    found = recognised.select("doc_id", "page", F.coalesce("edited", clean_recognised(F.col("machine"))).alias("_found"))
    joined = pages.select("doc_id", "page", "text").join(found, ["doc_id", "page"], "left")
    take = ~has_letter(F.col("text")) & has_letter(F.col("_found"))
    return joined.select("doc_id", "page", F.when(take, F.col("_found")).otherwise(F.col("text")).alias("text"), take.alias("recognised"))


def recognised_documents(documents: DataFrame, pages: DataFrame, recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, pages_without_text, ocr_pages) and their pages (doc_id, page, text) after one more recognition.

    recognised: (doc_id, pos, page, machine, edited); of several for a page the last counts. Only pages that are flagged as without text take
    what was found for them, edited text before machine text, and only if it has a letter; others stay as they are, and flagged. Pages that were
    recognised before stay named, so lists grow over successive recognitions.
    """
    flagged = documents.select("doc_id", F.explode("pages_without_text").alias("page")).distinct()
    found = recognised.select("doc_id", "page", "pos", F.coalesce("edited", clean_recognised(F.col("machine"))).alias("found")).filter(has_letter(F.col("found")))
    last = found.groupBy("doc_id", "page").agg(F.max_by("found", "pos").alias("_found")).join(flagged, ["doc_id", "page"], "left_semi")
    after = pages.select("doc_id", "page", "text").join(last, ["doc_id", "page"], "left")
    after = after.select("doc_id", "page", F.coalesce("_found", "text").alias("text"), F.col("_found").isNotNull().alias("_taken"))
    with_text = F.when(has_letter(F.col("text")), F.col("page"))
    lists = after.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(~has_letter(F.col("text")), F.col("page")))).alias("_blank"), F.collect_list(with_text).alias("_read"), F.collect_list(F.when(F.col("_taken"), F.col("page"))).alias("_taken"),
    )
    none = F.array().cast("array<int>")
    named = F.array_union(F.coalesce("ocr_pages", none), F.coalesce("_taken", none))
    told = documents.join(lists, "doc_id", "left").withColumns({"pages_without_text": F.coalesce("_blank", none), "ocr_pages": F.array_sort(F.array_intersect(named, F.coalesce("_read", none)))})
    return told.select(*documents.columns), after.select("doc_id", "page", "text")
