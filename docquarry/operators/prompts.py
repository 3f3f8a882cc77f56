"""What a model is told: documents as blocks of pages, what is said of their coverage, digests, chunks, and corrections.

Pages: (doc_id, page, text); documents: (doc_id, pages, pages_without_text, ocr_pages). A message is as long as its document, which admission bounds.
Pages are put together in order by one grouping; every text has been defused before. The rules themselves (system messages) are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import without_tags
from ..functions.text import has_letter
from .chunks import overview_texts

# The sentences around a document, as models were given them, and limits of a correction.
ALL_READ, NOT_READ = "All pages have extractable text.", "Pages without extractable text (not analysed): "
RECOGNISED = (' Text of pages ', ' (marked source="ocr") was recognised by OCR in the user\'s browser and may contain recognition errors.')
ASKS = {
    "single": "Analyse the document below according to the rules. Return only the JSON object.\n\n", "compact": "Analyse it according to the rules. Return only the JSON object.\n\n",
    "chunked": "Extract the facts of this part according to the rules. Return only the JSON object.\n\n", "overview": "Describe the document according to the rules. Return only the JSON object.\n\n",
}
EXCERPT, FULL = "The text below is an excerpt: the beginning of every readable page (marked […]).", "The text below is the full readable text."
CORRECTION = ("Your previous answer did not pass validation: ", ". Return a corrected JSON object that follows every rule and the schema.")
MOST_PROBLEMS, MOST_HISTORY = 8, 8_000
# End of the fixed values.


def _numbers(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")


def coverage(without_text: Column) -> Column:
    """Which pages a model does not see."""
    return F.when(F.size(without_text) > 0, F.concat(F.lit(NOT_READ), _numbers(without_text), F.lit("."))).otherwise(ALL_READ)


def page_block(page: Column, text: Column, attributes: Column | None = None) -> Column:
    """A page between its tags; nothing in the text can pass for them."""
    return F.concat(F.lit('<page number="'), page.cast("string"), F.lit('"'), F.lit("") if attributes is None else attributes, F.lit(">\n"), without_tags(text), F.lit("\n</page>"))


def blank_block(page: Column) -> Column:
    return F.concat(F.lit('<page number="'), page.cast("string"), F.lit('" status="no-extractable-text"></page>'))


def _document(blocks: Column) -> Column:
    return F.concat(F.lit("<document>\n"), F.array_join(blocks, "\n"), F.lit("\n</document>"))


def _in_order(rows: DataFrame, block: Column, *order: str) -> DataFrame:
    """(doc_id, blocks): the blocks of a document's rows in order."""
    kept = rows.select("doc_id", F.struct(*order, block.alias("block")).alias("b"))
    return kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]).alias("blocks"))


def document_messages(documents: DataFrame, pages: DataFrame, mode: str = "single") -> DataFrame:
    """(doc_id, message) of whole documents. In compact mode, pages are those of marked_pages(), and recognised ones are named."""
    told = pages.join(documents.select("doc_id", "pages_without_text", "ocr_pages"), "doc_id")
    source = F.when(F.array_contains("ocr_pages", F.col("page")), ' source="ocr"').otherwise("") if mode == "compact" else None
    block = F.when(F.array_contains("pages_without_text", F.col("page")), blank_block(F.col("page"))).otherwise(page_block(F.col("page"), F.col("text"), source))
    whole = documents.join(_in_order(told, block, "page"), "doc_id")
    said = coverage(F.col("pages_without_text"))
    if mode == "compact":
        read = F.concat(F.lit(RECOGNISED[0]), _numbers(F.col("ocr_pages")), F.lit(RECOGNISED[1]))
        said = F.concat(said, F.when(F.size("ocr_pages") > 0, read).otherwise(""))
    return whole.select("doc_id", F.concat(F.lit("The document has "), F.col("pages").cast("string"), F.lit(" pages. "), said, F.lit(f"\n{ASKS[mode]}"), _document(F.col("blocks"))).alias("message"))


def chunk_messages(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, chunk, message) of the parts that chunks() gives."""
    continued = F.when(F.col("overlap") != "", ' continued="true"').otherwise("")
    each = pieces.select("doc_id", "chunk", F.struct("seq", "page", page_block(F.col("page"), F.concat("overlap", "new_text"), continued).alias("block")).alias("b"))
    parts = each.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    total = pieces.groupBy("doc_id").agg(F.max("chunk").alias("total"))
    whole = parts.join(total, "doc_id").join(documents.select("doc_id", "pages", "pages_without_text"), "doc_id")
    seen = F.array_distinct(F.transform("bs", lambda b: b["page"]))
    head = F.concat(F.lit("This is part "), F.col("chunk").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" of a "), F.col("pages").cast("string"), F.lit("-page document (pages "), _numbers(F.array_sort(seen)), F.lit(" in this part). "))
    return whole.select("doc_id", "chunk", F.concat(head, coverage(F.col("pages_without_text")), F.lit(f"\n{ASKS['chunked']}"), _document(F.transform("bs", lambda b: b["block"]))).alias("message"))


def overview_messages(documents: DataFrame, pages: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, message) of a document's whole readable text, or of its digest; pages without text come last."""
    shown = overview_texts(pages) if budget is None else overview_texts(pages, budget)
    readable = shown.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", page_block(F.col("page"), F.col("text")).alias("block")))), lambda b: b["block"]).alias("blocks"), F.first("digest").alias("digest"))
    whole = documents.join(readable, "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    note = F.when(F.coalesce("digest", F.lit(False)), EXCERPT).otherwise(FULL)
    every = F.concat("blocks", F.transform("pages_without_text", blank_block))
    return whole.select("doc_id", F.concat(F.lit("The document has "), F.col("pages").cast("string"), F.lit(" pages. "), coverage(F.col("pages_without_text")), F.lit(" "), note, F.lit(f"\n{ASKS['overview']}"), _document(every)).alias("message"))


def correction(problems: Column) -> Column:
    """What is said after an answer with problems: the first few of them."""
    return F.concat(F.lit(CORRECTION[0]), F.array_join(F.slice(problems, 1, MOST_PROBLEMS), "; "), F.lit(CORRECTION[1]))


def correction_history(message: Column, answer_text: Column, problems: Column) -> Column:
    """Array of (role, content) of a second attempt: the first message, the answer as far as it is kept, where there was one, and the correction."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.when(F.coalesce(answer_text, F.lit("")) != "", F.array(turn("assistant", F.substring(answer_text, 1, MOST_HISTORY)))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(F.array(turn("user", message)), said, F.array(turn("user", correction(problems))))


def readable(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, pages_without_text, ocr_pages) of pages, for documents that come without a request."""
    blank = F.when(~has_letter(F.col("text")), F.col("page").cast("int"))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.array_sort(F.collect_list(blank)).alias("pages_without_text")).withColumn("ocr_pages", F.array().cast("array<int>"))
