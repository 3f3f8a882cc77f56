"""Requests as they come in, bytes of JSON, as verdicts, documents and pages.

Bodies: (id, body), body binary. A body that cannot be read is a row with a verdict like any other, never an error of the job. JSON is expected in
UTF-8, a byte order mark before it is passed over. Numbers that are no JSON (NaN) and keys that are there twice make a body unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import child, problems, strict_json
from ..functions.text import has_letter, letters
from ..operators.contract import REQUEST, page_structs
from ..operators.requests import LEAST_LETTERS, MOST_BODY, MOST_CHARS

# Characters of a document that each mode takes.
MODE_CHARS = {"single": 48_000, "compact": 30_000, "chunked": MOST_CHARS}
# End of the fixed values.


def request_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, body) of whole files, one request each; id is the file's path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("id"), F.col("content").alias("body"))


def body_text(body: Column) -> Column:
    """The text of a body in valid UTF-8, or null."""
    bare = F.when(F.substring(body, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.substring(body, F.lit(4), F.octet_length(body))).otherwise(body)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string"))


def requests(bodies: DataFrame, mode: str | Column = "single", most_bytes: int = MOST_BODY) -> DataFrame:
    """(id, verdict, problems, file_name, pages, pages_without_text, ocr_pages, total_chars, total_letters, texts) of every body.

    verdict: the first rule that fails, in this order: BODY_TOO_LARGE, INVALID_REQUEST (unreadable, of another shape, or at odds with itself; problems say
    where), DOCUMENT_TOO_LONG for the mode, NO_TEXT_LAYER, INVALID_REQUEST again for recognised pages outside of compact mode,
    INSUFFICIENT_CONTENT, or ADMITTED. texts: (page, text) of a request that has the right shape, else null.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    large = F.octet_length("body") > most_bytes
    read = bodies.select("id", mode.alias("mode"), large.alias("large"), strict_json(F.when(~large, body_text(F.col("body")))).alias("value"))
    unread = F.when(F.col("value").isNull(), F.array(F.lit("root: not valid JSON in UTF-8")))
    read = read.withColumn("problems", F.when(F.col("large"), F.array().cast("array<string>")).otherwise(F.coalesce(unread, problems(F.col("value"), REQUEST))))
    right = ~F.col("large") & (F.size("problems") == 0)
    v = F.col("value")
    fields = {"file_name": child(v, "fileName", "string"), "pages": child(v, "pageCount", "int"), "pages_without_text": child(v, "pagesWithoutText", "array<int>"), "ocr_pages": F.coalesce(child(v, "ocrPages", "array<int>"), F.array().cast("array<int>")), "texts": page_structs(v)}
    told = read.withColumns({n: F.when(right, c) for n, c in fields.items()}).drop("value")
    total = lambda of: F.aggregate("texts", F.lit(0).cast("long"), lambda acc, p: acc + of(p["text"]))
    told = told.withColumns({"total_chars": total(F.char_length), "total_letters": total(letters)})
    most = F.lit(MODE_CHARS["chunked"])
    for name, chars in MODE_CHARS.items():
        most = F.when(F.col("mode") == name, chars).otherwise(most)
    verdict = (
        F.when(F.col("large"), "BODY_TOO_LARGE").when(F.size("problems") > 0, "INVALID_REQUEST").when(F.col("total_chars") > most, "DOCUMENT_TOO_LONG").when(F.size("pages_without_text") == F.col("pages"), "NO_TEXT_LAYER")
        .when((F.size("ocr_pages") > 0) & (F.col("mode") != "compact"), "INVALID_REQUEST").when(F.col("total_letters") < LEAST_LETTERS, "INSUFFICIENT_CONTENT").otherwise("ADMITTED")
    )
    return told.select("id", verdict.alias("verdict"), "problems", "file_name", "pages", "pages_without_text", "ocr_pages", "total_chars", "total_letters", "texts")


def admitted_documents(found: DataFrame) -> DataFrame:
    """(doc_id, file_name, pages, pages_without_text, ocr_pages) of requests() that are admitted."""
    return found.filter("verdict = 'ADMITTED'").select(F.col("id").alias("doc_id"), "file_name", "pages", "pages_without_text", "ocr_pages")


def admitted_pages(found: DataFrame) -> DataFrame:
    """(doc_id, page, text) of requests() that are admitted."""
    return found.filter("verdict = 'ADMITTED'").select(F.col("id").alias("doc_id"), F.inline("texts"))


def request_json(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, body): documents (doc_id, file_name, ocr_pages) with their pages as requests, as a client would send them. At most 500 pages a document."""
    page = F.struct(F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    told = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    joined = documents.join(told, "doc_id")
    blank = F.transform(F.filter("pages", lambda p: ~has_letter(p["text"])), lambda p: p["page"])
    return joined.select("doc_id", F.to_json(F.struct(F.col("file_name").alias("fileName"), F.size("pages").alias("pageCount"), "pages", blank.alias("pagesWithoutText"), F.when(F.size("ocr_pages") > 0, F.col("ocr_pages")).alias("ocrPages"))).cast("binary").alias("body"))
