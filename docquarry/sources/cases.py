"""Evaluation cases, saved runs and the manifest that names them: whole JSON files as rows.

A manifest is a table (label, case, response, http_status, latency_ms, manual_review) whose paths are relative to one folder; files are (name, body)
below that folder. Runs meet their files by name, so no file is opened outside of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import child, items, strict_json
from ..operators.contract import page_structs
from .requests import body_text

# Where cases are.
CASES = "cases/"
# End of the fixed values.

_MANIFEST = "label string, case string, response string, httpStatus int, latencyMs long, manualReview string"


def files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(name, body) of all files below a folder; name: the path from there."""
    bare = root.split("://")[-1].removeprefix("file:").rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return read.select(F.regexp_extract("path", rf"\Q{bare}\E/+(.*)\z", 1).alias("name"), F.col("content").alias("body"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows, from a JSON list."""
    read = spark.read.schema(_MANIFEST).json(path, multiLine=True)
    return read.select("label", "case", "response", F.col("httpStatus").alias("http_status"), F.col("latencyMs").alias("latency_ms"), F.col("manualReview").alias("manual_review"))


def loaded_runs(runs: DataFrame, found: DataFrame) -> DataFrame:
    """A manifest's rows with case, request, response and review as JSON values; null where a file is missing or no JSON. A case holds its request, or
    names the file that does."""
    texts = found.select("name", strict_json(body_text(F.col("body"))).alias("value"))
    of = lambda name, value: texts.select(F.col("name").alias(name), F.col("value").alias(value))
    told = runs.withColumn("case_name", F.concat(F.lit(CASES), "case", F.lit(".json"))).withColumnRenamed("case", "case_id")
    told = told.join(of("case_name", "case"), "case_name", "left").join(of("response", "given"), "response", "left").join(of("manual_review", "review"), "manual_review", "left")
    told = told.withColumn("request_name", child(F.col("case"), "input.localRequest", "string")).join(of("request_name", "named"), "request_name", "left")
    request = F.coalesce(child(F.col("case"), "input.request"), F.col("named"))
    return told.select("label", "case_id", "http_status", "latency_ms", "case", request.alias("request"), F.when(F.col("http_status") == 200, F.col("given")).alias("response"), "review")


def request_documents(loaded: DataFrame) -> DataFrame:
    """(doc_id, file_name, pages, pages_without_text) of the runs' requests; doc_id is the run's label."""
    r = F.col("request")
    return loaded.select(F.col("label").alias("doc_id"), child(r, "fileName", "string").alias("file_name"), child(r, "pageCount", "int").alias("pages"), child(r, "pagesWithoutText", "array<int>").alias("pages_without_text"))


def request_pages(loaded: DataFrame) -> DataFrame:
    return loaded.select(F.col("label").alias("doc_id"), F.inline(page_structs(F.col("request"))))


def unreadable_pages(loaded: DataFrame) -> DataFrame:
    return loaded.select(F.col("label").alias("doc_id"), F.explode(child(F.col("request"), "pagesWithoutText", "array<int>")).alias("page"))


def _list(path: str, kind: str) -> Column:
    return child(F.col("case"), f"expect.{path}", kind)


def expected_facts(loaded: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, value, currency, date, qualifiers, page, evidence, label, event, event_review) that the runs' cases expect."""

    def of(field: str, kind: str) -> DataFrame:
        each = loaded.select(F.col("label").alias("doc_id"), F.posexplode(items(_list(field, "variant"))).alias("pos", "x"))
        x = F.col("x")
        value = child(x, "value", "decimal(38,2)") if kind == "amount" else F.lit(None).cast("decimal(38,2)")
        return each.select(
            "doc_id", "pos", F.lit(kind).alias("kind"), value.alias("value"), child(x, "currency", "string").alias("currency"), child(x, "date", "string").alias("date"), child(x, "qualifiers", "array<string>").alias("qualifiers"),
            child(x, "page", "int").alias("page"), child(x, "evidence", "string").alias("evidence"), child(x, "label", "string").alias("label"), child(x, "event", "array<array<string>>").alias("event"), child(x, "eventReview", "string").alias("event_review"),
        )

    return of("amounts", "amount").unionByName(of("dates", "date"))


def expectations(loaded: DataFrame) -> DataFrame:
    """(doc_id, expect) as evaluation.result_checks() takes them."""
    text, texts = (lambda p: _list(p, "string")), (lambda p: _list(p, "array<string>"))
    expect = F.struct(
        text("document.type").alias("type"), text("document.language").alias("language"), text("document.date").alias("date"), texts("document.titleContains").alias("title_contains"), texts("organizations").alias("organizations"), texts("people").alias("people"),
        F.coalesce(_list("allOrganizationsHaveLegalForms", "boolean"), F.lit(False)).alias("legal_forms"), texts("forbiddenNarrative").alias("forbidden_narrative"),
    )
    return loaded.select(F.col("label").alias("doc_id"), expect.alias("expect"))


def forbidden_amounts(loaded: DataFrame) -> DataFrame:
    each = loaded.select(F.col("label").alias("doc_id"), F.explode(items(_list("forbiddenAmounts", "variant"))).alias("x"))
    return each.select("doc_id", child(F.col("x"), "value", "decimal(38,2)").alias("value"), child(F.col("x"), "currency", "string").alias("currency"))


def reviews(loaded: DataFrame) -> DataFrame:
    """(doc_id, digest, dimension, verdict) of the runs' reviews by hand."""
    each = loaded.select(F.col("label").alias("doc_id"), child(F.col("review"), "resultSha256", "string").alias("digest"), F.explode(child(F.col("review"), "dimensions", "map<string,variant>")).alias("dimension", "x"))
    return each.select("doc_id", "digest", "dimension", child(F.col("x"), "verdict", "string").alias("verdict"))
