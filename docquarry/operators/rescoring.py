"""Saved runs scored again with the checks of today: one report a run, no model called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import problems
from ..sources import cases
from ..sources.tables import settled
from .contract import RESULT, result_columns
from .evaluation import case_problems, fact_checks, forbidden_checks, grounding_checks, result_checks, verdicts
from .requests import result_digest

VERSION = "1"


def rescored(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(label, case_id, http_status, latency_ms, digest, schema_problems, status, passed, total, by_category, failures, pending) of every run of a manifest.

    runs, found: as sources.cases.manifest() and files() give them. A run without a usable answer fails and has no checks. Runs are as many rows as the
    manifest has; they are read and judged by shape once, in a written table that all checks share.
    """
    r = F.col("response")
    read = cases.loaded_runs(runs, found).withColumn("schema_problems", F.when(r.isNotNull(), problems(r, RESULT)))
    read = read.withColumn("digest", F.when(F.size("schema_problems") == 0, result_digest(r)))
    loaded = read.select("label", "case_id", "http_status", "latency_ms", "case", "request", "review", "schema_problems", "digest", F.struct(*result_columns(r)).alias("result"))
    loaded = settled(loaded)
    every = loaded.select(F.col("label").alias("doc_id"), "http_status", "latency_ms", "digest", "result.*")
    valid = loaded.filter("size(schema_problems) = 0").select(F.col("label").alias("doc_id"), "result.*")
    expected, pages = cases.expected_facts(loaded), cases.request_pages(loaded)
    own = lambda frame: frame.join(valid.select("doc_id"), "doc_id", "left_semi")
    checks = (
        fact_checks(own(expected), valid).unionByName(forbidden_checks(own(cases.forbidden_amounts(loaded)), valid)).unionByName(grounding_checks(valid, own(pages)))
        .unionByName(result_checks(valid, cases.request_documents(loaded), cases.expectations(loaded)))
    )
    checks = settled(checks)
    ill = case_problems(expected, pages, cases.unreadable_pages(loaded))
    judged = verdicts(every, checks, ill, cases.reviews(loaded))
    counted = checks.filter("ok OR NOT manual").groupBy("doc_id", "category").agg(F.count_if("ok").alias("n"), F.count(F.lit(1)).alias("of"))
    score = F.struct("category", F.concat_ws("/", F.col("n").cast("string"), F.col("of").cast("string")).alias("score"))
    by_category = counted.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(score))).alias("by_category"))
    out = loaded.select(F.col("label").alias("doc_id"), "case_id", "http_status", "latency_ms", "digest", "schema_problems").join(judged, "doc_id").join(by_category, "doc_id", "left")
    return out.withColumnRenamed("doc_id", "label")


def write_reports(reports: DataFrame, folder: str, version: str = VERSION) -> None:
    """One folder of JSON a version and run. Writing again replaces the reports of the runs that are written, and no others."""
    named = reports.withColumns({"version": F.lit(version), "run": F.col("label")})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "run").json(folder)


def summary(reports: DataFrame) -> DataFrame:
    """(label, status, score, categories) in order of labels: passed of total, and each category's."""
    score = F.when(F.col("total") > 0, F.concat_ws("/", F.col("passed").cast("string"), F.col("total").cast("string"))).otherwise("—")
    told = F.array_join(F.transform(F.array_sort(F.map_keys("by_category")), lambda k: F.concat_ws(" ", k, F.element_at("by_category", k))), ", ")
    return reports.select("label", "status", score.alias("score"), F.coalesce(told, F.lit("")).alias("categories"))
