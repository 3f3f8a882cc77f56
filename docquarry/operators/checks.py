"""Selections against candidates, check scores and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selection_problems(selected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, pos, candidate_id, problem): repeated, then unknown, then wrong kind; null where there is none.

    selected: (doc_id, pos, candidate_id, kind); found: (doc_id, candidate_id, kind).
    """
    again = F.row_number().over(Window.partitionBy("doc_id", "kind", "candidate_id").orderBy("pos")) > 1
    known = found.select("doc_id", "candidate_id", F.col("kind").alias("_kind"))
    joined = selected.withColumn("_again", again).join(known, ["doc_id", "candidate_id"], "left")
    problem = F.when(F.col("_again"), "repeated").when(F.col("_kind").isNull(), "unknown").when(F.col("_kind") != F.col("kind"), "wrong kind")
    return joined.select("doc_id", "pos", "candidate_id", problem.alias("problem"))


def check_scores(checks: DataFrame) -> DataFrame:
    """(category, passed, total) and a row for all, of checks (category, ok)."""
    out = checks.rollup("category").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "passed", "total")


def limited_minutes(events: DataFrame, limit: int = 5) -> DataFrame:
    """(user_id, minute, n): users' whole minutes with more than `limit` requests. Works on streams with a watermark too."""
    return events.groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("user_id", F.col("w.start").alias("minute"), "n")


def crowded_minutes(events: DataFrame, limit: int = 30) -> DataFrame:
    """(minute, n): whole minutes with more than `limit` requests of all users. Counts fold on the map side first."""
    return events.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(F.col("w.start").alias("minute"), "n")
