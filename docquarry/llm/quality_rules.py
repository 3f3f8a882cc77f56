"""Host-level quality rules: per-document rule failures, shrunk host rates, host verdicts joined back.

Everything here is DataFrame and SQL expressions. A host is the value of one column (`source` in the
`documents` table); null is a host of its own.

Method. Each document is tested against RULES. Failures are summed by host (partial sums on the map side, so a
host with a third of all rows costs its reducer one row per map task). For each rule the hosts' failure rates
give an empirical Beta prior by moments; a host's rate is the posterior mean under it, so a host with few
documents stays near the corpus rate. A host that fails a rule with a shrunk rate above `host_limit` is
rejected, and its verdict is joined back to its documents.

Defined results. Null and empty texts have no words: all counts 0, base_failed true. Repeated rows and repeated
ids are kept, one result row for each input row. An empty table gives an empty result. Columns other than the
three that are named are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, materialize, table, words_of

MIN_WORDS = 50
HOST_LIMIT = 0.5
#: Bounds of the prior's strength in documents, so that equal hosts don't give an infinite one.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0

#: name: SQL condition over the counters. The first two are the base rules of the contract.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
BASE_RULES = ("few_words", "repetitive")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: positions covered by 3-word windows that occur at least twice in the text.

    Windows are sorted with their positions inside the row, and equal neighbours are repeats: n log n in the
    words of one document, with no shuffle.
    """
    last = F.size("_words") - 2
    windows = F.when(last > 1, F.transform(F.slice("_words", 1, F.greatest(last, F.lit(1))), lambda w, i: F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2))))
    df = df.withColumn("_windows", windows)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(x["g"] == F.get("_sorted", k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_sorted", k + 1)["g"], F.lit(False))
    df = df.withColumn("_starts", F.transform(F.filter("_sorted", same), lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2))))
    return df.withColumn("n_repeat_words", F.coalesce(F.size(covered).cast("long"), F.lit(0).cast("long")))


def _chars_outside(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def rule_counters(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host, the counters and one fail_<rule> boolean per rule; narrow rows, no shuffle."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    df = _repeat_words(df)
    df = df.select(
        "doc_id",
        "host",
        F.size("_words").cast("long").alias("n_words"),
        _chars_outside(F.col("_text"), WORD_GAP).alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    )
    return df.select("*", *[F.expr(cond).alias(f"fail_{name}") for name, cond in RULES.items()])


def host_rates(counters: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: its documents, shrunk failure rate by rule, and host_rejected.

    The prior is one row of twelve numbers, the only thing that the driver sees.
    """
    hosts = counters.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in RULES]
    )
    moments = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.count(F.lit(1)).alias("h"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("host_docs")).alias(f"q_{r}") for r in RULES],
    ).first()
    rates = []
    for r in RULES:
        n, h = moments["n"] or 0, moments["h"]
        mean = (moments[f"k_{r}"] or 0) / n if n else 0.0
        # variance of the hosts' rates, weighted by documents, less what binomial sampling alone would give
        between = ((moments[f"q_{r}"] or 0.0) / n - mean * mean - mean * (1 - mean) * h / n) if n else 0.0
        strength = mean * (1 - mean) / between - 1 if between > 0 else MOST_STRENGTH
        strength = min(max(strength, LEAST_STRENGTH), MOST_STRENGTH)
        rates.append(((F.col(f"k_{r}") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))).alias(f"rate_{r}"))
    rated = hosts.select("host", "host_docs", *rates)
    return rated.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > host_limit)


def apply_quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counters, rule failures, host rates and `kept` for every row of docs.

    kept: no rule failed by the document, and its host not rejected. The counters are written once to the shared
    folder because they are both aggregated and joined; the text is read once. The join with the host table is
    left to the optimizer: it is broadcast only if its measured size allows, else sorted and merged with
    skewed hosts split.
    """
    counters = materialize(rule_counters(docs, doc_id, text, host), "rules")
    hosts = host_rates(counters, host_limit).withColumnRenamed("host", "_host")
    joined = counters.join(hosts, counters["host"].eqNullSafe(hosts["_host"]), "left").drop("_host")
    base = F.col(f"fail_{BASE_RULES[0]}") | F.col(f"fail_{BASE_RULES[1]}")
    own = F.greatest(*[F.col(f"fail_{r}").cast("int") for r in RULES]) > 0
    return joined.withColumn("base_failed", base).withColumn("kept", ~own & ~F.col("host_rejected"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def _sql() -> str:
    fails = ", ".join(f"({c}) AS fail_{r}" for r, c in RULES.items())
    ks = ", ".join(f"sum(fail_{r}::BIGINT) AS k_{r}" for r in RULES)
    sums = ", ".join(f"sum(k_{r}) AS s_{r}, sum(k_{r}::DOUBLE * k_{r} / host_docs) AS q_{r}" for r in RULES)
    means = ", ".join(f"s_{r} / n AS m_{r}, q_{r} / n - (s_{r} / n) * (s_{r} / n) - (s_{r} / n) * (1 - s_{r} / n) * h / n AS b_{r}" for r in RULES)
    strengths = ", ".join(f"m_{r}, least(greatest(CASE WHEN b_{r} > 0 THEN m_{r} * (1 - m_{r}) / b_{r} - 1 ELSE {MOST_STRENGTH} END, {LEAST_STRENGTH}), {MOST_STRENGTH}) AS t_{r}" for r in RULES)
    worst = ", ".join(f"(k_{r} + m_{r} * t_{r}) / (host_docs + t_{r})" for r in RULES)
    own = " OR ".join(f"fail_{r}" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g2),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g3, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, {fails} FROM c),
h AS (SELECT host, count(*) AS host_docs, {ks} FROM f GROUP BY host),
a AS (SELECT sum(host_docs) AS n, count(*) AS h, {sums} FROM h),
m AS (SELECT {means} FROM a),
p AS (SELECT {strengths} FROM m),
v AS (SELECT h.host, greatest({worst}) > {HOST_LIMIT} AS host_rejected FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_few_words OR fail_repetitive AS base_failed, host_rejected,
       NOT ({own}) AND NOT host_rejected AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host"""


SQL = _sql()
