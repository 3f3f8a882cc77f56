"""Files and requests at the edge, settings, calls of a model, and what is written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import strip
from ..functions.shapes import PRETTY, child, is_object, json_text, kind_of, strict_json
from ..functions.text import let
from .contract import RESULT

# Limits of files, requests, settings and log lines, and the codes of errors with their status and whether to try again.
MOST_FILE, SIGNATURE, HEAD = 10 * 1024 * 1024, "%PDF-", 1_024
MOST_PAGE_CHARS, MOST_CHARS, MOST_BODY, LEAST_LETTERS = 20_000, 64_000, 262_144, 200
SETTINGS = {"max_body_bytes": ("int", 262_144, 1_024, 1_048_576), "timeout_seconds": ("double", 40.0, 1.0, 60.0), "total_seconds": ("double", 55.0, 1.0, 90.0), "max_tokens": ("int", 2_048, 256, 4_096)}
LOGGED = ("label", "attempt", "outcome", "ms", "promptTokens", "completionTokens", "finishReason", "outputBytes", "providerCode")
LOGGED_EVENT = (
    "event", "outcome", "status", "ms", "attempts", "pageCount", "pagesWithoutText", "textChars", "model", "promptVersion", "modelCallsStarted", "modelCallsCompleted", "usageReportedCalls", "usageComplete", "reportedPromptTokens",
    "reportedCompletionTokens", "mode", "chunks", "duplicateFacts", "ocrPages",
)
MOST_PROBLEMS, MOST_PROBLEM = 10, 160
NO_JSON, NO_OBJECT = "response is not valid JSON", "response must be a JSON object"
MODEL, OWN_ORIGINS = "@cf/meta/llama-3.3-70b-instruct-fp8-fast", ("http://localhost:5173", "http://127.0.0.1:5173")
ERRORS = (
    ("INVALID_REQUEST", 400, False), ("ORIGIN_NOT_ALLOWED", 403, False), ("BODY_TOO_LARGE", 413, False), ("DOCUMENT_TOO_LONG", 413, False), ("UNSUPPORTED_MEDIA_TYPE", 415, False),
    ("TOO_MANY_CANDIDATES", 422, False), ("NO_TEXT_LAYER", 422, False), ("INSUFFICIENT_CONTENT", 422, False), ("RATE_LIMITED", 429, True), ("AI_INVALID_OUTPUT", 502, True),
    ("AI_UNAVAILABLE", 502, True), ("AI_QUOTA_EXCEEDED", 503, True), ("SERVICE_MISCONFIGURED", 503, False), ("AI_TIMEOUT", 504, True), ("INTERNAL_ERROR", 500, True),
)
# End of the fixed values.


def file_problem(name: Column, size: Column, mime: Column) -> Column:
    """empty, not-pdf or too-large, whichever comes first; null for a file that may be read."""
    looks = F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(name.rlike(r"(?i)\.pdf\z"), F.lit(False))
    return F.when(size == 0, "empty").when(~looks, "not-pdf").when(size > MOST_FILE, "too-large")


def has_signature(content: Column) -> Column:
    """Whether a file's first bytes hold the mark of its format."""
    return F.decode(F.substring(content, 1, HEAD), "ISO-8859-1").contains(SIGNATURE)


def bounded(body: Column, limit: int = MOST_BODY) -> Column:
    """Struct (body, too_large): no more than the limit and one byte is kept."""
    return F.struct(F.substring(body, 1, limit + 1).alias("body"), (F.octet_length(body) > limit).alias("too_large"))


def client_problem(totals: DataFrame, body_bytes: Column) -> DataFrame:
    """totals (doc_id, n_pages, total_chars, total_letters, longest, blank_pages) with problem: what a client finds first, before sending."""
    problem = (
        F.when(F.col("blank_pages") == F.col("n_pages"), "no-text-layer").when(F.col("longest") > MOST_PAGE_CHARS, "page-too-long")
        .when((F.col("total_chars") > MOST_CHARS) | (body_bytes > MOST_BODY), "document-too-long").when(F.col("total_letters") < LEAST_LETTERS, "insufficient-content")
    )
    return totals.withColumn("problem", problem)


def setting(raw: Column, name: str) -> Column:
    """A setting's value: the default where it is missing or no number, and within its bounds."""
    kind, default, low, high = SETTINGS[name]
    return F.greatest(F.least(F.coalesce(F.trim(raw).try_cast(kind), F.lit(default)), F.lit(high)), F.lit(low)).cast(kind)


def error_codes(spark: SparkSession) -> DataFrame:
    """(code, status, retryable)."""
    return spark.createDataFrame([*ERRORS], "code string, status int, retryable boolean")


def answer(raw: Column) -> Column:
    """Struct (payload, problem) of a provider's answer: the JSON object that it holds, in either style or as it is, or why there is none.

    An answer with a response is that, whatever it is; without one, it is the content of its first choice's message, where there is such a message.
    Text inside is read as JSON once more. Anything but an object is refused.
    """

    def told(whole: Column) -> Column:
        said = F.struct(child(whole, "response").alias("response"), child(whole, "choices[0].message").alias("message"))
        # only objects have fields, so the kind of a whole answer need not be worked out
        return let(said, lambda p: F.when(p["response"].isNotNull(), p["response"]).when(is_object(p["message"]), child(p["message"], "content")).otherwise(whole))

    def read(found: Column) -> Column:
        text = F.when(~is_object(found), F.when(kind_of(found) == "STRING", child(found, "", "string")))
        return let(text, lambda t: let(strict_json(t), lambda inner: F.struct(F.when(t.isNull(), found).otherwise(inner).alias("inner"), F.when(t.isNotNull() & inner.isNull(), NO_JSON).alias("lost"))))

    def judged(r: Column) -> Column:
        return let(is_object(r["inner"]), lambda whole: F.struct(F.when(whole, r["inner"]).alias("payload"), F.coalesce(r["lost"], F.when(~whole, NO_OBJECT)).alias("problem")))

    def of(whole: Column) -> Column:
        return F.when(whole.isNull(), F.struct(F.lit(None).cast("variant").alias("payload"), F.lit(NO_JSON).alias("problem"))).otherwise(let(let(told(whole), read), judged))

    return let(strict_json(raw), of)


def payload(raw: Column) -> Column:
    """The JSON object of a model's answer, or null if there is none."""
    return answer(raw)["payload"]


def strict_type(value: Column, path: str) -> Column:
    """The type that a field is written in, such as BIGINT, STRING or BOOLEAN; null where it is missing. Nothing is converted."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def call_usage(calls: DataFrame) -> DataFrame:
    """(doc_id, started, completed, reported, complete, prompt_tokens, completion_tokens) of calls (doc_id, completed, prompt_tokens, completion_tokens):
    usage that one call does not report in full is unknown, not zero."""
    told = F.col("completed") & (F.col("prompt_tokens") >= 0) & (F.col("completion_tokens") >= 0)
    counted = calls.groupBy("doc_id").agg(F.count(F.lit(1)).alias("started"), F.count_if("completed").alias("completed"), F.count_if(told).alias("reported"), *[F.coalesce(F.sum(F.when(told, F.col(c))), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")])
    return counted.select("doc_id", "started", "completed", "reported", (F.col("started") == F.col("reported")).alias("complete"), "prompt_tokens", "completion_tokens")


def _may_be_logged(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The named columns that hold text, whole numbers or flags."""
    plain = ("string", "boolean", "tinyint", "smallint", "int", "bigint")
    return [c for c in names if dict(rows.dtypes).get(c) in plain]


def log_lines(calls: DataFrame) -> DataFrame:
    """Calls as they may be logged: named fields of plain types only, and the first problems, cut short."""
    problems = F.transform(F.slice("problems", 1, MOST_PROBLEMS), lambda p: F.substring(p, 1, MOST_PROBLEM))
    return calls.select(F.lit("model_call").alias("event"), *_may_be_logged(calls, LOGGED), F.when(F.size("problems") > 0, problems).alias("problems"))


def event_lines(requests: DataFrame) -> DataFrame:
    """(line): requests as JSON lines for the log, of the named fields of plain types; what is null is left out."""
    return requests.select(F.to_json(F.struct(*_may_be_logged(requests, LOGGED_EVENT))).alias("line"))


def result_text(result: Column) -> Column:
    """A result (a JSON value of the shape RESULT) as it is saved: indented, and a line end."""
    return F.concat(json_text(result, RESULT, PRETTY), F.lit("\n"))


def result_digest(result: Column) -> Column:
    """SHA-256 of a result's canonical text: keys in order, no blanks, numbers that read back as themselves."""
    return F.sha2(json_text(result, RESULT).cast("binary"), 256)


def settings(given: Column) -> Column:
    """Struct of all settings of a map of strings: what is missing or no number takes its default, numbers are held within their bounds, and anything but
    an explicit development is production."""
    of = lambda name: F.try_element_at(given, F.lit(name))
    development = F.coalesce(of("ENVIRONMENT") == "development", F.lit(False))
    listed = F.transform(F.split(F.coalesce(of("ALLOWED_ORIGINS"), F.lit("")), ","), lambda o: F.regexp_replace(strip(o), r"/+\z", ""))
    origins = F.concat(F.filter(listed, lambda o: o != ""), F.when(development, F.array(*map(F.lit, OWN_ORIGINS))).otherwise(F.array().cast("array<string>")))
    numbers = {"max_body_bytes": "MAX_BODY_BYTES", "timeout_seconds": "AI_TIMEOUT_SECONDS", "total_seconds": "AI_TOTAL_BUDGET_SECONDS", "max_tokens": "AI_MAX_TOKENS"}
    mode, model = F.when(of("AI_MODE").isin("chunked", "compact"), of("AI_MODE")).otherwise("single"), F.coalesce(F.nullif(of("AI_MODEL"), F.lit("")), F.lit(MODEL))
    return F.struct(
        F.when(development, "development").otherwise("production").alias("environment"), F.array_sort(F.array_distinct(origins)).alias("allowed_origins"), model.alias("model"), mode.alias("mode"),
        *[setting(of(raw), name).alias(name) for name, raw in numbers.items()],
    )
