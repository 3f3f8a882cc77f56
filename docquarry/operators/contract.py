"""Shapes of what comes in and goes out: requests, a model's answers, results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codes import is_currency, is_language
from ..functions.sentences import sentences_within
from ..functions.shapes import Flag, Many, Number, Record, Text, Whole, child, filled, items
from ..functions.text import has_letter
from .validation import KEY_POINTS, MOST_FACT, MOST_KEYWORDS, MOST_NAME, MOST_SUMMARY, MOST_TITLE, SENTENCES, TYPES, consistent, is_iso_date

# Limits of requests and quotes, enumerations, and messages of values that break a rule.
MOST_PAGES, MOST_PAGE_CHARS, MOST_EVIDENCE = 500, 20_000, 300
BASES, PERIODS = ("net", "gross", "vat", "unspecified"), ("one-off", "monthly", "yearly", "daily", "other", "unspecified")
STATUSES = ("current", "rejected", "historical", "proposed", "estimated", "budget", "maximum", "unspecified")
NO_DATE, NO_DAY = "Value error, must be an ISO 8601 date YYYY-MM-DD", "Value error, must be a valid calendar date"
NO_LANGUAGE, NO_CURRENCY = "Value error, must be a lowercase ISO 639-1 code", "Value error, must be an uppercase ISO 4217 code"
NO_SUMMARY, NO_FILE_NAME = "Value error, must contain 3-5 sentences ending with punctuation", "Value error, must not contain control characters or path separators"
PAGE_COUNT, PAGE_ORDER, BLANK_PAGES = "pages must contain exactly pageCount items", "page numbers must be 1..pageCount in order", "pagesWithoutText does not match page texts"
READ_PAGES = "ocrPages must be ascending, unique pages that have text"
NO_COVERAGE = "the pages named by the analysis do not agree"
# End of the fixed values.


def _one_of(values: tuple[str, ...]) -> Text:
    quoted = [f"'{v}'" for v in values]
    return Text(tests=((lambda s: s.isin(*values), f"Input should be {', '.join(quoted[:-1])} or {quoted[-1]}"),))


ISO_DATE = ((lambda s: s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), NO_DATE), (is_iso_date, NO_DAY))
LANGUAGE, CURRENCY = Text(tests=((is_language, NO_LANGUAGE),)), Text(tests=((is_currency, NO_CURRENCY),))
FACT = filled(MOST_FACT)
STRINGS = Many(Text())
SINGLE = Record(
    {
        "insufficientContent": Flag(), "language": Text(), "type": Text(), "title": Text(nullable=True), "date": Text(nullable=True), "summary": Text(), "keyPoints": STRINGS, "organizations": STRINGS, "people": STRINGS,
        "amounts": Many(Record({"value": Number(), "currency": Text(), "context": Text()})), "dates": Many(Record({"date": Text(), "context": Text()})), "keywords": STRINGS,
    }
)
COMPACT = Record(
    {
        "insufficientContent": Flag(), "language": Text(), "type": Text(), "title": Text(nullable=True), "mainDateId": Whole(nullable=True), "summary": Text(), "keyPoints": STRINGS, "organizations": STRINGS, "people": STRINGS,
        "keywords": STRINGS, "amountIds": Many(Whole()), "dateIds": Many(Whole()),
    }
)
CHUNK = Record(
    {
        "amounts": Many(Record({"value": Number(), "currency": Text(3, 3), "basis": _one_of(BASES), "period": _one_of(PERIODS), "status": _one_of(STATUSES), "context": FACT, "page": Whole(1), "evidence": filled(MOST_EVIDENCE)})),
        "dates": Many(Record({"date": Text(tests=ISO_DATE), "event": FACT, "page": Whole(1), "evidence": filled(MOST_EVIDENCE)})), "organizations": STRINGS, "people": STRINGS, "keywords": STRINGS,
    }
)


def _wholes(value: Column, name: str) -> Column:
    return child(value, name, "array<int>")


def page_structs(request: Column) -> Column:
    """Array of (page, text) of a request of the right shape."""
    return F.transform(items(child(request, "pages")), lambda p: F.struct(child(p, "page", "int").alias("page"), child(p, "text", "string").alias("text")))


def _blank(request: Column) -> Column:
    return F.transform(F.filter(page_structs(request), lambda p: ~has_letter(p["text"])), lambda p: p["page"])


def _read_pages(request: Column) -> Column:
    read, count, blank = _wholes(request, "ocrPages"), child(request, "pageCount", "int"), _wholes(request, "pagesWithoutText")
    return read.isNull() | ((F.array_sort(F.array_distinct(read)) == read) & F.forall(read, lambda p: p.between(1, count)) & ~F.arrays_overlap(read, blank))


REQUEST = Record(
    {
        "fileName": filled(MOST_NAME, (lambda s: ~s.rlike(r"[\x00-\x1f\x7f/\\]"), NO_FILE_NAME)), "pageCount": Whole(1, MOST_PAGES), "pages": Many(Record({"page": Whole(1), "text": Text(0, MOST_PAGE_CHARS)}, closed=True), 0, MOST_PAGES),
        "pagesWithoutText": Many(Whole(), 0, MOST_PAGES), "ocrPages": Many(Whole(), 0, MOST_PAGES),
    },
    closed=True, optional=("ocrPages",),
    rules=(
        (lambda r: F.size(items(child(r, "pages"))) == child(r, "pageCount", "int"), PAGE_COUNT),
        (lambda r: F.transform(page_structs(r), lambda p: p["page"]) == F.sequence(F.lit(1), child(r, "pageCount", "int")), PAGE_ORDER),
        (lambda r: _wholes(r, "pagesWithoutText") == _blank(r), BLANK_PAGES),
        (_read_pages, READ_PAGES),
    ),
)


def _covered(result: Column) -> Column:
    info = child(result, "analysis")
    own = lambda name, kind: F.try_variant_get(result, f"$.analysis.{name}", kind)
    ok = consistent(F.try_variant_get(result, "$.document.pages", "int"), own("complete", "boolean"), own("pagesWithoutText", "array<int>"), own("ocrPages", "array<int>"))
    return info.isNull() | F.is_variant_null(info) | ok


RESULT = Record(
    {
        "document": Record({"fileName": filled(MOST_NAME), "pages": Whole(1), "language": LANGUAGE, "type": _one_of(TYPES), "title": filled(MOST_TITLE), "date": Text(tests=ISO_DATE, nullable=True)}, closed=True),
        "summary": filled(MOST_SUMMARY, (lambda s: sentences_within(s, *SENTENCES), NO_SUMMARY)), "keyPoints": Many(FACT, *KEY_POINTS), "entities": Record({"organizations": Many(FACT), "people": Many(FACT)}, closed=True),
        "amounts": Many(Record({"value": Number(), "currency": CURRENCY, "context": FACT}, closed=True)), "dates": Many(Record({"date": Text(tests=ISO_DATE), "context": FACT}, closed=True)), "keywords": Many(FACT, 0, MOST_KEYWORDS),
        "analysis": Record({"complete": Flag(), "pagesWithoutText": Many(Whole()), "titleFallback": Flag(), "ocrPages": Many(Whole(), 1, nullable=True)}, closed=True, optional=("ocrPages",), nullable=True),
    },
    closed=True, optional=("analysis",), rules=((_covered, NO_COVERAGE),),
)


def result_value(result: Column) -> Column:
    """A row in validation.SCHEMA, with title_fallback, as the JSON value that goes out. An absent list of recognised pages is left out, an absent date is not."""
    r = lambda name: result[name]
    analysis = F.struct(r("complete").alias("complete"), r("pages_without_text").alias("pagesWithoutText"), r("title_fallback").alias("titleFallback"))
    read = F.struct(r("complete").alias("complete"), r("pages_without_text").alias("pagesWithoutText"), r("title_fallback").alias("titleFallback"), r("ocr_pages").alias("ocrPages"))

    def whole(info: Column) -> Column:
        document = F.struct(r("file_name").alias("fileName"), r("pages").alias("pages"), r("language").alias("language"), r("type").alias("type"), r("title").alias("title"), r("date").alias("date"))
        parts = {"document": document, "summary": r("summary"), "keyPoints": r("key_points"), "entities": F.struct(r("organizations").alias("organizations"), r("people").alias("people")), "amounts": r("amounts"), "dates": r("dates"), "keywords": r("keywords"), "analysis": info}
        return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "false"})

    return F.try_parse_json(F.when(r("ocr_pages").isNull(), whole(analysis)).otherwise(whole(read)))


def result_columns(value: Column) -> list[Column]:
    """The columns of validation.SCHEMA of a JSON value of the shape RESULT."""
    get = lambda path, kind, name: F.try_variant_get(value, f"$.{path}", kind).alias(name)
    return [
        get("document.fileName", "string", "file_name"), get("document.pages", "int", "pages"), get("document.language", "string", "language"), get("document.type", "string", "type"), get("document.title", "string", "title"), get("document.date", "string", "date"),
        get("summary", "string", "summary"), get("keyPoints", "array<string>", "key_points"), get("entities.organizations", "array<string>", "organizations"), get("entities.people", "array<string>", "people"),
        get("amounts", "array<struct<value:double,currency:string,context:string>>", "amounts"), get("dates", "array<struct<date:string,context:string>>", "dates"), get("keywords", "array<string>", "keywords"),
        get("analysis.complete", "boolean", "complete"), get("analysis.pagesWithoutText", "array<int>", "pages_without_text"), get("analysis.ocrPages", "array<int>", "ocr_pages"),
    ]
