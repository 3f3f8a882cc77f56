"""Rules of a result, as columns: the names of the fields that break one, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codes import is_currency, is_language
from ..functions.sentences import sentences_within

# Limits of a result and its document types.
MOST_FACT, MOST_TITLE, MOST_NAME, MOST_SUMMARY, MOST_KEYWORDS = 500, 300, 255, 2_000, 20
SENTENCES, KEY_POINTS = (3, 5), (3, 7)
TYPES = ("faktura", "umowa", "oferta", "raport", "inne")
# End of the fixed values.

SCHEMA = """file_name string, pages int, language string, type string, title string, date string, summary string, key_points array<string>,
organizations array<string>, people array<string>, amounts array<struct<value:double,currency:string,context:string>>, dates array<struct<date:string,context:string>>,
keywords array<string>, complete boolean, pages_without_text array<int>, ocr_pages array<int>"""


def is_text(value: Column, most: int) -> Column:
    """Neither null nor blank, and not longer than `most` characters."""
    return value.isNotNull() & F.char_length(value).between(1, most) & value.rlike(r"(?U)\S")


def is_iso_date(value: Column) -> Column:
    """A calendar date of year 1 or later, written YYYY-MM-DD."""
    day = F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(day >= F.lit("0001-01-01").cast("date"), F.lit(False))


def _all(values: Column, test) -> Column:
    return values.isNotNull() & F.coalesce(F.forall(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def _page_list(values: Column, pages: Column) -> Column:
    return (F.array_sort(F.array_distinct(values)) == values) & F.forall(values, lambda p: (p >= 1) & (p <= pages))


def consistent(pages: Column, complete: Column, without_text: Column, ocr: Column) -> Column:
    """Pages without text are ascending and exist; complete says that there are none; recognised pages are ascending, exist and have text."""
    read = ocr.isNull() | ((F.size(ocr) > 0) & _page_list(ocr, pages) & ~F.arrays_overlap(ocr, without_text))
    return _page_list(without_text, pages) & (complete == (F.size(without_text) == 0)) & read


def result_problems(row: Column | None = None) -> Column:
    """Array of the fields of a row in SCHEMA, or of a struct with its fields, that break a rule."""
    c = F.col if row is None else row.getField
    fact = lambda v: is_text(v, MOST_FACT)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rules = {
        "document.fileName": is_text(c("file_name"), MOST_NAME),
        "document.pages": c("pages") >= 1,
        "document.language": is_language(c("language")),
        "document.type": c("type").isin(*TYPES),
        "document.title": is_text(c("title"), MOST_TITLE),
        "document.date": c("date").isNull() | is_iso_date(c("date")),
        "summary": is_text(c("summary"), MOST_SUMMARY) & sentences_within(c("summary"), *SENTENCES),
        "keyPoints": _all(c("key_points"), fact) & F.size(c("key_points")).between(*KEY_POINTS),
        "entities.organizations": _all(c("organizations"), fact),
        "entities.people": _all(c("people"), fact),
        "amounts": _all(c("amounts"), lambda a: finite(a["value"]) & is_currency(a["currency"]) & fact(a["context"])),
        "dates": _all(c("dates"), lambda d: is_iso_date(d["date"]) & fact(d["context"])),
        "keywords": _all(c("keywords"), fact) & (F.size(c("keywords")) <= MOST_KEYWORDS),
        # a result need not say anything of its pages
        "analysis": c("complete").isNull() | consistent(c("pages"), c("complete"), c("pages_without_text"), c("ocr_pages")),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def name_is_safe(name: Column) -> Column:
    """A file name of a request: no control characters, no separators of paths."""
    return is_text(name, MOST_NAME) & ~name.rlike(r"[\x00-\x1f\x7f/\\]")
