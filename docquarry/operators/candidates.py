"""Running headers and footers, and numbered candidates of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_letter, let
from .tokens import amounts_of, date_tokens, is_cell, joined, marked_numbers, wraps_of

# Marks of a page number or a version in a running line, and limits.
MARKER = r"(?iuU)\b(?:strona|str\.|page|seite)\s*#+\s*(?:z|of|/|von)\s*#+|\b(?:wersja|version|ver\.|rev\.?)\s*#"
EDGE_LINES, LEAST_PAGES, MOST_CANDIDATES = 2, 3, 400
# End of the fixed values.


#: What a page's text must hold for any of its lines to have a marker; digits are not folded there yet, and the first letters are looked at first, in either case.
_MARKED = "(?=[spvwrSPVWR\u017f])" + MARKER.replace("#", "[0-9]").replace("(?iuU)", "(?iuU:", 1) + ")"
_OWN = ("doc_id", "page", "start", "end", "text", "kind_no", "value", "currency", "date", "spans")


def edge_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end, line): the first and last non-blank lines of each page, within the row."""
    lines = F.filter(
        F.aggregate(
            F.split("text", "\n"),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,line:string>>").alias("lines")),
            lambda acc, x: F.struct((acc["at"] + F.char_length(x) + 1).alias("at"), F.concat(acc["lines"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(x)).alias("end"), x.alias("line")))).alias("lines")),
            lambda acc: acc["lines"],
        ),
        lambda x: x["line"].rlike(r"(?U)\S"),
    )
    n = F.size("_lines")
    ends = F.array_distinct(F.concat(F.slice("_lines", 1, EDGE_LINES), F.slice("_lines", F.greatest(n - EDGE_LINES + 1, F.lit(1)), F.lit(EDGE_LINES))))
    return pages.filter(has_letter(F.col("text"))).withColumn("_lines", lines).select("doc_id", "page", F.explode(ends).alias("e")).select("doc_id", "page", "e.start", "e.end", "e.line")


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end): edge lines that repeat on LEAST_PAGES pages with the same dates each time."""
    # hardly any page has a marker, and only lines of such pages are cut and compared
    lines = edge_lines(pages.filter(F.col("text").rlike(_MARKED)))
    key = F.regexp_replace(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")), "[0-9]+", "#")
    lines = lines.withColumn("key", key).filter(F.col("key").rlike(MARKER))
    # the dates of a line are found in the line itself, so no join with the page's dates is needed
    lines = lines.withColumn("set", F.array_join(F.array_sort(F.array_distinct(F.transform(date_tokens(F.col("line")), lambda d: d["date"].cast("string")))), ","))
    # lines with the same key are kept beside their number, so that pages are read once
    span = F.struct("page", "start", "end")
    running = lines.groupBy("doc_id", "key").agg(F.collect_list(span).alias("spans"), F.min("set").alias("a"), F.max("set").alias("b")).filter("a = b")
    return running.filter(F.size(F.array_distinct("spans.page")) >= LEAST_PAGES).select("doc_id", F.inline("spans"))


def candidates(pages: DataFrame) -> DataFrame:
    """(doc_id, candidate_id, kind, page, start, end, text, value, currency, date, too_many) in reading order.

    Amounts need a currency beside them, or one that the page declares and two decimals. Tokens in running lines
    are left out. A document with more than MOST_CANDIDATES fails as a whole: too_many is true in all its rows.
    """
    return numbered(tokens(pages), pages).drop("before", "after")


def token_structs(text: Column) -> Column:
    """Array of (start, end, text, kind_no, value, currency, date, before, after): what may become a candidate."""
    return let(F.struct(marked_numbers(text, worth=True).alias("numbers"), date_tokens(text).alias("days")), lambda v: _structs(text, v["numbers"], v["days"]))


def line_number(text: Column, start: Column) -> Column:
    """The line, counted from 0, that an offset of a text stands in."""
    return let(F.substring(text, F.lit(1), start), lambda head: F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))))


def tokens_and_cells(text: Column) -> Column:
    """Struct (found, cells, wraps): token_structs(), the line, counted from 0, of each amount with a currency in its line or with cents and of each date
    within a line, and (start, end) of the numbers that go on in the next line."""

    def both(v: Column) -> Column:
        line_no = lambda t: line_number(text, t["start"])
        cells = F.concat(F.transform(F.filter(v["numbers"], is_cell), line_no), F.transform(F.filter(v["days"], lambda d: ~d["text"].contains("\n")), line_no))
        wraps = F.transform(joined(v["wraps"]), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))
        return F.struct(_structs(text, v["numbers"], v["days"], v["wraps"]).alias("found"), cells.alias("cells"), wraps.alias("wraps"))

    return let(F.struct(marked_numbers(text, worth=True).alias("numbers"), date_tokens(text).alias("days"), wraps_of(text).alias("wraps")), both)


def _structs(text: Column, numbers: Column, days: Column, wraps: Column | None = None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)

    def shaped(t: Column, kind_no: int, value: Column, currency: Column, date: Column, before: Column, after: Column) -> Column:
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"), F.lit(kind_no).alias("kind_no"), value.alias("value"), currency.alias("currency"), date.alias("date"), before.alias("before"), after.alias("after"))

    money = F.transform(amounts_of(text, numbers, True, wraps), lambda t: shaped(t, 0, t["value"], t["currency"], none("date"), t["before"], t["after"]))
    dated = F.transform(days, lambda t: shaped(t, 1, none("decimal(38,2)"), none("string"), t["date"], F.lit(0), F.lit(0)))
    return F.concat(money, dated)


def tokens(pages: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, page, start, end, text, kind_no, value, currency, date, before, after) and more of the pages: what may become a candidate."""
    return pages.filter(has_letter(F.col("text"))).select("doc_id", "page", *more, F.inline(let(F.col("text"), token_structs)))


def numbered(found: DataFrame, pages: DataFrame) -> DataFrame:
    """tokens() without those in running lines, as candidates; columns beyond the tokens' own are kept."""
    # spans meet tokens by document, as the numbering needs them, so tokens are moved once
    spans = running_lines(pages).groupBy("doc_id").agg(F.collect_list(F.struct("page", "start", "end")).alias("spans"))
    found = found.join(spans, "doc_id", "left")
    inside = F.exists("spans", lambda s: (s["page"] == F.col("page")) & (s["start"] <= F.col("start")) & (F.col("start") < s["end"]))
    found = found.filter(~F.coalesce(inside, F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("page", "start", "kind_no")
    return found.select(
        "doc_id", F.row_number().over(order).alias("candidate_id"), F.when(F.col("kind_no") == 0, "amount").otherwise("date").alias("kind"), "page", "start", "end", "text", "value", "currency", "date",
        (F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > MOST_CANDIDATES).alias("too_many"), *[c for c in found.columns if c not in _OWN],
    )
