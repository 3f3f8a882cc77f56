"""Amounts and dates in text, with offsets, as columns and as rows of pages (doc_id, page, text). Nothing is shuffled here.

Each form is only looked for in texts that a cheap pattern finds worth it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import currency_code
from ..functions.text import let, matches

# Number forms, currency words and month names that results depend on.
_TAIL = r"(?![0-9]|[.,][0-9]|[  ]?%)"
_HEAD = r"(?<![0-9.,])"
_SPACED = r"[0-9]{1,3}(?:[   ][0-9]{3})"
NUMBER = _HEAD + "(?:" + "|".join([_SPACED + r"+(?:,[0-9]{1,2})?", r"[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{1,2}", r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,2})?", r"[0-9]+,[0-9]{1,2}", r"[0-9]+\.[0-9]{1,2}", r"[0-9]+"]) + ")" + _TAIL
WRAPPED = _HEAD + _SPACED + r"*[ \t]*\n[ \t]*[0-9]{3}(?:[   ][0-9]{3})*(?:,[0-9]{1,2})?" + _TAIL
REFERENCE = r"(?iU)(?:\b(?:strona|str|s|z|nr|no|page|of|pkt|ust|art|poz|lp)\.?|§)\s*\z"
AFTER = r"^[  ]*(?:\n[  ]*)?(zł|złotych|PLN|EUR|euro|€|USD|\$|[A-Z]{3})(?![\p{L}\p{N}_])"
BEFORE = r"(PLN|EUR|€|USD|\$|[A-Z]{3})[  ]*\n?\z"
DECLARED = r"(?U)\b(?:Waluta|Currency)\s*:\s*([A-Z]{3})\b"
PL_MONTHS = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia"
EN_MONTHS = "january february march april may june july august september october november december"
# End of the fixed values.

WRAP_LINE, WRAP_WORDS = 60, 3
#: The end of an amount that has cents.
CENTS = r"[.,][0-9]{2}\z"
_MONTHS = PL_MONTHS.split() + EN_MONTHS.split()
_ANY_MONTH = "|".join(_MONTHS)
#: NUMBER, with places that do not begin with a digit left at once.
_NUMBER = "(?=[0-9])" + NUMBER
_BLANKS = "[ \u00a0]"
#: Of these, the ones with cents or with what may be a currency beside them: a number is taken whole or not at all, and what begins inside of one that is left
#: out ends where that ends and has digits before it, so it is left out as well.
_WORTH = (
    rf"(?=[0-9])(?<![0-9.,])(?:(?<=(?:[A-Z]{{3}}|[€$]){_BLANKS}{{0,6}}\n?)(?>{NUMBER})|(?>({_NUMBER}))(?:(?<=[.,][0-9]{{2}})|(?={_BLANKS}*(?:\n{_BLANKS}*)?(?:zł|euro|[€$]|[A-Z]{{3}}))))"
)
#: What a date with a month's name looks like, whichever way it goes.
_NAMED = r"(?U)[0-9](?:,|\s+\p{L}{3,}\s)\s*[0-9]{4}"
#: What a text must hold, the form, its parts, and which of these are year, month and day.
_DATES = (
    ("[0-9]", r"(?=[0-9])(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", r"([0-9]{4})-([0-9]{2})-([0-9]{2})", (1, 2, 3)),
    ("[0-9]", r"(?=[0-9])(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])", r"([0-9]+)\.([0-9]+)\.([0-9]+)", (3, 2, 1)),
    (_NAMED, rf"(?iuU)(?<![0-9])[0-9]{{1,2}}\s+(?:{_ANY_MONTH})\s+[0-9]{{4}}(?![0-9])", r"(?U)([0-9]+)\s+(\S+)\s+([0-9]+)", (3, 2, 1)),
    (_NAMED, rf"(?iuU)\b(?:{_ANY_MONTH})\s+[0-9]{{1,2}},\s*[0-9]{{4}}(?![0-9])", r"(?U)(\S+)\s+([0-9]+),\s*([0-9]+)", (3, 1, 2)),
)


def parse_number(raw: Column) -> Column:
    """DECIMAL(38,2) of a number as written, or null."""
    bare = F.regexp_replace(raw, r"[   ]", "")
    point = F.when(bare.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+,"), F.translate(bare, ",.", ".")).when(bare.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.|\z)"), F.translate(bare, ",", "")).otherwise(F.translate(bare, ",", "."))
    return point.try_cast("decimal(38,2)")


def wraps_of(text: Column) -> Column:
    """Numbers over a line end: (start, end, text, joined); joined: whether they are one number."""

    def judged(m: Column) -> Column:
        line = F.substring_index(F.substring(text, F.lit(1), m["start"]), "\n", -1)
        prefix = F.regexp_extract(m["text"], r"^([^\n]*?)[ \t]*\n", 1)
        whole = F.char_length(line) + F.char_length(prefix)
        words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")))
        suffix = F.regexp_extract(m["text"], r"\n[ \t]*(.*)\z", 1)
        joined = (whole >= WRAP_LINE) & (words >= WRAP_WORDS) & ~line.rlike(REFERENCE)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(prefix, F.lit(" "), suffix).alias("text"), joined.alias("joined"))

    return F.when(text.rlike(r"[0-9][ \t]*\n[ \t]*[0-9]{3}"), F.transform(matches(text, WRAPPED), lambda m: judged(m))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,joined:boolean>>"))


def joined(wraps: Column) -> Column:
    return F.transform(F.filter(wraps, lambda w: w["joined"]), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text")))


def wrapped_numbers(text: Column) -> Column:
    """Array of (start, end, text) of the numbers that go on in the next line."""
    return let(wraps_of(text), _joined)


def _behind(text: Column, t: Column) -> Column:
    return F.regexp_extract(F.substring(text, t["end"] + 1, F.lit(12)), AFTER, 0)


def _ahead(text: Column, t: Column) -> Column:
    return F.regexp_extract(F.substring(text, F.greatest(t["start"] - 5, F.lit(1)), F.least(t["start"], F.lit(6))), BEFORE, 0)


def _code(marked: Column, shape: str) -> Column:
    """ISO code of what a shape found, or null; most numbers have no marker on one side, or on both."""
    return F.when(marked != "", let(F.regexp_extract(marked, shape, 1), lambda m: currency_code(m)))


def _written(t: Column) -> Column:
    """A number that can be an amount by how it is written."""
    return ~t["text"].rlike("^0[0-9]")


def marked_numbers(text: Column, numbers: Column | None = None, worth: bool = False) -> Column:
    """Array of (start, end, text, after, before, a, b) of all numbers, also over line ends, or of those given: the markers behind and before them, and their
    codes. worth: only numbers with cents or with a marker, and maybe others."""
    found = F.when(text.rlike("[0-9]"), matches(text, _WORTH if worth else _NUMBER)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")) if numbers is None else numbers

    def beside(t: Column) -> Column:
        markers = F.struct(_behind(text, t).alias("after"), _ahead(text, t).alias("before"))
        return let(markers, lambda m: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"), m["after"].alias("after"), m["before"].alias("before"), _code(m["after"], AFTER).alias("a"), _code(m["before"], BEFORE).alias("b")))

    return F.transform(F.filter(found, _written), beside)


def is_cell(m: Column) -> Column:
    """A marked number with cents, or with a currency on its own line."""
    own = lambda code, marked: code.isNotNull() & ~marked.contains("\n")
    return m["text"].rlike(CENTS) | own(m["a"], m["after"]) | own(m["b"], m["before"])


def amounts_of(text: Column, marked: Column, usable: bool = False, wraps: Column | None = None) -> Column:
    """amount_tokens() of a text whose marked numbers, and numbers over line ends where they are known, are given. usable: only amounts with a currency, beside
    them or, where they have cents, declared by the page; other numbers are not read then."""
    declared = F.when(text.contains("Waluta") | text.contains("Currency"), currency_code(F.regexp_extract(text, DECLARED, 1)))

    def token(m: Column, page: Column) -> Column:
        near = F.coalesce(m["a"], m["b"])
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), parse_number(m["text"]).alias("value"), F.coalesce(near, page).alias("currency"), near.isNotNull().alias("adjacent"),
            F.when(m["a"].isNull() & m["b"].isNotNull(), F.char_length(m["before"])).otherwise(0).alias("before"), F.when(m["a"].isNotNull(), F.char_length(m["after"])).otherwise(0).alias("after"),
        )

    def found(v: Column) -> Column:
        alone = F.filter(marked, lambda n: ~F.exists(v["wraps"], lambda w: (n["start"] >= w["start"]) & (n["start"] < w["end"])))
        kept = F.when(F.size(v["wraps"]) == 0, marked).otherwise(F.concat(alone, marked_numbers(text, joined(v["wraps"]))))
        if usable:
            kept = F.filter(kept, lambda m: m["a"].isNotNull() | m["b"].isNotNull() | (v["declared"].isNotNull() & m["text"].rlike(CENTS)))
        return F.transform(kept, lambda m: token(m, v["declared"]))

    return let(F.struct((wraps_of(text) if wraps is None else wraps).alias("wraps"), declared.alias("declared")), found)


def amount_tokens(text: Column) -> Column:
    """Array of (start, end, text, value, currency, adjacent, before, after): before and after are the lengths of a currency beside it.

    A number that goes on in the next line is one amount where its line is prose; elsewhere both parts are left out.
    """
    return let(marked_numbers(text), lambda marked: amounts_of(text, marked))


def amounts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end, text, value, currency, adjacent): every amount of every page."""
    each = pages.select("doc_id", "page", F.explode(let(F.col("text"), amount_tokens)).alias("t"))
    return each.select("doc_id", "page", *[f"t.{c}" for c in ("start", "end", "text", "value", "currency", "adjacent")])


def _date(text: Column, shape: str, ymd: tuple[int, int, int]) -> Column:
    if ymd == (1, 2, 3):
        return text.try_cast("date")
    if ymd == (3, 2, 1) and "\\S" not in shape:
        day, month, year = F.substring_index(text, ".", 1), F.substring_index(F.substring_index(text, ".", 2), ".", -1), F.substring_index(text, ".", -1)
    else:
        year, month, day = (F.regexp_extract(text, shape, k) for k in ymd)
    if "\\S" in shape:
        number = F.array_position(F.split(F.lit(" ".join(_MONTHS)), " "), F.lower(month)).cast("int")
        month = ((number - 1) % 12 + 1).cast("string")
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def date_tokens(text: Column) -> Column:
    """Array of (start, end, text, date) of the calendar dates in a text, from year 1 on; dates that do not exist are left out."""
    none = F.array().cast("array<struct<start:int,end:int,text:string,date:date>>")
    first = F.lit("0001-01-01").cast("date")

    def valid(pattern: str, shape: str, ymd: tuple[int, int, int]) -> Column:
        each = F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), _date(m["text"], shape, ymd).alias("date")))
        return F.filter(each, lambda d: d["date"] >= first)

    # forms with the same gate are looked for behind one look at the text
    gates = dict.fromkeys(gate for gate, *_ in _DATES)
    of = lambda gate: [valid(*form) for g, *form in _DATES if g == gate]
    return F.concat(*[F.when(text.rlike(gate), F.concat(*of(gate))).otherwise(none) for gate in gates])


def dates(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end, text, date): every calendar date of every page."""
    each = pages.select("doc_id", "page", F.explode(let(F.col("text"), date_tokens)).alias("d"))
    return each.select("doc_id", "page", "d.start", "d.end", "d.text", "d.date")


def stated(facts: DataFrame, found: DataFrame) -> DataFrame:
    """facts (doc_id, value, currency) or (doc_id, date) that the source states: one of its tokens has the same value, to the cent, or date."""
    same = facts["doc_id"] == found["doc_id"]
    same &= facts["date"] == found["date"] if "date" in facts.columns else (F.bround(facts["value"], 2) == F.bround(found["value"], 2)) & (facts["currency"] == found["currency"])
    return facts.join(found, same, "left_semi")
