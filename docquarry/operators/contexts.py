"""Source context of each candidate: the table row, labelled line or sentence that it stands in, with the value marked.

A page's lines are arrays in its row: what a line is, and the header or heading above it, are judged once a line, and a candidate takes its
line's by number. Everything else is read off the page's text around the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, has_letter, let
from .candidates import line_number, numbered, tokens_and_cells
from .tokens import NUMBER

# Limits in lines and characters, capitals, currency words, ends of sentences, headings, paragraphs and marks.
WINDOW, HEADER_LINES, HEADING_LINES, SHORT_LINE, ROW, PREFIX, CONTEXT = 190, 30, 10, 80, 160, 90, 500
CAPITAL = "A-ZĄĆĘŁŃÓŚŹŻ"
CURRENCY_WORDS = ("zł", "złotych", "pln", "eur", "euro", "€", "usd", "$")
_INITIAL = rf"(?<![\s(\-][{CAPITAL}])"
SENTENCE_END = rf"{_INITIAL}[.!?;]\s+(?=[{CAPITAL}])|\n[ \t]*\n|\n(?=[ \t]*[0-9]+\.\s)"
SENTENCE_INSIDE = rf"{_INITIAL}[.!?]\s+[{CAPITAL}]"
HEADING = rf"(?U)\A\s*[{CAPITAL}]{{3,}}(?:\s+[{CAPITAL}]+)+\b"
PARAGRAPH = r"(?U)\A\s*[0-9]+\.\s"
OPEN, CLOSE, CUT = "»", "«", "…"
# End of the fixed values.

# The same forms, with the rare character looked for before what stands around it.
_NO_INITIAL = rf"(?<![\s(\-][{CAPITAL}][.!?;])"
_END = rf"(?=[.!?;\n])(?:[.!?;]{_NO_INITIAL}\s+(?=[{CAPITAL}])|\n[ \t]*\n|\n(?=[ \t]*[0-9]+\.\s))"
_INSIDE = rf"[.!?]{_NO_INITIAL}\s+[{CAPITAL}]"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)\s+", " "), " "), lambda w: w != "")


def is_row(line: Column, cells: Column) -> Column:
    """A line with a bar, or with two cells or more, money or dates, and few words beside them."""
    words = F.size(F.filter(_words(line), lambda w: has_letter(w) & ~F.lower(w).isin(*CURRENCY_WORDS)))
    return F.when(line.contains("|"), True).when(cells < 2, False).when(line.rlike(_INSIDE), False).otherwise(words <= 2 * cells + 2)


def _is_flat(line: Column) -> Column:
    """Whether a line may be a row whose cells have run together: short, and neither a paragraph nor sentences."""
    sentence = line.rlike(r"(?U)\.\s*\z") & (F.size(_words(line)) >= 8)
    return (F.char_length(line) <= ROW) & ~line.rlike(PARAGRAPH) & ~line.rlike(_INSIDE) & ~sentence


def _judged(line: Column, next_is_row: Column) -> Column:
    """Struct (text) of a line that names columns, or, with a null text, of one that no table goes on across; null for others."""
    bare = F.regexp_replace(line, r"(?U)\s+\z", "")
    capital = lambda ws: F.size(F.filter(ws, lambda w: w.rlike(r"\A\p{Lu}"))) * 2 >= F.size(ws)
    over_row = F.coalesce(next_is_row, F.lit(False)) & (F.char_length(line) <= ROW)

    def told(b: Column) -> Column:
        shaped = ~b.rlike(r"[.:;,]\z") & ~line.contains("–") & ~line.contains("—") & has_letter(line) & ~(line.rlike("[0-9]") & line.rlike(NUMBER))
        names = F.when(shaped, let(_words(line), lambda ws: (F.size(ws) >= 3) & (line.contains("|") | over_row | capital(ws)))).otherwise(False)
        stops = (b == "") | b.rlike(r"[.!?]\z") | line.rlike(PARAGRAPH)
        return F.when(names, F.struct(collapse(line).alias("text"))).when(stops, F.struct(F.lit(None).cast("string").alias("text")))

    return let(bare, told)


def _last_above(values: Column, line_no: Column, n: int) -> Column:
    """The last value that is not null of the n lines above a line."""
    above = F.slice(values, F.greatest(line_no - n, F.lit(0)) + 1, F.least(line_no, F.lit(n)))
    return F.try_element_at(F.filter(above, lambda v: v.isNotNull()), F.lit(-1))


def _with(frame: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are worked out once a row, also where lambda functions use them later: rows go through a generator of one."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _clean(text: Column) -> Column:
    return collapse(F.replace(F.replace(text, F.lit(OPEN), F.lit('"')), F.lit(CLOSE), F.lit('"')))


def _bound(text: Column, cut: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(cut).alias("cut"))


def candidate_contexts(pages: DataFrame) -> DataFrame:
    """candidates() with their context: the first rule that applies gives its bounds.

    A page's numbers and dates are found once, and its lines are judged by them, within its row, and only on pages that have a candidate; a line is judged as
    a header or a heading only above the last line that asks for one. A candidate is then a row beside its page's text: what is made of it stands in
    columns, each worked out once and only where a rule asks for it.
    """
    read = _with(pages.filter(has_letter(F.col("text"))).select("doc_id", "page", F.col("text").alias("body")), t=let(F.col("body"), lambda x: tokens_and_cells(x))).filter(F.size("t.found") > 0)
    spots = F.transform("t.found", lambda t: line_number(F.col("body"), t["start"]))
    read = read.select("doc_id", "page", "body", F.col("t.found").alias("found"), F.col("t.cells").alias("cells"), F.col("t.wraps").alias("wraps"), F.split("body", "\n").alias("lines"), spots.alias("spots"))
    read = _with(read, rows=F.transform("lines", lambda x, i: is_row(x, F.size(F.filter("cells", lambda c: c == i)))), flats=F.transform("lines", lambda x, i: F.when(F.array_contains("spots", i), _is_flat(x))))
    last = lambda asks: F.coalesce(F.array_max(F.filter("spots", asks)), F.lit(0))
    read = read.select("*", last(lambda i: F.get("rows", i) | F.get("flats", i)).alias("tabled"), last(lambda i: F.get("lines", i).contains(":")).alias("labelled"))
    judged = F.transform("lines", lambda x, i: F.when(i < F.col("tabled"), _judged(x, F.get("rows", i + 1))))
    read = _with(read, judged=judged, headings=F.transform("lines", lambda x, i: F.when((i < F.col("labelled")) & x.rlike(HEADING), collapse(x))))
    near = read.select("doc_id", "page", "body", "lines", "rows", "flats", "judged", "headings", "wraps", F.inline(F.arrays_zip("found", F.col("spots").alias("_line_no")))).select("*", "found.*").drop("found")
    near = near.withColumn("_head", F.substring("body", F.lit(1), F.col("start"))).withColumn("_line_left", F.substring_index("_head", "\n", -1))
    near = near.withColumn("line", F.get("lines", "_line_no"))
    begin = F.col("start") - F.char_length("_line_left")
    stop = begin + F.char_length("line")
    crossed = F.exists("wraps", lambda w: ((w["start"] < stop) & (stop < w["end"])) | ((w["start"] < begin - 1) & (begin - 1 < w["end"])))
    on_line = (F.col("end") <= stop) & ((F.size("wraps") == 0) | ~crossed)
    label = F.col("_line_left").contains(":") & (F.char_length(collapse(F.col("line"))) <= SHORT_LINE)
    # 1: a row, 2: a labelled line, 3: a flattened row, if it has a header
    near = near.withColumn("_rule", F.when(on_line, F.when(F.get("rows", F.col("_line_no")), 1).when(label, 2).when(F.get("flats", F.col("_line_no")), 3).otherwise(0)).otherwise(0))
    header, heading = _last_above(F.col("judged"), F.col("_line_no"), HEADER_LINES)["text"], _last_above(F.col("headings"), F.col("_line_no"), HEADING_LINES)
    near = near.withColumn("_prefix", F.when(F.col("_rule").isin(1, 3), header).when(F.col("_rule") == 2, heading))
    near = near.withColumn("_whole", F.col("_rule").isin(1, 2) | ((F.col("_rule") == 3) & F.col("_prefix").isNotNull()))
    # prose: back to the last end of a sentence, on to the next, at most WINDOW characters and whole words
    low = F.greatest(F.col("start") - WINDOW, F.lit(0))
    whole_right = F.substring(F.col("line"), F.col("end") - begin + 1, F.char_length("line"))
    lefts = lambda x: F.when(x.rlike(_END), _bound(F.regexp_replace(x, rf"(?s)\A.*(?:{_END})", ""), False)).when(low > 0, _bound(F.regexp_replace(x, r"\A[^ ]* ", ""), True)).otherwise(_bound(x, False))
    rights = lambda x: F.when(x.rlike(_END), _bound(F.regexp_extract(x, rf"(?s)\A(.*?(?=(?:{_END})).)", 1), False)).when(F.col("end") + WINDOW < F.char_length("body"), _bound(F.regexp_replace(x, r" [^ ]*\z", ""), True)).otherwise(_bound(x, False))
    near = near.withColumns({
        "_l": F.when(F.col("_whole"), _bound(F.col("_line_left"), False)).otherwise(let(F.substring(F.col("body"), low + 1, F.col("start") - low), lefts)),
        "_r": F.when(F.col("_whole"), _bound(whole_right, False)).otherwise(let(F.substring(F.col("body"), F.col("end") + 1, F.lit(WINDOW)), rights)),
    })
    own = ("doc_id", "page", "start", "end", "text", "kind_no", "value", "currency", "date")
    parts = near.select(*own, "before", "after", "_prefix", F.col("_l.cut").alias("_cl"), F.col("_r.cut").alias("_cr"), F.substring("body", F.col("start") + 1, F.col("end") - F.col("start")).alias("value_text"), F.col("_l.text").alias("_l"), F.col("_r.text").alias("_r"))
    # the mark takes in a currency beside the number, as far as the bounds go
    b, a = F.least(F.col("before"), F.char_length("_l")), F.least(F.col("after"), F.char_length("_r"))
    before, after = F.substring(F.col("_l"), F.lit(1), F.char_length("_l") - b), F.substring(F.col("_r"), a + 1, F.char_length("_r"))
    value = F.concat(F.substring(F.col("_l"), F.char_length("_l") - b + 1, b), F.col("value_text"), F.substring(F.col("_r"), F.lit(1), a))
    short = F.when(F.char_length("_prefix") > PREFIX, F.concat(F.regexp_replace(F.substring("_prefix", 1, PREFIX), r" [^ ]*\z", ""), F.lit(f" {CUT}"))).otherwise(F.col("_prefix"))
    head = F.concat(F.lit("s. "), F.col("page").cast("string"), F.lit(": "), F.coalesce(F.concat(F.lit("["), F.translate(_clean(short), "[]", "()"), F.lit("] ")), F.lit("")))
    spaced = lambda text, edge, left_side: let(_clean(text), lambda clean: F.when((clean != "") & text.rlike(edge), F.concat(clean, F.lit(" ")) if left_side else F.concat(F.lit(" "), clean)).otherwise(clean))
    parts = parts.select("*", head.alias("_head"), F.concat(F.lit(OPEN), _clean(value), F.lit(CLOSE)).alias("_mark"), spaced(before, r"(?U)\s\z", True).alias("_before"), spaced(after, r"(?U)\A\s", False).alias("_after"))
    room = F.lit(CONTEXT - 4) - F.char_length("_head") - F.char_length("_mark")
    n, m = F.char_length("_before"), F.char_length("_after")
    keep_left = F.least(n, F.greatest(F.floor(room * 2 / 3).cast("int"), room - m))
    parts = parts.withColumns({"_room": room, "_kl": F.when(n + m > room, keep_left).otherwise(n)})
    parts = parts.withColumn("_kr", F.when(n + m > F.col("_room"), F.col("_room") - F.col("_kl")).otherwise(m))
    fit_left = F.when(F.col("_kl") < n, F.regexp_replace(F.substring(F.col("_before"), n - F.col("_kl") + 1, F.col("_kl")), r"\A[^ ]* ", "")).otherwise(F.col("_before"))
    fit_right = F.when(F.col("_kr") < m, F.regexp_replace(F.substring(F.col("_after"), F.lit(1), F.col("_kr")), r"(?s) [^ ]*\z", "")).otherwise(F.col("_after"))
    context = F.concat("_head", F.when(F.col("_cl") | (F.col("_kl") < n), f"{CUT} ").otherwise(""), fit_left, "_mark", fit_right, F.when(F.col("_cr") | (F.col("_kr") < m), f" {CUT}").otherwise(""))
    return numbered(parts.select(*own, context.alias("context")), pages)
