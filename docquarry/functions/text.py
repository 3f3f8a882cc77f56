"""Column functions on text: matches with offsets, letters, blanks. Offsets count code points from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x01"
_FOUND = "array<struct<start:int,end:int,text:string>>"
#: Pieces of a text up to which each match counts what stands before it.
_FEW = 41
#: What collapse() changes: a blank that is no space, and runs of blanks.
_RUNS = r"(?U)\s(?:\s+|(?<! ))"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of all matches of a Java pattern that never matches the empty string.

    Each match is wrapped in a mark and the text is split at the marks. A match's place is the length of what stands before its mark; where there are
    many, lengths are added up along the pieces instead: as numbers alone, since a struct is copied with all that it holds at every step.
    """
    plain = F.when(text.contains(_MARK), F.translate(text, _MARK, " ")).otherwise(text)
    marked = F.regexp_replace(plain, f"({pattern})", f"{_MARK}$1{_MARK}")
    hits = lambda parts: F.filter(parts, lambda _, i: i % 2 == 1)

    def added(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(part))))
        return let(ends, lambda e: F.transform(hits(parts), lambda hit, i: F.struct(F.get(e, i * 2 + 1).alias("start"), F.get(e, i * 2 + 2).alias("end"), hit.alias("text"))))

    def placed(m: Column) -> Column:
        before = lambda i: F.char_length(F.call_function("substring_index", m, F.lit(_MARK), i * 2 + 1)) - i * 2
        few = lambda parts: F.transform(hits(parts), lambda hit, i: let(before(i), lambda s: F.struct(s.alias("start"), (s + F.char_length(hit)).alias("end"), hit.alias("text"))))
        return let(F.split(m, _MARK), lambda parts: F.when(F.size(parts) <= _FEW, few(parts)).otherwise(added(parts)))

    return let(marked, lambda m: F.when(m.contains(_MARK), placed(m)).when(m.isNotNull(), F.array().cast(_FOUND)))


def first_place(text: Column, shape: Column) -> Column:
    """Struct (start, end) of the first match of a pattern that is itself a column, never matches the empty string and looks at nothing around a match, or null.

    Such a pattern matches wherever what it found stands, so the first place of that text is the match's; the pattern is compiled once a text.
    """
    found = F.call_function("regexp_extract", text, shape, F.lit(0))
    start = lambda m: F.call_function("locate", m, text) - 1
    return let(found, lambda m: F.when(m != "", let(start(m), lambda s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end")))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside of lambda functions an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def collapse(text: Column) -> Column:
    """Runs of blanks become one space; blanks at both ends go."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def clean_recognised(text: Column) -> Column:
    """Text from a recogniser: lines lose blanks at their ends, three or more line ends become two, both ends are trimmed."""
    lines = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def safe_name(name: Column, default: str = "dokument", suffix: str = "-analiza.json") -> Column:
    """A file name for a result: no .pdf, no unusual characters, at most 80 characters before the suffix."""
    base = F.substring(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf\z", ""), r"[^\p{L}\p{N}._-]+", "_"), 1, 80)
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit(default)), F.lit(suffix))
