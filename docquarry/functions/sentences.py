"""Sentence counts as an interval: boundaries that may belong to an abbreviation count for the upper end only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations after which a full stop need not end a sentence, and punctuation.
ABBREVIATIONS = (
    "al art dr godz hab inż itd itp lit mgr mld mln nr np ok pkt pn por poz prof pt r sp sz tj tys ul ust wg ww zob "
    "approx ca co corp dept etc fig inc jr ltd mr mrs ms no sr st vs"
)
TERMINAL, CLOSERS, OPENERS = r"[.!?…]", r"[\"'”’»)\]]", r"[\"'„“«(\[]"
# End of the fixed values.

# A letter after the blank is only looked at, so that it can be the token of the next boundary ("J. K. Nowak"). A token begins where its letters and
# stops begin, or behind the boundary before: whatever matches from further inside matches from there too, so words are read once, not once a letter.
_MARK, _PART = "\x01", "\x02"
_BOUNDARY = rf"(?U)(?:\G|(?<![\p{{L}}.]))((?:[\p{{L}}.]*\p{{L}})?)({TERMINAL}+){CLOSERS}*\s+{OPENERS}*(?:(?=(\p{{L}}))|(\S))"


def sentence_interval(text: Column) -> Column:
    """Struct (least, most, closed) of a text; closed: it ends like a sentence. A blank text has (0, 0, false).

    A digit after the boundary, or a capital after a single full stop that follows a letter, a token with inner
    stops or an abbreviation, makes it uncertain. Anything else than a digit or a capital makes it none.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    # all boundaries are marked in one pass; marks that a text has are no letters, digits or blanks, and become another such character
    plain = F.when(body.rlike(f"[{_MARK}{_PART}]"), F.translate(body, _MARK + _PART, "\x03\x03")).otherwise(body)
    pieces = F.split(F.regexp_replace(plain, _BOUNDARY, f"{_MARK}$1{_PART}$2{_PART}$3{_PART}$4{_MARK}"), _MARK)
    found = F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), lambda p: F.split(p, _PART))

    def kind(parts: Column) -> Column:
        b = {name: F.get(parts, F.lit(k)) for k, name in enumerate(("token", "run", "letter", "other"))}
        word = F.lower(F.regexp_replace(b["token"], r"^\.+", ""))
        short = (F.char_length(word) == 1) | word.contains(".") | word.isin(*ABBREVIATIONS.split())
        return F.when(b["other"].rlike(r"^\p{Nd}"), 1).when(~b["letter"].rlike(r"^\p{Lu}"), 0).when((b["run"] == ".") & (word != "") & short, 1).otherwise(2)

    kinds = F.transform(found, kind)
    sure, unsure = F.size(F.filter(kinds, lambda k: k == 2)), F.size(F.filter(kinds, lambda k: k == 1))
    blank = body == ""
    return F.struct(
        F.when(blank, 0).otherwise(sure + 1).alias("least"),
        F.when(blank, 0).otherwise(sure + unsure + 1).alias("most"),
        body.rlike(rf"{TERMINAL}{CLOSERS}*\z").alias("closed"),
    )


def sentences_within(text: Column, low: int, high: int) -> Column:
    found = sentence_interval(text)
    return found["closed"] & (found["least"] <= high) & (found["most"] >= low)
