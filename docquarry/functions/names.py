"""Lists of names, tags in untrusted text, provider messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let

# Legal forms of organisations, tag names, marks of an exhausted quota and of unusable output.
LEGAL_FORM = r"^(sp\. ?z ?o\.? ?o\.?|sp\. ?k\.|sp\. ?j\.|s\.a\.|s\.k\.a\.|gmbh|ltd\.?|inc\.?|llc|ag)$"
TAGS = r"(?iU)<\s*/?\s*(document|page)\b[^>]*>?"
QUOTA = ("4006", "neuron", "quota", "daily free allocation")
UNUSABLE = ("json mode couldn't be met", "json mode could not be met")
# End of the fixed values.


def strip(text: Column) -> Column:
    """Text without blanks, line ends and separators at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def fold(text: Column) -> Column:
    """Text as it is compared in any case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def clean_list(names: Column, same: Callable[[Column], Column] = fold) -> Column:
    """Names in order, stripped; blank ones and those equal to an earlier one but for case are dropped. same: the form in which names are compared."""
    clean = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), strip), lambda x: x != "")
    return let(clean, lambda own: let(F.transform(own, same), lambda low: F.filter(own, lambda x, i: F.array_position(low, same(x)) == i + 1)))


def distinct_names(names: Column) -> Column:
    """Names in order, blanks collapsed; blank ones and those equal to an earlier one but for case are dropped."""
    clean = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: collapse(x)), lambda x: x != "")
    return let(clean, lambda own: let(F.transform(own, lambda x: F.lower(x)), lambda low: F.filter(own, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)))


def distinct_organisations(names: Column) -> Column:
    """distinct_names() without those that are in the list with a legal form too."""
    longer = lambda x, unique: F.exists(unique, lambda y: F.lower(y).startswith(F.concat(F.lower(x), F.lit(" "))) & F.substring(F.lower(y), F.char_length(x) + 2, F.char_length(y)).rlike(LEGAL_FORM))
    return let(distinct_names(names), lambda unique: F.filter(unique, lambda x: ~longer(x, unique)))


def without_tags(text: Column) -> Column:
    """Untrusted text in which nothing can pass for the tags around it."""
    return F.regexp_replace(text, TAGS, "[tag]")


def provider_problem(message: Column) -> Column:
    """Struct (category, code) of a provider's message; code: its first number of four digits, or null."""
    low = F.lower(message)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: low.contains(m))
    code = F.regexp_extract(message, r"(?<![0-9])([1-9][0-9]{3})(?![0-9])", 1).try_cast("int")
    return F.struct(F.when(has(UNUSABLE), "invalid_output").when(has(QUOTA), "quota").otherwise("unavailable").alias("category"), code.alias("code"))
