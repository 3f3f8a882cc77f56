"""Normal forms of text: for comparing quotes with their source, and Unicode's composed form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Typographic quotes, dashes and blanks, and what they are compared as.
TYPOGRAPHIC, PLAIN = "„”“«»’‘–—\u00a0\u202f", "\"\"\"\"\"''--  "
# End of the fixed values.


def comparable(text: Column) -> Column:
    """Text as quotes are compared: plain quotes, dashes and blanks, runs of blanks as one, any case. Composed text is expected."""
    return F.replace(F.lower(collapse(F.translate(text, TYPOGRAPHIC, PLAIN))), F.lit("ß"), F.lit("ss"))


def spelled(quote: Column) -> Column:
    """A Java pattern that finds a quote in text as it was written: the inverse of comparable(), so that offsets are those of the source."""
    literal = F.concat(F.lit(r"\Q"), F.replace(comparable(quote), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    for plain, written in ((" ", r"\s+"), ('"', '["„”“«»]'), ("'", "['’‘]"), ("-", "[-–—]"), ("ss", "(?:ss|ß)")):
        literal = F.replace(literal, F.lit(plain), F.lit(rf"\E{written}\Q"))
    return F.concat(F.lit("(?U)(?i:"), literal, F.lit(")"))


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC). Nothing below U+0300 changes, so other texts go to the worker as null."""
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(text.rlike(r"[^\x00-\u02FF]"), text)), text)
