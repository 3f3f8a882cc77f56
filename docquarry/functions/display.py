"""Values as they are shown to Polish readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What kinds of documents are called, months, signs of currencies, and the blanks of Polish numbers.
TYPE_LABELS = {"faktura": "Faktura", "umowa": "Umowa", "oferta": "Oferta", "raport": "Raport", "inne": "Inny dokument"}
MONTHS = "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia"
SHORT_MONTHS = "sty lut mar kwi maj cze lip sie wrz paź lis gru"
SIGNS = {"PLN": "zł", "EUR": "€", "USD": "USD", "GBP": "GBP"}
BLANK = " "
# End of the fixed values.


def _month(day: Column, names: str) -> Column:
    return F.element_at(F.split(F.lit(names), " "), F.month(day))


def number(value: Column, least: int, most: int) -> Column:
    """A number with a comma, `least` to `most` decimals, and blanks between groups of three digits from five digits on."""
    plain = F.format_number(F.round(F.abs(value.cast("decimal(38,6)")), most), most)
    whole, part = F.regexp_replace(F.substring_index(plain, ".", 1), ",", ""), F.substring_index(plain, ".", -1)
    grouped = F.when(F.char_length(whole) > 4, F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", BLANK)).otherwise(whole)
    kept = F.lit("") if most == 0 else F.regexp_replace(part, rf"(?<=\A[0-9]{{{least}}}[0-9]{{0,{most - least}}})0+\z", "")
    tail = F.lit("") if most == 0 else F.when(kept == "", "").otherwise(F.concat(F.lit(","), kept))
    return F.concat(F.when((value < 0) & (F.regexp_replace(plain, "[0.,]", "") != ""), "-").otherwise(""), grouped, tail)


def amount(value: Column, currency: Column) -> Column:
    """An amount with two decimals and its currency's sign, or its code where it has none of its own."""
    signs = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])
    return F.concat(number(value, 2, 2), F.lit(BLANK), F.coalesce(F.try_element_at(signs, currency), currency))


def long_date(iso: Column) -> Column:
    """12 marca 2026, of an ISO date."""
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), _month(day, MONTHS), F.year(day).cast("string"))


def page_list(pages: Column) -> Column:
    """1, 2 i 5."""
    texts = F.transform(pages, lambda p: p.cast("string"))
    n = F.size(texts)
    return F.when(n <= 1, F.array_join(texts, "")).otherwise(F.concat(F.array_join(F.slice(texts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" i "), F.element_at(texts, -1)))


def size(n: Column) -> Column:
    """Bytes as KB below one MB, at least one, else as MB with one decimal at most."""
    small = F.concat(F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("string"), F.lit(" KB"))
    return F.when(n < 1024 * 1024, small).otherwise(F.concat(number(n / (1024 * 1024), 0, 1), F.lit(" MB")))


def seconds(ms: Column) -> Column:
    return F.concat(number(ms / 1000, 0, 1), F.lit(" s"))


def saved_at(at: Column) -> Column:
    """12 mar 2026, 14:05, in the session's time zone."""
    return F.concat(F.concat_ws(" ", F.dayofmonth(at).cast("string"), _month(at, SHORT_MONTHS), F.year(at).cast("string")), F.lit(", "), F.date_format(at, "HH:mm"))


def type_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, kind), kind)
