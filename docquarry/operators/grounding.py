"""Facts of chunks against the text they quote, and the facts of all chunks as one result.

Facts: (doc_id, chunk, pos, kind, page, value, currency, basis, period, status, date, context, evidence); kind: "amount" or "date"; pos:
place in its chunk's list of its kind; page: where the model says it is; context: what an amount is for, or a date's event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import distinct_names, distinct_organisations, strip
from ..functions.normal import comparable, spelled
from ..functions.text import first_place, let
from .selection import CHUNK_KEYWORDS, assembled
from .tokens import amount_tokens, date_tokens

# How qualifiers are named in text and added to contexts, the window around a value, and the shortest quote.
NAMED = {
    "net": r"\bnett?o?\b|\bnet\b", "gross": r"brutto|gross", "vat": r"\bvat\b|podat", "one-off": r"jednoraz|one-off|one time", "monthly": r"mies|month",
    "yearly": r"rocz|\brok|year|annual", "daily": r"dzie[nń]|dzienn|daily|per day", "rejected": r"odrzuc|reject", "historical": r"histor|wcześniej|previous",
    "proposed": r"propon|propos", "estimated": r"szacun|estimat", "budget": r"budżet|budget", "maximum": r"maks|nie więcej|limit|max",
}
LABELS = {
    "pl": {
        "net": "netto", "gross": "brutto", "vat": "VAT", "one-off": "jednorazowo", "monthly": "miesięcznie", "yearly": "rocznie", "daily": "za dzień",
        "rejected": "odrzucona", "historical": "historyczna", "proposed": "proponowana", "estimated": "szacunkowa", "budget": "budżet", "maximum": "maksymalnie",
    },
    "en": {
        "net": "net", "gross": "gross", "vat": "VAT", "one-off": "one-off", "monthly": "monthly", "yearly": "yearly", "daily": "per day",
        "rejected": "rejected", "historical": "historical", "proposed": "proposed", "estimated": "estimated", "budget": "budget", "maximum": "maximum",
    },
}
SENTENCE_END = r"[.!?;](?=\s)|\n"
WINDOW, SHORTEST = 200, 3
# End of the fixed values.

#: SENTENCE_END, to which the control character that stands for a mark elsewhere is a blank.
_STOP = SENTENCE_END.replace(r"(?=\s)", r"(?=[\s\x01])")


def named(text: Column) -> Column:
    """Array of the qualifiers that a text names."""
    told = lambda low: F.array_compact(F.array(*[F.when(low.rlike(f"(?U){shape}"), key) for key, shape in NAMED.items()]))
    return let(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), told)


def claimed() -> Column:
    """Array of a fact's qualifiers that its source must name."""
    return F.filter(F.array("basis", "period", "status"), lambda q: q.isin(*NAMED))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence or line around [start, end), at most WINDOW characters to each side."""
    low = F.greatest(start - WINDOW, F.lit(0))
    # a stop needs the blank behind it to end a sentence, also where it is the last character of its part
    ends = lambda part: F.regexp_replace(part, rf"(?s)\A.*(?:{_STOP})", "")
    stops = lambda part: let(F.regexp_extract(part, rf"(?s)\A.*?(?:{_STOP})", 0), lambda found: F.when(found != "", found).otherwise(part))
    return F.concat(ends(F.substring(text, low + 1, start - low)), F.substring(text, start + 1, end - start), let(F.substring(text, end + 1, F.lit(WINDOW)), stops))


def located(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """facts with found_page, start, end: where the chunk's own text holds the evidence, or nulls.

    segments: as chunks() gives them. The page that the model names is looked at first, then the chunk's pages in order; the first place counts.
    Every fact meets its own chunk only, as one row; a literal search rules out nearly all texts before offsets are found. Facts are read once and
    stay rows all along, so what gives them is not worked out again.
    """
    lead, text = F.char_length("overlap"), F.concat("overlap", "new_text")
    part = F.struct("seq", "page", (F.col("start") - lead).alias("base"), text.alias("text"))
    own = segments.select("doc_id", "chunk", part.alias("p")).groupBy("doc_id", "chunk").agg(F.collect_list("p").alias("_parts"))
    # texts and quotes are brought into the form in which they are compared behind the shuffles, which move them once then
    own = own.select("doc_id", "chunk", "_parts", F.inline(F.array(F.struct(F.transform("_parts", lambda p: comparable(p["text"])).alias("_plain")))))
    # segments are estimated by the table they are made of: without the hint, a driver would gather and broadcast them
    met = facts.join(own.hint("merge"), ["doc_id", "chunk"], "left")
    met = met.select("*", F.inline(F.array(F.struct(comparable(F.col("evidence")).alias("_needle"), spelled(F.col("evidence")).alias("_shape")))))

    def place(p: Column) -> Column:
        at = lambda m: F.when(m.isNotNull(), F.struct(F.coalesce(p["page"] != F.col("page"), F.lit(True)).alias("other"), p["seq"].alias("seq"), p["page"].alias("page"), (p["base"] + m["start"]).alias("start"), (p["base"] + m["end"]).alias("end")))
        return let(first_place(p["text"], F.col("_shape")), at)

    near = F.filter("_parts", lambda p, i: F.contains(F.get("_plain", i), F.col("_needle")))
    found = F.when(F.char_length("_needle") >= SHORTEST, F.array_min(F.transform(near, place)))
    # one row goes through the generator, so that its place is found once for all that is read off it
    out = met.select(*facts.columns, F.inline(F.array(F.struct(found.alias("_at")))))
    return out.withColumns({"found_page": F.col("_at.page"), "start": F.col("_at.start"), "end": F.col("_at.end")}).drop("_at")


def grounded(facts: DataFrame, segments: DataFrame, pages: DataFrame) -> DataFrame:
    """located() with problem: "evidence", "value", "currency", "qualifier" or "date" for the first thing that the source does not state, or null.

    An amount's value must be inside the quote, one such number must have the currency, and one of these must have every claimed qualifier in
    its sentence. Values are join keys, so a page with many numbers meets only the equal ones: a page's tokens of one value are one row.
    """
    where = located(facts, segments)
    # qualifiers are only asked of numbers that have a currency
    told = lambda t: F.when(t["currency"].isNotNull(), named(sentence_around(F.col("text"), t["start"], t["end"])))
    token = lambda t: F.struct(F.bround(t["value"], 2).alias("_v"), F.struct(t["start"].alias("s"), t["end"].alias("e"), t["currency"].alias("c"), told(t).alias("q")).alias("t"))
    each = pages.select("doc_id", F.col("page").alias("found_page"), F.inline(F.transform(let(F.col("text"), amount_tokens), token)))
    tokens = each.groupBy("doc_id", "found_page", "_v").agg(F.collect_list("t").alias("_tokens"))
    asked = where.withColumns({"_v": F.when(F.col("kind") == "amount", F.bround(F.col("value").cast("decimal(38,2)"), 2)), "_currency": F.upper("currency"), "_claimed": claimed()})
    inside = F.filter("_tokens", lambda t: (t["s"] >= F.col("start")) & (t["e"] <= F.col("end")))
    same = lambda t: F.coalesce(t["c"] == F.col("_currency"), F.lit(False))

    def amount(hits: Column) -> Column:
        whole = F.exists(hits, lambda t: same(t) & (F.size(F.array_except("_claimed", t["q"])) == 0))
        return F.when(F.coalesce(F.size(hits), F.lit(0)) <= 0, "value").when(~F.exists(hits, same), "currency").when(~whole, "qualifier")

    dated = F.exists(let(F.col("evidence"), date_tokens), lambda d: d["date"] == F.col("date").try_cast("date"))
    problem = F.when(F.col("found_page").isNull(), "evidence").when(F.col("kind") == "amount", let(inside, amount)).when(~F.coalesce(dated, F.lit(False)), "date")
    return asked.join(tokens.hint("merge"), ["doc_id", "found_page", "_v"], "left").select(*where.columns, problem.alias("problem"))


def invalid_chunks(judged: DataFrame) -> DataFrame:
    """(doc_id, chunk, problems) of the chunks with a fact that is not stated: nothing of such a chunk may be used."""
    path = F.concat_ws(".", F.concat("kind", F.lit("s")), F.col("pos").cast("string"), "problem")
    return judged.filter("problem IS NOT NULL").groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(path)).alias("problems"))


def merged_facts(judged: DataFrame) -> DataFrame:
    """Facts of grounded() of chunks that hold, once each, with duplicates: how many equal ones went.

    Facts are equal only if they cite the same place of the source and agree in value, currency, qualifiers and context, or in date and event;
    the first chunk's stays. Amounts are never added up.
    """
    # a chunk's facts meet in a window, as a join with invalid_chunks() would work out all of them twice
    wrong = F.coalesce(F.bool_or(F.col("problem").isNotNull()).over(Window.partitionBy("doc_id", "chunk")), F.lit(False))
    held = judged.withColumn("_wrong", wrong).filter("NOT _wrong").drop("_wrong")
    key = {"_value": F.col("value").cast("decimal(38,2)"), "_currency": F.upper("currency"), "_context": comparable(F.col("context")), "_date": F.col("date").try_cast("date")}
    same = ["doc_id", "kind", "found_page", "start", "end", "basis", "period", "status", *key]
    kept = F.struct("chunk", "pos", strip(F.col("context")).alias("context"))
    out = held.withColumns(key).groupBy(*same).agg(F.min(kept).alias("_kept"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return out.select("doc_id", "kind", F.col("found_page").alias("page"), "start", "end", F.col("_value").alias("value"), F.col("_currency").alias("currency"), "basis", "period", "status", F.col("_date").alias("date"), "_kept.chunk", "_kept.pos", "_kept.context", "duplicates")


def labelled_context(language: Column) -> Column:
    """A context with the qualifiers that it does not name, in the document's language; in languages without labels as it is."""
    told = named(F.col("context"))

    def added(words: dict[str, str]) -> Column:
        label = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
        missing = F.transform(F.array_except(claimed(), told), lambda q: F.element_at(label, q))
        return F.when(F.size(missing) > 0, F.concat("context", F.lit(" ("), F.array_join(missing, ", "), F.lit(")"))).otherwise(F.col("context"))

    out = F.col("context")
    for code, words in LABELS.items():
        out = F.when(language == code, added(words)).otherwise(out)
    return out


def merged_results(documents: DataFrame, overviews: DataFrame, lists: DataFrame, merged: DataFrame) -> DataFrame:
    """Results, as selection.assembled gives them, of overviews (a narrative without organizations and people), chunks' lists (doc_id, chunk,
    organizations, people, keywords) and merged_facts(). Facts go by page and place, names by chunk; the overview's keywords come first."""
    told = merged.join(overviews.select("doc_id", "language"), "doc_id").withColumn("context", F.when(F.col("kind") == "amount", labelled_context(F.col("language"))).otherwise(F.col("context")))
    order = [F.col("page"), F.col("start"), F.col("chunk"), F.col("pos")]
    amount = F.when(F.col("kind") == "amount", F.struct(*order, F.struct(F.col("value").cast("double").alias("value"), "currency", "context").alias("fact")))
    date = F.when(F.col("kind") == "date", F.struct(*order, F.struct(F.col("date").cast("string").alias("date"), "context").alias("fact")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["fact"])
    facts = told.groupBy("doc_id").agg(in_order(amount).alias("amounts"), in_order(date).alias("dates"))
    joined = lambda c: F.flatten(F.transform("_lists", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))
    parts = lists.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "organizations", "people", "keywords"))).alias("_lists"))
    said = overviews.join(parts, "doc_id", "left").withColumn("_lists", F.coalesce("_lists", F.array().cast(parts.schema["_lists"].dataType)))
    names = {"organizations": distinct_organisations(joined("organizations")), "people": distinct_names(joined("people")), "keywords": F.slice(distinct_names(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), joined("keywords"))), 1, CHUNK_KEYWORDS)}
    return assembled(documents, said.withColumns(names).drop("_lists"), facts)
