"""A model's selection against its document: marks, names that the source must hold, full names of organisations, and the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_list, fold, strip
from ..functions.normal import composed
from ..functions.sentences import sentences_within
from ..functions.text import collapse
from .results import first_of_each

# Legal forms, marks, titles of documents without one, and limits.
LEGAL_FORM = r"(?:sp\.\s?z\s?o\.\s?o\.|sp\.\s?k\.|sp\.\s?j\.|sp\.\s?p\.|s\.\s?k\.\s?a\.|s\.\s?a\.|spółka z ograniczoną odpowiedzialnością|spółka akcyjna|gmbh|ltd\.?|inc\.?|llc)"
HAS_LEGAL_FORM = rf"(?iu)(?:\A|\s){LEGAL_FORM}(?=\s|,|\z)"
COPIED_MARK = r"⟦[AD][0-9]+⟧(?=\s*[0-9])"
TITLES = {
    "pl": "Dokument bez tytułu", "en": "Untitled document", "de": "Dokument ohne Titel", "fr": "Document sans titre", "es": "Documento sin título",
    "it": "Documento senza titolo", "cs": "Dokument bez názvu", "sk": "Dokument bez názvu", "uk": "Документ без назви", "ru": "Документ без названия",
}
TITLE = "Untitled document"
KEYWORDS, CHUNK_KEYWORDS = 20, 12
# End of the fixed values.


def without_copied_marks(text: Column) -> Column:
    """Text without the marks that were copied together with the number behind them."""
    return F.when(text.contains("⟦"), F.regexp_replace(text, COPIED_MARK, "")).otherwise(text)


def has_mark(text: Column) -> Column:
    """Whether a mark is left, which no narrative may hold."""
    return F.when(text.contains("⟦") | text.contains("⟧"), F.regexp_replace(text, COPIED_MARK, "").rlike("[⟦⟧]")).otherwise(F.lit(False))


def fallback_title(title: Column, language: Column) -> Column:
    """A document's title, or the one for documents without, by language."""
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    return F.coalesce(F.nullif(F.regexp_replace(title, r"(?U)\A\s+|\s+\z", ""), F.lit("")), F.element_at(titles, language), F.lit(TITLE))


def overview_problems(summary: Column, key_points: Column) -> Column:
    """Array of "summary" and "keyPoints", where these break their rules: 3 to 5 sentences, 3 to 7 different points."""
    told = F.coalesce(sentences_within(summary, 3, 5), F.lit(False))
    return F.array_compact(F.array(F.when(~told, "summary"), F.when(~F.size(clean_list(key_points)).between(3, 7), "keyPoints")))


def normal_name(text: Column) -> Column:
    return fold(collapse(text))


def _by_document(names: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, asked): all names of a document in one row, so that a page's text meets them once."""
    return names.groupBy("doc_id").agg(F.collect_list(F.struct("pos", *more)).alias("asked"))


def attested(names: DataFrame, pages: DataFrame) -> DataFrame:
    """names (doc_id, pos, name) with attested: whether a page holds the name's words one after the other, whole, in any case and in either of
    Unicode's forms. Blank names are. pos tells a document's names apart."""
    plain = names.withColumn("_name", normal_name(composed(F.col("name"))))
    spelled = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace("_name", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    asked = _by_document(plain.filter("_name <> ''"), F.col("_name").alias("plain"), spelled.alias("spelled"))
    texts = pages.join(asked, "doc_id").select("doc_id", normal_name(composed(F.col("text"))).alias("_text"), "asked")
    # the literal search is cheap and rules out nearly all names before the boundaries are looked at
    met = texts.select("doc_id", F.explode(F.filter("asked", lambda n: F.contains(F.col("_text"), n["plain"]) & F.regexp_like(F.col("_text"), n["spelled"]))).alias("n"))
    found = met.select("doc_id", F.col("n.pos").alias("pos")).distinct().withColumn("_found", F.lit(True))
    out = plain.join(found, ["doc_id", "pos"], "left")
    return out.select("doc_id", "pos", "name", (F.coalesce("_found", F.lit(False)) | (F.col("_name") == "")).alias("attested"))


def full_name_pattern(name: Column) -> Column:
    """A Java pattern of a name with a legal form behind it; its first group is a capitalised word that goes before, its second the full name."""
    words = F.array_join(F.transform(F.split(collapse(name), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), r"\s+")
    return F.concat(F.lit(r"(?iuU)((?-i:[A-ZĄĆĘŁŃÓŚŹŻ][\w-]*[ \t]+)?)(?<![\w-])("), words, F.lit(rf",?\s+{LEGAL_FORM})(?!\w)"))


def full_organisations(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pos, name) of names: with the legal form, where the source has exactly one such full name and the name is not the end
    of a longer one; names equal to an earlier one but for case are dropped."""
    bare = names.filter(~F.col("name").rlike(HAS_LEGAL_FORM) & F.col("name").rlike(r"\S"))
    pattern = full_name_pattern(F.col("name"))
    first = F.lower(F.element_at(F.split(collapse(F.col("name")), " "), 1))
    asked = _by_document(bare, pattern.alias("pattern"), first.alias("first"))
    met = pages.join(asked, "doc_id").select("doc_id", F.col("text").alias("_text"), F.lower("text").alias("_low"), "asked")

    def hits(n: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all("_text", n["pattern"], F.lit(1)).alias("longer"), F.regexp_extract_all("_text", n["pattern"], F.lit(2)).alias("full"))
        return F.transform(F.filter(both, lambda h: h["longer"] == ""), lambda h: F.struct(n["pos"].alias("pos"), collapse(h["full"]).alias("full")))

    near = F.filter("asked", lambda n: F.contains(F.col("_low"), n["first"]))
    each = met.select("doc_id", F.inline(F.flatten(F.transform(near, hits))))
    one = each.groupBy("doc_id", "pos").agg(F.min("full").alias("_a"), F.max("full").alias("_b")).filter("_a = _b")
    resolved = names.join(one, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("_a", "name").alias("name"))
    again = F.row_number().over(Window.partitionBy("doc_id", normal_name(F.col("name"))).orderBy("pos"))
    return resolved.withColumn("_n", again).filter("_n = 1").drop("_n")


def first_problem(*stages: Column) -> Column:
    """Of arrays of problems, the first one that is not empty: a later stage is only judged when the earlier ones hold."""
    out = F.array().cast("array<string>")
    for stage in reversed(stages):
        out = F.when(F.size(stage) > 0, stage).otherwise(out)
    return out


def chosen_facts(selected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, amounts, dates) of selections (doc_id, candidate_id): facts in order of candidates, without repeats; found: candidates with context."""
    # selections grow with the documents, but are estimated by what they are exploded from: without the hint, the driver would gather and broadcast them
    facts = first_of_each(found.join(selected.select("doc_id", "candidate_id").distinct().hint("merge"), ["doc_id", "candidate_id"], "left_semi"))
    amount = F.when(F.col("kind") == "amount", F.struct("candidate_id", F.col("value").cast("double").alias("value"), "currency", "context"))
    date = F.when(F.col("kind") == "date", F.struct("candidate_id", F.col("date").cast("string").alias("date"), "context"))
    both = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(amount)).alias("a"), F.array_sort(F.collect_list(date)).alias("d"))
    return both.select("doc_id", F.transform("a", lambda x: F.struct(x["value"].alias("value"), x["currency"].alias("currency"), x["context"].alias("context"))).alias("amounts"), F.transform("d", lambda x: F.struct(x["date"].alias("date"), x["context"].alias("context"))).alias("dates"))


def assembled(documents: DataFrame, narratives: DataFrame, facts: DataFrame) -> DataFrame:
    """Results in the shape of validation.SCHEMA, and title_fallback: the file's data from documents (doc_id, file_name, pages, pages_without_text,
    ocr_pages), whatever the narrative says; texts from narratives (doc_id, language, type, title, date, summary, key_points, organizations, people, keywords)."""
    told = documents.select("doc_id", strip(F.col("file_name")).alias("file_name"), "pages", "pages_without_text", F.when(F.size("ocr_pages") > 0, F.col("ocr_pages")).alias("ocr_pages")).join(narratives, "doc_id").join(facts, "doc_id", "left")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    language, title = F.lower(strip(F.col("language"))), strip(F.col("title"))
    return told.select(
        "doc_id", "file_name", "pages", language.alias("language"), "type", fallback_title(title, language).alias("title"), "date", strip(F.col("summary")).alias("summary"), clean_list(F.col("key_points")).alias("key_points"), "organizations",
        clean_list(F.col("people")).alias("people"), empty("amounts", "array<struct<value:double,currency:string,context:string>>").alias("amounts"), empty("dates", "array<struct<date:string,context:string>>").alias("dates"),
        F.slice(clean_list(F.col("keywords")), 1, KEYWORDS).alias("keywords"), (F.size("pages_without_text") == 0).alias("complete"), "pages_without_text", "ocr_pages", (F.coalesce(title, F.lit("")) == "").alias("title_fallback"),
    )
