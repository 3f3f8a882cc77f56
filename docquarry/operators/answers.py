"""A model's answers: what they hold, whether they may be used, and the results that are made of them, with one correction of an invalid answer.

Attempts: (doc_id, attempt, raw, error, left); attempt: 1 or 2; raw: the provider's answer as JSON text; error: null, or why there is none (timeout,
quota, unavailable, invalid_output); left: seconds of the overall time when the attempt would begin. Documents: (doc_id, file_name, pages,
pages_without_text, ocr_pages). Every step keeps one row for each attempt; problems are `path: message` in a fixed order, and hold nothing of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import is_language
from ..functions.names import clean_list, fold, strip
from ..functions.shapes import child, kind_of, problems
from ..functions.normal import composed
from ..functions.text import collapse, let
from .contract import COMPACT, NO_LANGUAGE, SINGLE
from .requests import MOST_CHARS, answer
from .selection import HAS_LEGAL_FORM, KEYWORDS, fallback_title, full_name_pattern, has_mark, normal_name, overview_problems, without_copied_marks
from .validation import TYPES, result_problems

# Messages of problems, the time that a correction needs, fields of text, and codes of what a document ends with.
NO_ANSWER = "the model could not produce JSON matching the schema"
MARK = "contains an internal marker; write plain text"
SENTENCES_SAID, POINTS_SAID = "summary: must contain 3-5 sentences ending with punctuation", "keyPoints: need 3-7 non-empty distinct items"
NOT_WRITTEN = "not written in the document; copy the name exactly as one occurrence spells it, or leave it out"
NO_RESULT = "does not match the contract"
LEAST_SECONDS = 5.0
TEXT_FIELDS = ("title", "summary", "keyPoints", "organizations", "people", "keywords")
LISTS = ("keyPoints", "organizations", "people", "keywords")
CODES = {"timeout": "AI_TIMEOUT", "quota": "AI_QUOTA_EXCEEDED", "unavailable": "AI_UNAVAILABLE"}
# End of the fixed values.

_NONE = "array<string>"
_AMOUNTS, _DATES = "array<struct<value:double,currency:string,context:string>>", "array<struct<date:string,context:string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _narrative(v: Column, clean=lambda c: c) -> list[Column]:
    """The texts of an answer of the right shape, as columns."""
    texts = [clean(child(v, c, "string")).alias(c) for c in ("title", "summary")]
    lists = [F.transform(child(v, c, "array<string>"), clean).alias(c) for c in LISTS]
    return [child(v, "language", "string").alias("language"), child(v, "type", "string").alias("type"), *texts, *lists]


def _marks() -> Column:
    """Problems of internal marks that are left in texts."""

    def of(name: str) -> Column:
        if name in LISTS:
            said = F.transform(F.col(name), lambda s, i: F.when(has_mark(s), F.concat(F.lit(f"{name}."), i.cast("string"), F.lit(f": {MARK}"))))
            return F.array_compact(said)
        return F.array_compact(F.array(F.when(has_mark(F.col(name)), f"{name}: {MARK}")))

    return F.concat(*map(of, TEXT_FIELDS))


def _overview() -> Column:
    """Problems of the narrative. Codes and types are judged before sentences and points."""
    kinds = ", ".join(f"'{t}'" for t in TYPES[:-1]) + f" or '{TYPES[-1]}'"
    language, type_ = F.when(~is_language(F.lower(strip(F.col("language")))), f"language: {NO_LANGUAGE}"), F.when(~F.col("type").isin(*TYPES), f"type: Input should be {kinds}")
    typed = F.array_compact(F.array(language, type_))
    said = F.transform(overview_problems(strip(F.col("summary")), F.col("keyPoints")), lambda p: F.when(p == "summary", SENTENCES_SAID).otherwise(POINTS_SAID))
    return let(typed, lambda t: F.when(F.size(t) > 0, t).otherwise(said))


def _id_problems() -> Column:
    """Problems of chosen ids by field and position: repeated, then unknown, then of another kind."""

    def of(field: str, kind: str) -> Column:
        def said(i: Column, pos: Column) -> Column:
            is_ = F.get(F.filter("found", lambda f: f["candidate_id"] == i), F.lit(0))["kind"]
            again = F.array_position(F.col(field), i) != pos + 1
            what = F.when(again, "repeated").when(is_.isNull(), "is not a candidate").when(is_ != kind, f"is not a {'date' if kind == 'date' else 'amount'} candidate")
            return F.concat(F.lit(f"{field}."), pos.cast("string"), F.lit(": id "), i.cast("string"), F.lit(" "), what)

        return F.array_compact(F.transform(F.col(field), said))

    return F.concat(of("amountIds", "amount"), of("dateIds", "date"), of("mainDateId", "date"))


def _name_problems() -> Column:
    """Problems of people that no page holds, word for word."""

    def said(name: Column, pos: Column) -> Column:
        shape = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))
        there = F.exists("plain", lambda t: F.contains(t, name) & F.regexp_like(t, shape))
        return F.when((name != "") & ~there, F.concat(F.lit("people."), pos.cast("string"), F.lit(f": {NOT_WRITTEN}")))

    # names in one text take Unicode's composed form together
    return F.array_compact(F.transform("names", said))


def bundles(documents: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, file_name, pages, pages_without_text, ocr_pages, texts, plain, found): a document with all that its answers are judged against.

    Admission bounds a document's characters and the rule of too many candidates their number, so a row stays small; what is over these limits is
    no bundle. plain: texts as names are compared; found: candidates in order.
    """
    fact = F.struct("candidate_id", "kind", F.col("value").cast("double").alias("value"), "currency", F.col("date").cast("string").alias("date"), "context")
    seen = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(~F.col("too_many"), fact))).alias("found"), F.bool_or("too_many").alias("too_many"))
    sized = pages.select("doc_id", F.struct("page", "text").alias("p"), normal_name(composed(F.col("text"))).alias("n"), F.char_length("text").alias("chars"))
    whole = sized.groupBy("doc_id").agg(F.collect_list("p.text").alias("texts"), F.collect_list("n").alias("plain"), F.sum("chars").alias("chars")).filter(F.col("chars") <= MOST_CHARS)
    none = F.array().cast(seen.schema["found"].dataType)
    # texts and candidates are estimated by the table that they are made of: without hints, a driver would gather and broadcast them
    told = documents.join(whole.drop("chars").hint("merge"), "doc_id").join(seen.hint("merge"), "doc_id", "left").filter(~F.coalesce("too_many", F.lit(False)))
    return told.drop("too_many").withColumn("found", F.coalesce("found", none))


def compact_answers(attempts: DataFrame, bundle: DataFrame) -> DataFrame:
    """Attempts that choose candidates, judged: (doc_id, attempt, error, left, insufficient, problems, result).

    Stages, each only where the ones before hold: the answer's JSON, its types, insufficient content, internal marks, the narrative's rules,
    then people and ids together, then the result's own rules. An attempt meets its document's bundle once; all stages are columns of that row.
    result is a struct in validation.SCHEMA with title_fallback, or null.
    """
    v = F.col("payload")
    read = _read(attempts, COMPACT)
    insufficient = (F.size("typed") == 0) & child(v, "insufficientContent", "boolean")
    read = read.withColumn("insufficient", F.coalesce(insufficient, F.lit(False)))
    read = read.withColumn("open", (F.size("typed") == 0) & F.col("error").isNull() & ~F.col("insufficient"))
    ids = [child(v, f, "array<long>").alias(f) for f in ("amountIds", "dateIds")]
    told = read.join(bundle.hint("merge"), "doc_id").select("*", *_narrative(v, without_copied_marks), *ids, F.array_compact(F.array(child(v, "mainDateId", "long"))).alias("mainDateId"))
    names = F.split(normal_names(F.col("people")), "\x01")
    told = told.withColumn("names", F.when(F.size("people") > 0, names).otherwise(_none()))
    early = let(_marks(), lambda m: F.when(F.size(m) > 0, m).otherwise(_overview()))
    told = told.withColumn("early", F.when(F.col("open"), early).otherwise(_none()))
    told = told.withColumn("open", F.col("open") & (F.size("early") == 0))
    told = told.withColumn("late", F.when(F.col("open"), F.concat(_name_problems(), _id_problems())).otherwise(_none()))
    told = told.withColumn("made", F.when(F.col("open") & (F.size("late") == 0), _assembled()))
    return _gated(told, F.concat("typed", "early", "late"))


def normal_names(names: Column) -> Column:
    """Names as they are compared, joined by a mark."""
    return composed(F.array_join(F.transform(names, lambda n: normal_name(F.translate(n, "\x01", " "))), "\x01"))


def _assembled() -> Column:
    """The result of an answer in which all is right: its texts, the chosen candidates' facts once each, the file's own data."""
    chosen = lambda kind, ids: F.filter("found", lambda f: (f["kind"] == kind) & F.array_contains(F.col(ids), f["candidate_id"].cast("long")))
    money = F.transform(chosen("amount", "amountIds"), lambda f: F.struct(f["value"].alias("value"), f["currency"].alias("currency"), f["context"].alias("context")))
    days = F.transform(chosen("date", "dateIds"), lambda f: F.struct(f["date"].alias("date"), f["context"].alias("context")))
    dated = let(days, lambda d: let(F.transform(d, lambda x: F.concat_ws(" ", x["date"], F.translate(x["context"], "»«", ""))), lambda k: F.filter(d, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1)))
    main = F.get(F.filter("found", lambda f: f["candidate_id"].cast("long") == F.get("mainDateId", F.lit(0))), F.lit(0))["date"]
    language, title = F.lower(strip(F.col("language"))), strip(F.col("title"))
    return F.struct(
        strip(F.col("file_name")).alias("file_name"), F.col("pages").alias("pages"), language.alias("language"), F.col("type").alias("type"), fallback_title(title, language).alias("title"), main.alias("date"), strip(F.col("summary")).alias("summary"),
        clean_list(F.col("keyPoints")).alias("key_points"), _different(F.transform(clean_list(F.col("organizations")), full_name)).alias("organizations"), clean_list(F.col("people")).alias("people"),
        F.array_distinct(money).alias("amounts"), dated.alias("dates"), F.slice(clean_list(F.col("keywords")), 1, KEYWORDS).alias("keywords"), (F.size("pages_without_text") == 0).alias("complete"), F.col("pages_without_text").alias("pages_without_text"),
        F.when(F.size("ocr_pages") > 0, F.col("ocr_pages")).alias("ocr_pages"), (F.coalesce(title, F.lit("")) == "").alias("title_fallback"),
    )


def full_name(name: Column) -> Column:
    """A name with its legal form, where the row's texts have exactly one such full name and the name is not the end of a longer one."""
    pattern = full_name_pattern(name)

    def hits(t: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("longer"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("full"))
        return F.transform(F.filter(both, lambda h: h["longer"] == ""), lambda h: collapse(h["full"]))

    found = F.array_distinct(F.flatten(F.transform("texts", hits)))
    return F.when(name.rlike(HAS_LEGAL_FORM), name).otherwise(let(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise(name)))


def _different(names: Column) -> Column:
    """Names in order without those equal to an earlier one but for case."""
    return let(names, lambda own: let(F.transform(own, fold), lambda low: F.filter(own, lambda x, i: F.array_position(low, fold(x)) == i + 1)))


def single_answers(attempts: DataFrame, documents: DataFrame) -> DataFrame:
    """Attempts that give the whole result themselves, judged as compact_answers() are: types, then case, blanks and repeats, then the result's own rules.

    insufficientContent counts even where other fields are missing, because no result is made then.
    """
    v = F.col("payload")
    read = _read(attempts, SINGLE)
    read = read.withColumn("insufficient", F.coalesce((kind_of(child(v, "insufficientContent")) == "BOOLEAN") & child(v, "insufficientContent", "boolean"), F.lit(False)))
    read = read.withColumn("typed", F.when(F.col("insufficient"), _none()).otherwise(F.col("typed")))
    told = read.join(documents.select("doc_id", "file_name", "pages", "pages_without_text"), "doc_id").select("*", *_narrative(v), child(v, "date", "string").alias("date"), child(v, "amounts", _AMOUNTS).alias("amounts"), child(v, "dates", _DATES).alias("dates"))
    language, title, date = F.lower(strip(F.col("language"))), strip(F.col("title")), strip(F.col("date"))
    amounts = F.transform("amounts", lambda a: F.struct(a["value"].alias("value"), F.upper(strip(a["currency"])).alias("currency"), strip(a["context"]).alias("context")))
    dates = F.transform("dates", lambda x: F.struct(strip(x["date"]).alias("date"), strip(x["context"]).alias("context")))
    result = F.struct(
        strip(F.col("file_name")).alias("file_name"), F.col("pages").alias("pages"), language.alias("language"), strip(F.col("type")).alias("type"), fallback_title(title, language).alias("title"), F.nullif(date, F.lit("")).alias("date"), strip(F.col("summary")).alias("summary"),
        clean_list(F.col("keyPoints")).alias("key_points"), clean_list(F.col("organizations")).alias("organizations"), clean_list(F.col("people")).alias("people"), amounts.alias("amounts"), dates.alias("dates"), clean_list(F.col("keywords")).alias("keywords"),
        (F.size("pages_without_text") == 0).alias("complete"), F.col("pages_without_text").alias("pages_without_text"), F.lit(None).cast("array<int>").alias("ocr_pages"), (F.coalesce(title, F.lit("")) == "").alias("title_fallback"),
    )
    right = (F.size("typed") == 0) & F.col("error").isNull() & ~F.col("insufficient")
    return _gated(told.withColumn("made", F.when(right, result)), F.col("typed"))


def _read(attempts: DataFrame, shape) -> DataFrame:
    """Attempts with payload and typed: problems of the answer's JSON and types, or of the call."""
    read = attempts.withColumn("a", F.when(F.col("error").isNull(), answer(F.col("raw")))).withColumn("payload", F.col("a.payload"))
    wrong = F.coalesce(F.when(F.col("error") == "invalid_output", F.lit(NO_ANSWER)), F.col("a.problem"))
    return read.withColumn("typed", F.when(wrong.isNotNull(), F.array(wrong)).when(F.col("error").isNotNull(), _none()).otherwise(problems(F.col("payload"), shape))).drop("a")


def _gated(rows: DataFrame, said: Column) -> DataFrame:
    """Rows with made, a result or null, as judged attempts: the result's own problems come last, and such a result is none."""
    own = F.transform(result_problems(F.col("made")), lambda p: F.concat(p, F.lit(f": {NO_RESULT}")))
    rows = rows.withColumn("last", F.when(F.col("made").isNotNull(), own).otherwise(_none()))
    return rows.select("doc_id", "attempt", "error", "left", "insufficient", F.concat(said, "last").alias("problems"), F.when(F.size("last") == 0, F.col("made")).alias("result"))


def analyses(judged: DataFrame) -> DataFrame:
    """(doc_id, outcome, attempts, problems, result): what each document ends with, of its one or two judged attempts.

    The first attempt decides unless it is invalid; then the second does, if there is time for one. outcome is OK or an error's code; problems are
    those of the attempt that decides. A correction that is asked for but is not there counts as out of time.
    """
    late = (F.col("attempt") == 2) & (F.coalesce(F.col("left"), F.lit(LEAST_SECONDS)) < LEAST_SECONDS)
    outcome = F.when(late, "AI_TIMEOUT")
    for error, code in CODES.items():
        outcome = outcome.when(F.col("error") == error, code)
    outcome = outcome.when(F.col("insufficient"), "INSUFFICIENT_CONTENT").when(F.size("problems") > 0, "AI_INVALID_OUTPUT").otherwise("OK")
    told = judged.filter("attempt IN (1, 2)").withColumn("outcome", outcome).withColumn("invalid", F.col("outcome") == "AI_INVALID_OUTPUT")
    both = told.groupBy("doc_id").agg(*[F.max(F.when(F.col("attempt") == k, F.struct("outcome", "invalid", "problems"))).alias(f"a{k}") for k in (1, 2)], *[F.first(F.when(F.col("attempt") == k, F.col("result")), ignorenulls=True).alias(f"r{k}") for k in (1, 2)])
    again = F.coalesce(F.col("a1.invalid"), F.lit(True))
    second = F.coalesce(F.col("a2.outcome"), F.lit("AI_TIMEOUT"))
    final = F.when(again, second).otherwise(F.col("a1.outcome"))
    return both.select(
        "doc_id", final.alias("outcome"), F.when(again, 2).otherwise(1).alias("attempts"), F.when(again, F.coalesce("a2.problems", _none())).otherwise(F.col("a1.problems")).alias("problems"),
        F.when(final == "OK", F.when(again, F.col("r2")).otherwise(F.col("r1"))).alias("result"),
    )
