"""Results against what their documents must give: checks, verdicts, and evidence for a reviewer.

Results: one row a doc_id, as in validation.SCHEMA. Expected facts: (doc_id, pos, kind, value, currency, date, qualifiers, page, evidence, label);
kind: "amount" or "date". Checks: (doc_id, category, name, ok, manual); manual: only a reviewer can fail it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import strip
from ..functions.text import collapse, first_place, let, matches
from .selection import attested
from .tokens import amount_tokens, amounts, date_tokens, dates, stated
from .validation import result_problems

# Words of qualifiers, groups that exclude each other, negations, legal forms, dates in contexts, dimensions of a review, limits.
QUALIFIERS = {
    "net": (r"\bnetto\b", r"\bnet\b"), "gross": (r"\bbrutto\b", r"\bgross\b"), "vat": (r"\bvat\b", r"podat"), "monthly": (r"mies", r"month"),
    "yearly": (r"rocz", r"\brok\b", r"/rok", r"year", r"annual"), "one-off": (r"jednoraz", r"one-off", r"one time"),
    "daily": (r"każdy dzień", r"dzienn", r"\bper day\b", r"daily", r"za dzień"), "rejected": (r"odrzuc", r"reject"), "budget": (r"budżet", r"budget"),
    "capital": (r"kapitał", r"capital"), "advance": (r"zaliczk", r"advance"),
    "maximum": (r"maks", r"nie więcej", r"nie może przekroczyć", r"\blimit", r"\bcap\b", r"maximum"), "penalty": (r"\bkar[ay]?\b", r"\bkara", r"penalt"),
}
EXCLUSIVE = (("net", "gross"), ("monthly", "yearly", "one-off", "daily"))
NEGATIONS = (r"nie dotyczy", r"\bn/a\b", r"not applicable", r"brak danych")
LEGAL_FORMS = (r"sp\. ?z ?o\.? ?o\.?", r"sp\. ?k\.", r"s\.a\.", r"s\.k\.a\.", r"gmbh", r"\bltd\b", r"\binc\b")
DATE_IN_CONTEXT = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}\s+(?iu:[a-ząćęłńóśźż]+)\s+\d{4}"
SENTENCE_BREAK = r"[.!?;]\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ])"
LEAD = r"^s\. \d+: (?:\[[^\]]*\] )?"
POLISH = "aąbcćdeęfghijklłmnńoóprsśtuwyzźżqvx"
DIMENSIONS = ("summary_factual", "key_points_factual", "contexts_meaning", "language_fidelity")
LATENCY_MS = 30_000
# End of the fixed values.


def _folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def qualifiers(context: Column) -> Column:
    """Array of the qualifiers that a context names."""
    told = lambda low: F.array_compact(F.array(*[F.when(low.rlike("(?U)" + "|".join(f"(?:{x})" for x in shapes)), key) for key, shapes in QUALIFIERS.items()]))
    return let(_folded(context), told)


def segment(context: Column) -> Column:
    """The part of a context that belongs to its one marked »value«: from the value or sentence end before it to the next. Null without exactly one mark."""
    one = (F.char_length(F.regexp_replace(context, "[^»]", "")) == 1) & (F.char_length(F.regexp_replace(context, "[^«]", "")) == 1) & context.rlike("»[^»«]+«")
    left = F.regexp_replace(F.substring_index(context, "»", 1), LEAD, "")
    mark, right = F.regexp_extract(context, "»([^»«]+)«", 1), F.substring_index(context, "«", -1)

    def values(text: Column) -> Column:
        """(start, end) of the amounts with a currency beside them or two decimals, and of the dates."""
        told = F.filter(amount_tokens(text), lambda t: t["adjacent"] | t["text"].rlike(r"[.,]\d{2}\z"))
        span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
        return F.concat(F.transform(told, span), F.transform(matches(text, DATE_IN_CONTEXT), span))

    def behind_last(text: Column) -> Column:
        ends = F.concat(F.transform(values(text), lambda m: m["end"]), F.transform(matches(text, SENTENCE_BREAK), lambda m: m["end"]))
        return F.substring(text, F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.char_length(text))

    def to_first(text: Column) -> Column:
        stops = F.concat(F.transform(values(text), lambda m: m["start"]), F.transform(matches(text, SENTENCE_BREAK), lambda m: m["start"] + 1))
        return F.substring(text, F.lit(1), F.coalesce(F.array_min(stops), F.char_length(text)))

    return F.when(one, F.concat(let(left, behind_last), mark, let(right, to_first)))


def associated(context: Column) -> Column:
    return F.coalesce(segment(context), context)


def mark_matches(context: Column, value: Column, currency: Column) -> Column:
    """Whether the marked text is this value, in this currency if it names one. A context without a mark matches."""
    inside = let(F.regexp_extract(context, "»([^»«]+)«", 1), amount_tokens)
    same = F.exists(inside, lambda t: (F.bround(t["value"], 2) == F.bround(value.cast("decimal(38,2)"), 2)) & F.coalesce(t["currency"] == currency, F.lit(True)))
    return ~context.rlike("»[^»«]+«") | same


def judged_context(context: Column, expected: Column, value: Column, currency: Column) -> Column:
    """Struct (found, problems): the qualifiers that a context names for its value, and what speaks against it: another marked value, qualifiers that
    exclude each other or the expected one, a negation."""

    def clash(found: Column, group: tuple[str, ...]) -> Column:
        members = F.array(*map(F.lit, group))
        present = F.array_intersect(found, members)
        other = (F.size(present) > 0) & F.arrays_overlap(expected, members) & (F.size(F.array_except(present, expected)) > 0)
        return F.when((F.size(present) > 1) | other, F.array_join(F.array_sort(present), "/"))

    def judged(j: Column) -> Column:
        return F.struct(j["found"].alias("found"), F.array_compact(F.array(F.when(~mark_matches(context, value, currency), "marked value"), *[clash(j["found"], g) for g in EXCLUSIVE], F.when(j["negated"], "negation"))).alias("problems"))

    negated = lambda told: _folded(told).rlike("(?U)" + "|".join(f"(?:{x})" for x in NEGATIONS))
    return let(let(associated(context), lambda told: F.struct(qualifiers(told).alias("found"), negated(told).alias("negated"))), judged)


def best_entries(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected facts with n (entries of the result with their value and currency, or date), context, found and problems of the best one: most
    expected qualifiers, then fewest contradictions, then the first. Entries are never pooled; entries meet facts by value, so nothing multiplies."""
    amount = results.select("doc_id", F.posexplode("amounts").alias("ord", "x")).select("doc_id", "ord", F.lit("amount").alias("kind"), F.col("x.value").cast("decimal(38,2)").alias("v"), F.col("x.currency").alias("c"), F.col("x.context").alias("context"))
    date = results.select("doc_id", F.posexplode("dates").alias("ord", "x")).select("doc_id", "ord", F.lit("date").alias("kind"), F.lit(None).cast("decimal(38,2)").alias("v"), F.col("x.date").alias("c"), F.col("x.context").alias("context"))
    asked = expected.withColumns({"v": F.col("value").cast("decimal(38,2)"), "c": F.when(F.col("kind") == "amount", F.col("currency")).otherwise(F.col("date").cast("string")), "qualifiers": F.coalesce("qualifiers", F.array().cast("array<string>"))})
    entry = amount.unionByName(date)
    same = (asked["doc_id"] == entry["doc_id"]) & (asked["kind"] == entry["kind"]) & (asked["c"] == entry["c"]) & asked["v"].eqNullSafe(entry["v"])
    met = asked.join(entry, same).select(asked["doc_id"], asked["kind"], "pos", "qualifiers", entry["v"], entry["c"], "ord", "context")
    met = met.withColumn("_j", judged_context(F.col("context"), F.col("qualifiers"), F.col("v"), F.col("c")))
    met = met.select("*", F.col("_j.found").alias("found"), F.when(F.col("kind") == "amount", F.col("_j.problems")).otherwise(F.array().cast("array<string>")).alias("problems"))
    rank = F.struct(F.size(F.array_intersect("found", "qualifiers")), -F.size("problems"), -F.col("ord"))
    best = met.groupBy("doc_id", "kind", "pos").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("context", "found", "problems"), rank).alias("_b"))
    out = asked.drop("v", "c").join(best, ["doc_id", "kind", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"context": F.col("_b.context"), "found": F.col("_b.found"), "problems": F.col("_b.problems")}).drop("_b")


def _row(category: str, name: Column, ok: Column, manual: Column | None = None) -> list[Column]:
    return ["doc_id", F.lit(category).alias("category"), name.alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), (F.lit(False) if manual is None else F.coalesce(manual, F.lit(False))).alias("manual")]


def fact_checks(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Checks of every expected fact: present, each qualifier on its one best entry, and nothing against it. A date's event (array of groups of
    patterns, optional column) must be named by one entry: one pattern of each group."""
    best = best_entries(expected, results)
    # a fact's checks are made in its row, so that entries are met and judged once
    check = lambda category, name, ok: F.struct(category.alias("category"), name.alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(False).alias("manual"))
    amount, none = F.col("kind") == "amount", F.array().cast("array<struct<category:string,name:string,ok:boolean,manual:boolean>>")
    present = F.array(check(F.concat("kind", F.lit("s")), F.concat(F.lit("present: "), "label"), F.col("n") > 0))
    told = F.when(amount, F.transform("qualifiers", lambda q: check(F.lit("qualifiers"), F.concat("label", F.lit(": "), q), F.array_contains("found", q)))).otherwise(none)
    clean = F.when(amount & (F.col("n") > 0), F.array(check(F.lit("qualifiers"), F.concat("label", F.lit(": no contradiction")), F.size("problems") == 0))).otherwise(none)
    out = best.select("doc_id", F.inline(F.concat(present, told, clean)))
    return out.unionByName(event_checks(expected, results)) if "event" in expected.columns else out


def event_checks(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Checks of dates' events. With event_review "manual" (an optional column), an event that a date's entries do not name is asked of a reviewer."""
    review = F.col("event_review") if "event_review" in expected.columns else F.lit(None).cast("string")
    asked = expected.filter("kind = 'date' AND size(event) > 0").select("doc_id", "pos", "label", F.col("date").cast("string").alias("date"), "event", review.alias("_review"))
    entries = results.select("doc_id", F.inline("dates")).select("doc_id", "date", _folded(F.col("context")).alias("_context"))
    named = F.forall("event", lambda group: F.exists(group, lambda shape: F.regexp_like(F.col("_context"), F.concat(F.lit("(?U)"), shape))))
    met = asked.join(entries, ["doc_id", "date"], "left")
    judged = met.groupBy("doc_id", "pos", "label").agg(F.max(F.coalesce(named, F.lit(False))).alias("_ok"), F.max(F.col("_context").isNotNull() & F.coalesce(F.col("_review") == "manual", F.lit(False))).alias("_asked"))
    return judged.select(*_row("dates", F.concat("label", F.lit(": event")), F.col("_ok"), F.col("_asked") & ~F.col("_ok")))


def forbidden_checks(forbidden: DataFrame, results: DataFrame) -> DataFrame:
    """Checks that amounts (doc_id, value, currency) that must not come out are not in the results."""
    given = results.select("doc_id", F.inline("amounts")).select("doc_id", F.col("value").cast("decimal(38,2)").alias("v"), "currency").distinct().withColumn("_hit", F.lit(True))
    asked = forbidden.withColumn("v", F.col("value").cast("decimal(38,2)"))
    return asked.join(given, ["doc_id", "v", "currency"], "left").select(*_row("injection", F.concat_ws(" ", F.lit("no amount"), F.col("v").cast("string"), "currency"), F.col("_hit").isNull()))


def ungrounded(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, kind, fact): amounts, dates and people of results that the source does not state."""
    money = results.select("doc_id", F.inline("amounts")).select("doc_id", F.col("value").cast("decimal(38,2)").alias("value"), "currency").distinct()
    days = results.select("doc_id", F.explode(F.array_compact(F.concat(F.transform("dates", lambda d: d["date"]), F.array("date")))).alias("raw")).distinct().withColumn("date", F.col("raw").try_cast("date"))
    people = results.select("doc_id", F.posexplode("people").alias("pos", "name"))
    lost = money.join(stated(money, amounts(pages)), ["doc_id", "value", "currency"], "left_anti").select("doc_id", F.lit("amount").alias("kind"), F.concat_ws(" ", F.col("value").cast("string"), "currency").alias("fact"))
    late = days.join(stated(days, dates(pages)).select("doc_id", "raw"), ["doc_id", "raw"], "left_anti").select("doc_id", F.lit("date").alias("kind"), F.col("raw").alias("fact"))
    # a name may go on over the end of a page
    parts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_p"))
    whole = parts.select("doc_id", F.lit(1).alias("page"), F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"))
    unknown = attested(people, whole).filter("NOT attested").select("doc_id", F.lit("person").alias("kind"), F.col("name").alias("fact"))
    return lost.unionByName(late).unionByName(unknown)


def grounding_checks(results: DataFrame, pages: DataFrame) -> DataFrame:
    """One check for each kind of fact and document."""
    kinds = results.select("doc_id", F.explode(F.array(F.lit("amount"), F.lit("date"), F.lit("person"))).alias("kind"))
    bad = ungrounded(results, pages).groupBy("doc_id", "kind").agg(F.lit(True).alias("_bad"))
    return kinds.join(bad, ["doc_id", "kind"], "left").select(*_row("grounding", F.concat(F.lit("every "), "kind", F.lit(" is in the source")), F.col("_bad").isNull()))


def result_checks(results: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Checks of a result's own fields, in one pass. documents: (doc_id, file_name, pages, pages_without_text); cases: (doc_id, expect), expect a struct of
    type, language, date, title_contains, organizations, people, legal_forms, forbidden_narrative; nulls ask for nothing."""
    d, e = F.struct(strip(F.col("file_name")).alias("file_name"), "pages", "pages_without_text").alias("_d"), F.col("expect")
    joined = results.join(documents.select("doc_id", d), "doc_id").join(cases.select("doc_id", "expect"), "doc_id", "left")
    check = lambda category, name, ok: F.struct(F.lit(category).alias("category"), (F.lit(name) if isinstance(name, str) else name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"))
    plain = lambda names: F.transform(names, lambda n: _folded(collapse(n)))
    narrative = F.concat_ws(" ", _folded(F.col("summary")), _folded(F.array_join("key_points", " ")))
    visible = F.concat_ws("", "title", "summary", F.array_join("key_points", ""), F.array_join("keywords", ""), F.array_join("organizations", ""), F.array_join("people", ""))
    fixed = F.array(
        check("metadata", "file_name", F.col("file_name") == F.col("_d.file_name")), check("metadata", "pages", F.col("pages") == F.col("_d.pages")),
        check("coverage", "pages_without_text", F.col("pages_without_text") == F.col("_d.pages_without_text")), check("coverage", "complete", F.col("complete") == (F.size("_d.pages_without_text") == 0)),
        check("language", "no marks", ~visible.rlike("[⟦⟧]")),
    )
    each = lambda values, make: F.transform(F.coalesce(values, F.array().cast("array<string>")), make)
    told = F.array_compact(F.array(*[F.when(e[c].isNotNull(), check("document", c, F.col(c) == e[c])) for c in ("type", "language", "date")]))
    title = each(e["title_contains"], lambda x: check("document", F.concat(F.lit("title: "), x), F.contains("title", x)))
    firms = each(e["organizations"], lambda x: check("organizations", x, F.array_contains(plain(F.col("organizations")), _folded(collapse(x)))))
    people = each(e["people"], lambda x: check("people", x, F.array_contains(plain(F.col("people")), _folded(collapse(x)))))
    legal = F.forall("organizations", lambda o: _folded(o).rlike("(?U)" + "|".join(LEGAL_FORMS)))
    forms = F.when(e["legal_forms"], F.array(check("organizations", "legal forms", legal))).otherwise(F.array().cast("array<struct<category:string,name:string,ok:boolean>>"))
    kept = each(e["forbidden_narrative"], lambda x: check("injection", F.concat(F.lit("free of "), x), ~F.regexp_like(narrative, F.concat(F.lit("(?U)"), x))))
    return joined.select("doc_id", F.inline(F.concat(fixed, told, title, firms, people, forms, kept))).withColumn("manual", F.lit(False))


def case_problems(expected: DataFrame, pages: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, problem) of expected facts that their own source does not bear out: "page", "evidence" or "fact".

    unreadable: (doc_id, page). Each fact meets the one page it cites, and that page's tokens by value only.
    """
    texts = pages.join(unreadable, ["doc_id", "page"], "left_anti").select("doc_id", "page", collapse(_folded(F.col("text"))).alias("_text"))
    asked = expected.join(texts, ["doc_id", "page"], "left")
    quoted = (F.char_length("evidence") > 0) & F.col("_text").contains(collapse(_folded(F.col("evidence"))))
    value = F.col("value").cast("decimal(38,2)")
    inside = F.when(F.col("kind") == "amount", F.exists(let(F.col("evidence"), amount_tokens), lambda t: F.bround(t["value"], 2) == value)).otherwise(F.exists(let(F.col("evidence"), date_tokens), lambda t: t["date"].cast("string") == F.col("date").cast("string")))
    asked = asked.select("doc_id", "page", "kind", "pos", value.alias("value"), "currency", F.col("_text").isNotNull().alias("_read"), F.coalesce(quoted, F.lit(False)).alias("_quoted"), F.coalesce(inside, F.lit(False)).alias("_inside"))
    there = amounts(pages).select("doc_id", "page", F.bround("value", 2).cast("decimal(38,2)").alias("value"), "currency").distinct().withColumn("_there", F.lit(True))
    judged = asked.join(there, ["doc_id", "page", "value", "currency"], "left")
    borne = F.col("_inside") & ((F.col("kind") == "date") | F.col("_there").isNotNull())
    return judged.select("doc_id", "kind", "pos", F.when(~F.col("_read"), "page").when(~F.col("_quoted"), "evidence").when(~borne, "fact").alias("problem")).filter("problem IS NOT NULL")


def evidence_pattern(evidence: Column) -> Column:
    """A Java pattern that finds a quote's words with any blanks between them."""
    words = F.filter(F.split(evidence, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), r"\s+"))


def ideal_selection(expected: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """expected (doc_id, kind, pos) with candidate_id: the first candidate that begins inside the cited evidence and has the fact, or null.

    It answers for a model, so that everything behind the model can be tested. Candidates meet facts by page and value; the range is judged then.
    """
    asked = expected.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    spans = asked.withColumns({"_at": first_place(F.col("text"), evidence_pattern(F.col("evidence"))), "_v": F.col("value").cast("decimal(38,2)"), "_c": F.when(F.col("kind") == "amount", F.col("currency")).otherwise(F.col("date").cast("string"))})
    seen = found.select("doc_id", "page", "kind", "candidate_id", F.col("start").alias("_start"), F.col("value").cast("decimal(38,2)").alias("_v"), F.when(F.col("kind") == "amount", F.col("currency")).otherwise(F.col("date").cast("string")).alias("_c"))
    same = [spans[c] == seen[c] for c in ("doc_id", "page", "kind", "_c")] + [spans["_v"].eqNullSafe(seen["_v"]), seen["_start"] >= spans["_at.start"], seen["_start"] < spans["_at.end"]]
    first = spans.join(seen, same).groupBy(spans["doc_id"], spans["kind"], spans["pos"]).agg(F.min("candidate_id").alias("candidate_id"))
    return expected.select("doc_id", "kind", "pos").join(first, ["doc_id", "kind", "pos"], "left")


def rebuilt_selection(results: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, candidate_id) that saved results were made of: the first candidate with the same fact and context."""
    told = lambda kind, fact, context: F.struct(F.lit(kind).alias("kind"), fact.alias("fact"), context.alias("context"))
    money = F.transform("amounts", lambda a: told("amount", F.concat_ws(" ", a["value"].cast("decimal(38,2)").cast("string"), a["currency"]), a["context"]))
    days = F.transform("dates", lambda d: told("date", d["date"].cast("string"), F.translate(d["context"], "»«", "")))
    none = F.array().cast("array<struct<kind:string,fact:string,context:string>>")
    asked = results.select("doc_id", F.inline(F.concat(F.coalesce(money, none), F.coalesce(days, none))))
    fact = F.when(F.col("kind") == "amount", F.concat_ws(" ", F.col("value").cast("decimal(38,2)").cast("string"), "currency")).otherwise(F.col("date").cast("string"))
    seen = found.select("doc_id", "kind", "candidate_id", fact.alias("fact"), F.when(F.col("kind") == "date", F.translate("context", "»«", "")).otherwise(F.col("context")).alias("context"))
    # all candidates with their contexts are estimated by the table they were made of: without the hint, the driver would gather and broadcast them
    return asked.join(seen.hint("merge"), ["doc_id", "kind", "fact", "context"]).groupBy("doc_id", "kind", "fact", "context").agg(F.min("candidate_id").alias("candidate_id")).drop("fact", "context")


def verdicts(runs: DataFrame, checks: DataFrame, problems: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, status, passed, total, failures, pending) of runs (doc_id, http_status, latency_ms, digest, and a result's columns).

    failed: any failure; needs_manual_review: nothing failed, but something is not judged; accepted: all passed, timed and reviewed for exactly this
    result. reviews: (doc_id, digest, dimension, verdict). checks and problems fold by document on the map side.
    """
    judged = checks.withColumn("_asked", F.col("manual") & ~F.col("ok"))
    counted = judged.groupBy("doc_id").agg(F.count_if(F.col("ok") & ~F.col("_asked")).alias("passed"), F.count_if(~F.col("_asked")).alias("total"), F.array_sort(F.collect_set(F.when(F.col("_asked"), F.col("name")))).alias("_subchecks"))
    ill = problems.groupBy("doc_id").agg(F.lit(True).alias("_ill"))
    exact = reviews.join(runs.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").filter(F.col("dimension").isin(*DIMENSIONS))
    seen = exact.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("dimension", "verdict"))).alias("_seen"))
    all_ = runs.withColumn("_schema", F.size(result_problems()) > 0).join(counted, "doc_id", "left").join(ill, "doc_id", "left").join(seen, "doc_id", "left")
    verdict = lambda d: F.coalesce(F.try_element_at("_seen", d), F.lit(""))
    dims = F.array(*map(F.lit, DIMENSIONS))
    slow = F.col("latency_ms") >= LATENCY_MS
    dead = (F.col("http_status") != 200) | F.col("_schema")
    failures = F.concat(
        F.array_compact(F.array(F.when(F.col("_ill"), "case"), F.when(F.col("http_status") != 200, F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).when(F.col("_schema"), "schema"))),
        F.when(~dead, F.concat(F.array_compact(F.array(F.when((F.col("passed") < F.col("total")) | slow, "checks"))), F.transform(F.filter(dims, lambda d: verdict(d) == "fail"), lambda d: F.concat(F.lit("review: "), d)))).otherwise(F.array().cast("array<string>")),
    )
    open_ = F.transform(F.filter(dims, lambda d: ~verdict(d).isin("pass", "fail")), lambda d: F.concat(F.lit("unreviewed: "), d))
    sub = F.when(verdict(F.lit("contexts_meaning")).isin("pass", "fail"), F.array().cast("array<string>")).otherwise(F.coalesce("_subchecks", F.array().cast("array<string>")))
    pending = F.when(dead, F.array().cast("array<string>")).otherwise(F.concat(F.array_compact(F.array(F.when(F.col("latency_ms").isNull(), "latency"))), open_, sub))
    timed = F.when(F.col("latency_ms").isNotNull() & ~dead, 1).otherwise(0)
    out = all_.select("doc_id", (F.coalesce("passed", F.lit(0)) + F.when(slow, 0).otherwise(timed)).alias("passed"), (F.coalesce("total", F.lit(0)) + timed).alias("total"), failures.alias("failures"), pending.alias("pending"))
    return out.withColumn("status", F.when(F.size("failures") > 0, "failed").when(F.size("pending") > 0, "needs_manual_review").otherwise("accepted"))


def review_evidence(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, field, pos, text, told, in_source): what helps a reviewer. Numbers and dates of the narrative and dates of contexts with whether the source has
    them, contexts of amounts with the qualifiers named, and in Polish documents the letters from outside its alphabet."""
    said = results.select("doc_id", F.posexplode(F.concat(F.array("summary"), F.col("key_points"))).alias("pos", "body"))
    numbers = said.select("doc_id", F.lit("number").alias("field"), "pos", F.explode(let(F.col("body"), amount_tokens)).alias("t")).select("doc_id", "field", "pos", F.col("t.text").alias("text"), F.col("t.value").alias("v"))
    there = amounts(pages).select("doc_id", F.col("value").alias("v")).distinct().withColumn("_in", F.lit(True))
    numbers = numbers.join(there, ["doc_id", "v"], "left").select("doc_id", "field", "pos", "text", F.lit(None).cast("string").alias("told"), F.col("_in").isNotNull().alias("in_source"))
    told_days = said.select("doc_id", "pos", F.explode(let(F.col("body"), date_tokens)).alias("t")).select("doc_id", F.lit("narrative date").alias("field"), "pos", F.col("t.text").alias("text"), F.col("t.date").cast("string").alias("told"))
    money = results.select("doc_id", F.lit("amount").alias("field"), F.posexplode("amounts").alias("pos", "x")).select("doc_id", "field", "pos", associated(F.col("x.context")).alias("text"), F.array_join(F.array_sort(let(associated(F.col("x.context")), qualifiers)), ",").alias("told"), F.lit(None).cast("boolean").alias("in_source"))
    days = dates(pages).select("doc_id", F.col("date").cast("string").alias("told")).distinct().withColumn("_in", F.lit(True))
    dated = results.select("doc_id", F.lit("date").alias("field"), F.posexplode("dates").alias("pos", "x")).select("doc_id", "field", "pos", F.col("x.context").alias("text"), F.col("x.date").alias("told"))
    dated = dated.unionByName(told_days).join(days, ["doc_id", "told"], "left").select("doc_id", "field", "pos", "text", "told", F.col("_in").isNotNull().alias("in_source"))
    body = F.concat_ws("", "summary", F.array_join("key_points", ""), F.array_join(F.transform("amounts", lambda a: a["context"]), ""), F.array_join(F.transform("dates", lambda a: a["context"]), ""))
    odd = F.array_sort(F.array_distinct(F.split(F.regexp_replace(body, rf"(?iu)[^\p{{L}}]|[{POLISH}]", ""), "")))
    letters = results.filter("language = 'pl'").select("doc_id", F.lit("letters").alias("field"), F.lit(0).alias("pos"), F.array_join(odd, "").alias("text"), F.lit(None).cast("string").alias("told"), F.lit(None).cast("boolean").alias("in_source")).filter("text <> ''")
    return numbers.unionByName(money).unionByName(dated).unionByName(letters)
