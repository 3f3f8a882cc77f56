"""Queries of requests, answers, prompts, saved results and runs, over texts as they are in the tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions.shapes import problems
from ..operators import answers, prompts
from ..operators.chunks import overview_texts
from ..operators.contexts import candidate_contexts
from ..operators.contract import SINGLE, result_value
from ..operators.layout import recognised_documents
from ..operators.requests import answer, result_digest, result_text
from ..operators.rescoring import rescored
from ..sources import pages
from ..sources.requests import request_json, requests
from ..streaming.runs import latest_results


def _empty() -> Column:
    return F.array().cast("array<string>")


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests, as clients might send them: whole, cut off, badly encoded, of wrong types, with a key too much, at odds with themselves."""
    rows = pages.conversations(spark, sf_dir)
    k = F.col("id") % 9
    papers = rows.select("doc_id").distinct().select("doc_id", F.concat(F.lit("rozmowa "), "doc_id", F.lit(".pdf")).alias("file_name"), F.when(F.col("doc_id") % 9 == 6, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("ocr_pages"))
    bodies = request_json(papers, rows).select(F.col("doc_id").alias("id"), F.col("body").cast("string").alias("t"))
    spoilt = (
        F.when(k == 1, F.expr("substring(t, 1, char_length(t) - 1)").cast("binary")).when(k == 2, F.concat(F.col("t").cast("binary"), F.lit(b"\xff"))).when(k == 3, F.regexp_replace("t", r'"pageCount":(\d+)', r'"pageCount":"$1"').cast("binary"))
        .when(k == 4, F.regexp_replace("t", r"\}\z", ',"sure":true}').cast("binary")).when(k == 5, F.regexp_replace("t", r'"pagesWithoutText":\[[^\]]*\]', '"pagesWithoutText":[1]').cast("binary")).when(k == 7, F.concat(F.lit(b"\xef\xbb\xbf"), F.col("t").cast("binary")))
        .when(k == 8, F.concat(F.col("t"), F.lit(" {}")).cast("binary")).otherwise(F.col("t").cast("binary"))
    )
    found = requests(bodies.select("id", spoilt.alias("body")), F.when(F.col("id") % 2 == 0, "compact").otherwise("single"))
    return found.select("id", "verdict", F.regexp_replace(F.array_join("problems", "|"), ": [^|]*", "").alias("where_"), "total_chars", "total_letters", F.size("texts").alias("n_pages"))


def _document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of documents' own texts: the first 240 characters as summary, the first lines as key points. Every fifth has its number in quotes."""
    text = F.coalesce("text", F.lit(""))
    lines = F.slice(F.split(text, "\n"), 1, 8)
    amounts = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('[{"value":"'), "n_chars", F.lit('","currency":"PLN","context":"c"}]'))).otherwise(F.concat(F.lit('[{"value":'), "n_chars", F.lit(',"currency":" pln","context":"c "}]')))
    fields = F.to_json(F.struct(F.lit(False).alias("insufficientContent"), F.concat(F.upper("lang"), F.lit(" ")).alias("language"), F.lit("raport").alias("type"), F.get(lines, F.lit(0)).alias("title"), F.lit(None).cast("string").alias("date"), F.substring(text, 1, 240).alias("summary"), lines.alias("keyPoints"), _empty().alias("organizations"), F.array(F.lit("A"), F.lit("a "), F.lit(" ")).alias("people"), _empty().alias("dates"), _empty().alias("keywords")), {"ignoreNullFields": "false"})
    whole = F.concat(F.regexp_replace(fields, r"\}\z", ""), F.lit(',"amounts":'), amounts, F.lit("}"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(whole.alias("response")))).otherwise(F.concat(F.lit('{"response":'), whole, F.lit("}")))
    return pages.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("attempt"), raw.alias("raw"), F.lit(None).cast("string").alias("error"), F.lit(40.0).alias("left"))


def single_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _document_answers(spark, sf_dir)
    papers = attempts.select("doc_id", F.lit(" a.pdf ").alias("file_name"), F.lit(1).alias("pages"), F.array().cast("array<int>").alias("pages_without_text"))
    out = answers.single_answers(attempts, papers)
    r = F.col("result")
    return out.select("doc_id", F.array_join("problems", "|").alias("problems"), F.size(r["key_points"]).alias("points"), F.md5(r["summary"].cast("binary")).alias("summary"), F.array_join(r["people"], "|").alias("people"), r["language"].alias("language"), r["title_fallback"].alias("untitled"))


def strict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of _document_answers() judged by types alone, with one field gone in every third and a flag in place of the texts in every seventh."""
    d = F.col("doc_id")
    told = _document_answers(spark, sf_dir).select("doc_id", answer(F.col("raw"))["payload"].cast("string").alias("t"))
    t = F.when(d % 3 == 0, F.regexp_replace("t", r'"people":\[[^\]]*\],', "")).when(d % 7 == 0, F.regexp_replace("t", r'"people":\[[^\]]*\]', '"people":[true,1.0]')).otherwise(F.col("t"))
    return told.select("doc_id", F.array_join(problems(F.try_parse_json(t), SINGLE), "|").alias("problems"))


def analysed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with one or two answers each: right at once, after a correction, never, insufficient, and calls that fail."""
    rows, keys = pages.invoices(spark, sf_dir), pages.order_keys(spark, sf_dir)
    d = F.col("doc_id")
    papers = keys.select("doc_id", F.lit("a.pdf").alias("file_name"), F.lit(1).alias("pages"), F.array().cast("array<int>").alias("pages_without_text"), F.array().cast("array<int>").alias("ocr_pages"))

    def told(ids: str, people: str, summary: str, main: str = "1", short: str = "false") -> str:
        return f'{{"insufficientContent":{short},"language":"PL","type":"faktura","title":null,"mainDateId":{main},"summary":"{summary}","keyPoints":["a","b ","A","c"],"organizations":[],"people":[{people}],"keywords":["k"],"amountIds":[{ids}],"dateIds":[3,1]}}'

    fine = told("4,2", "", "Jest faktura. Jest termin. Jest kwota.")
    first = {0: fine, 1: told("2", '"Jan Nikt"', "Raz. Dwa. Trzy."), 2: told("2,2,1,77", "", "Raz. Dwa. Trzy."), 3: told("2", "", "Raz.", short="true"), 5: told("2", "", "⟦A2⟧ jest. Dwa. Trzy."), 6: "no answer", 7: told("2.0", "", "Raz. Dwa. Trzy.")}
    second = {1: fine, 2: told("2", "", "Raz."), 5: fine, 6: fine, 7: told("4", "", "⟦A4⟧ 5 razy. Dwa. Trzy.", "2")}
    pick = lambda of: F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v))])
    k = (d % 8).cast("int")
    one = keys.select("doc_id", F.lit(1).alias("attempt"), F.try_element_at(pick(first), k).alias("raw"), F.when(k == 4, F.when(d % 16 == 4, "quota").otherwise("timeout")).alias("error"), F.lit(50.0).alias("left"))
    two = keys.filter(k.isin(*second)).select("doc_id", F.lit(2).alias("attempt"), F.try_element_at(pick(second), k).alias("raw"), F.lit(None).cast("string").alias("error"), F.when(d % 16 == 6, 3.0).otherwise(20.0).alias("left"))
    judged = answers.compact_answers(one.unionByName(two), answers.bundles(papers, rows, candidate_contexts(rows)))
    out, r = answers.analyses(judged), F.col("result")
    money = F.array_join(F.transform(r["amounts"], lambda a: F.bround(a["value"] * 100, 0).cast("long").cast("string")), "|")
    return out.select("doc_id", "outcome", "attempts", F.array_join("problems", "|").alias("problems"), r["title"].alias("title"), r["date"].alias("date"), money.alias("amounts"), F.array_join(r["dates"]["date"], "|").alias("dates"), F.array_join(r["key_points"], "|").alias("points"))


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which every third turn has lost its letters."""
    turns = pages.conversations(spark, sf_dir)
    return turns.withColumn("text", F.when(F.col("page") % 3 == 0, " 1 ").otherwise(F.col("text")))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blanked(spark, sf_dir)
    papers = prompts.readable(rows).withColumn("ocr_pages", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    plain = prompts.document_messages(papers, rows).withColumn("mode", F.lit("single"))
    marked = prompts.document_messages(papers, rows, "compact").withColumn("mode", F.lit("compact"))
    told = prompts.overview_messages(papers, rows, 300).withColumn("mode", F.lit("overview"))
    return plain.unionByName(marked).unionByName(told).select("doc_id", "mode", F.char_length("message").alias("chars"), F.md5(F.col("message").cast("binary")).alias("digest"))


def digest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a budget that most conversations exceed."""
    return overview_texts(pages.conversations(spark, sf_dir), 1_500).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("text"), "digest")


def canonical_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results: their canonical digest and their text as it is saved. Prices keep their digits, from 0.01 to above 10^7."""
    scale = F.when(F.col("o_orderkey") % 3 == 0, 100.0).otherwise(1.0)
    fields = {
        "file_name": F.concat(F.lit('a"'), "o_orderkey", F.lit(".pdf")), "pages": F.lit(2), "language": F.lit("pl"), "type": F.lit("faktura"), "title": F.lit("Zażółć\tgęślą"), "date": F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")),
        "summary": F.lit("Raz. Dwa. Trzy."), "key_points": F.array(F.lit("a"), F.lit("b"), F.lit("c")), "organizations": _empty(), "people": F.array(F.col("o_orderpriority")),
        "amounts": F.array(F.struct((F.col("o_totalprice") * scale).alias("value"), F.lit("PLN").alias("currency"), F.lit("c").alias("context"))), "dates": F.array().cast("array<struct<date:string,context:string>>"), "keywords": _empty(),
        "complete": F.lit(True), "pages_without_text": F.array().cast("array<int>"), "ocr_pages": F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1), F.lit(2))), "title_fallback": F.lit(False),
    }
    value = result_value(F.struct(*[c.alias(n) for n, c in fields.items()]))
    rows = pages.table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", result_digest(F.col("v")).alias("digest"), F.md5(result_text(F.col("v")).cast("binary")).alias("saved"))


def recognition_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognitions of conversations in which every third turn was lost: the first finds odd ones, the second all, with an edit for pages it may not touch."""
    turns, lost = pages.conversations(spark, sf_dir), _blanked(spark, sf_dir)
    papers = prompts.readable(lost).select("doc_id", "pages_without_text", "ocr_pages")
    machine = turns.select("doc_id", F.lit(0).alias("pos"), "page", F.when(F.col("page") % 2 == 1, F.col("text")).otherwise("..").alias("machine"), F.lit(None).cast("string").alias("edited"))
    papers, texts = recognised_documents(papers, lost, machine)
    again = turns.select("doc_id", F.lit(0).alias("pos"), "page", F.lit("12").alias("machine"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("poprawka "), "page")).alias("edited"))
    papers, texts = recognised_documents(papers, texts, again)
    whole = texts.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").cast("binary")).alias("digest"))
    joined = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    return papers.join(whole, "doc_id").select("doc_id", joined(F.col("pages_without_text")).alias("blank"), joined(F.col("ocr_pages")).alias("recognised"), "digest")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as runs of a day each: a signup begins one, a purchase or a view is its result."""
    kind = F.when(F.col("event_type").isin("purchase", "view"), "result").otherwise("start")
    rows = pages.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_id"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("payload"))
    return latest_results(rows).select("owner", "run_id", "payload")


def shown_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.when(F.col("o_orderstatus") == "F", "PLN").when(F.col("o_orderstatus") == "O", "EUR").otherwise("CHF")
    many = F.sequence(F.lit(1), (F.col("o_orderkey") % 4).cast("int") + 1)
    return pages.table(spark, sf_dir, "orders").select("o_orderkey", display.amount(F.col("o_totalprice"), currency).alias("amount"), display.long_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), display.page_list(many).alias("pages"), display.size(F.col("o_totalprice").cast("long") * 10).alias("size"), display.seconds(F.col("o_orderkey")).alias("took"))


def rescored_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as saved runs: a case with the balance as an expected fact, a response with it, with another one, of a wrong shape or with an error, and reviews."""
    rows = pages.table(spark, sf_dir, "supplier").withColumn("s", F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey") % 6
    plain = F.format_number(F.abs("s_acctbal").cast("decimal(18,2)"), 2)
    written = F.translate(plain, ",.", " ,")
    price = F.translate(plain, ",", "")
    text = F.concat(F.lit("Umowa nr "), "s", F.lit(". Ewa Lis płaci "), written, F.lit(" PLN netto. Termin 12.03.2026 roku."))
    evidence = F.concat(F.lit("płaci "), written, F.lit(" PLN"))
    case = F.concat(
        F.lit('{"id":"'), "s", F.lit('","input":{"request":{"fileName":"a.pdf","pageCount":1,"pages":[{"page":1,"text":"'), text, F.lit('"}],"pagesWithoutText":[]}},"expect":{"document":{"type":"umowa","language":"pl"},"people":["Ewa Lis"],"amounts":[{"value":'), price,
        F.lit(',"currency":"PLN","label":"kwota","page":1,"evidence":"'), evidence, F.lit('","qualifiers":["net"]}],"dates":[{"date":"2026-03-12","label":"termin","page":1,"evidence":"Termin 12.03.2026","event":[["termin"]],"eventReview":"manual"}]}}'),
    )
    given = F.when(k == 1, F.lit("1.5")).otherwise(price)
    context = F.concat(F.lit("s. 1: płaci »"), written, F.lit(" PLN« netto"))
    named = F.when(k == 3, "dnia »12.03.2026«").otherwise("Termin »12.03.2026«")
    response = F.concat(
        F.lit('{"document":{"fileName":"a.pdf","pages":1,"language":"pl","type":"'), F.when(k == 2, "list").otherwise("umowa"), F.lit('","title":"Umowa","date":null},"summary":"Raz. Dwa. Trzy.","keyPoints":["a","b","c"],"entities":{"organizations":[],"people":["Ewa Lis"]},"amounts":[{"value":'), given,
        F.lit(',"currency":"PLN","context":"'), context, F.lit('"}],"dates":[{"date":"2026-03-12","context":"'), named, F.lit('"}],"keywords":[],"analysis":{"complete":true,"pagesWithoutText":[],"titleFallback":false}}'),
    )
    canonical = F.sha2(F.concat(
        F.lit('{"amounts":[{"context":"'), context, F.lit('","currency":"PLN","value":'), F.regexp_replace(F.regexp_replace(price, r"(?<=\.\d)0\z", ""), r"\A\z", "0"), F.lit('}],"analysis":{"complete":true,"pagesWithoutText":[],"titleFallback":false},"dates":[{"context":"'), named,
        F.lit('","date":"2026-03-12"}],"document":{"date":null,"fileName":"a.pdf","language":"pl","pages":1,"title":"Umowa","type":"umowa"},"entities":{"organizations":[],"people":["Ewa Lis"]},"keyPoints":["a","b","c"],"keywords":[],"summary":"Raz. Dwa. Trzy."}'),
    ).cast("binary"), 256)
    dims = ",".join(f'"{d}":{{"verdict":"pass"}}' for d in ("summary_factual", "key_points_factual", "contexts_meaning", "language_fidelity"))
    review = F.concat(F.lit('{"resultSha256":"'), F.when(k == 5, "stale").otherwise(canonical), F.lit(f'","dimensions":{{{dims}}}}}'))
    name = lambda kind: F.concat(F.lit(f"{kind}/"), "s", F.lit(".json"))
    files = rows.select(F.inline(F.array(*[F.struct(name(kind).alias("name"), text.cast("binary").alias("body")) for kind, text in (("cases", case), ("responses", response), ("reviews", review))])))
    runs = rows.select(F.concat(F.lit("run "), "s").alias("label"), F.col("s").alias("case"), name("responses").alias("response"), F.when(k == 4, 502).otherwise(200).alias("http_status"), F.lit(1200).cast("long").alias("latency_ms"), F.when(k != 3, name("reviews")).alias("manual_review"))
    out = rescored(runs, files)
    return out.select("label", "status", "passed", "total", F.array_join("failures", "|").alias("failures"), F.array_join("pending", "|").alias("pending"), F.array_join("schema_problems", "|").alias("ill"))


def queries() -> dict:
    return {
        "requests_conversations": conversation_requests,
        "single_answers_documents": single_answers,
        "strict_answers_documents": strict_answers,
        "analyses_orders": analysed_orders,
        "prompts_conversations": prompt_texts,
        "digests_conversations": digest_texts,
        "canonical_results_orders": canonical_results,
        "recognition_lists_conversations": recognition_lists,
        "latest_results_events": latest_events,
        "display_orders": shown_orders,
        "rescored_supplier": rescored_suppliers,
    }


# Every rule is stated again from the rows; nothing below reads what the queries above make.
_LETTER = r"regexp_matches(coalesce({0}, ''), '\p{{L}}')"
_BLANK_TURNS = rf"""
b AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, CASE WHEN turn % 3 = 2 THEN ' 1 ' ELSE text END AS text FROM conversations),
z AS (SELECT *, {_LETTER.format("text")} AS readable FROM b)"""


def _digest_sql(rows: str, budget: int) -> str:
    """CTEs up to cut (doc_id, page, shown, digest) of rows (doc_id, page, text): shares from the shortest page on, then the last break near each share's end."""
    return rf"""
p AS (SELECT doc_id, page, text, length(text)::INT AS n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY length(text), page) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {rows}),
t AS (SELECT doc_id, r, least(n_chars, {budget} // n) AS share, {budget} - least(n_chars, {budget} // n) AS budget FROM p WHERE r = 1
UNION ALL SELECT p.doc_id, p.r, least(p.n_chars, budget // (p.n - p.r + 1)), budget - least(p.n_chars, budget // (p.n - p.r + 1)) FROM t JOIN p ON p.doc_id = t.doc_id AND p.r = t.r + 1),
s AS (SELECT p.*, share, greatest(share, 1) AS e, greatest(1, greatest(share, 1) - 1000) AS low, max(share < n_chars) OVER (PARTITION BY doc_id) AS digest FROM p JOIN t USING (doc_id, r)),
near AS (SELECT *, reverse(substring(text, (low + 1)::BIGINT, (e - low)::BIGINT)) AS w FROM s),
ends AS (SELECT *, CASE WHEN strpos(w, chr(10) || chr(10)) > 0 THEN strpos(w, chr(10) || chr(10)) WHEN strpos(w, chr(10)) > 0 THEN strpos(w, chr(10)) ELSE strpos(w, ' ') END AS k FROM near),
cut AS (SELECT doc_id, page, digest, CASE WHEN share >= n_chars THEN text ELSE regexp_replace(substring(text, 1, (CASE WHEN k > 0 THEN low + length(w) - k + 1 ELSE e END)::BIGINT), '\s+$', '') || ' […]' END AS shown FROM ends)"""


_NEUTRAL = r"regexp_replace({0}, '(?i)<\s*/?\s*(document|page)\b[^>]*>?', '[tag]', 'g')"
_LISTED = "array_to_string(list(page ORDER BY page) FILTER (NOT readable), ', ')"
_COVER = "CASE WHEN blank IS NULL OR blank = '' THEN 'All pages have extractable text.' ELSE 'Pages without extractable text (not analysed): ' || blank || '.' END"


def _prompts_sql() -> str:
    page = lambda source: rf"""CASE WHEN readable THEN '<page number="' || page || '"' || {source} || '>' || chr(10) || {_NEUTRAL.format("text")} || chr(10) || '</page>' ELSE '<page number="' || page || '" status="no-extractable-text"></page>' END"""
    ocr = """CASE WHEN doc_id % 2 = 0 AND page = 1 THEN ' source="ocr"' ELSE '' END"""
    return rf"""WITH RECURSIVE {_BLANK_TURNS}, readable AS (SELECT doc_id, page, text FROM z WHERE readable), {_digest_sql("readable", 300)},
d AS (SELECT doc_id, count(*) AS n, {_LISTED} AS blank, string_agg({page("''")}, chr(10) ORDER BY page) AS plain, string_agg({page(ocr)}, chr(10) ORDER BY page) AS marked,
  string_agg('<page number="' || page || '" status="no-extractable-text"></page>', chr(10) ORDER BY page) FILTER (NOT readable) AS gone FROM z GROUP BY doc_id),
o AS (SELECT doc_id, max(digest) AS digest, string_agg('<page number="' || page || '">' || chr(10) || {_NEUTRAL.format("shown")} || chr(10) || '</page>', chr(10) ORDER BY page) AS body FROM cut GROUP BY doc_id),
m AS (
  SELECT doc_id, 'single' AS mode, 'The document has ' || n || ' pages. ' || {_COVER} || chr(10) || 'Analyse the document below according to the rules. Return only the JSON object.' || chr(10) || chr(10) || '<document>' || chr(10) || plain || chr(10) || '</document>' AS message FROM d
  UNION ALL SELECT doc_id, 'compact', 'The document has ' || n || ' pages. ' || {_COVER} || CASE WHEN doc_id % 2 = 0 THEN ' Text of pages 1 (marked source="ocr") was recognised by OCR in the user''s browser and may contain recognition errors.' ELSE '' END || chr(10)
    || 'Analyse it according to the rules. Return only the JSON object.' || chr(10) || chr(10) || '<document>' || chr(10) || marked || chr(10) || '</document>' FROM d
  UNION ALL SELECT doc_id, 'overview', 'The document has ' || n || ' pages. ' || {_COVER} || ' ' || CASE WHEN coalesce(digest, false) THEN 'The text below is an excerpt: the beginning of every readable page (marked […]).' ELSE 'The text below is the full readable text.' END || chr(10)
    || 'Describe the document according to the rules. Return only the JSON object.' || chr(10) || chr(10) || '<document>' || chr(10) || concat_ws(chr(10), body, gone) || chr(10) || '</document>' FROM d LEFT JOIN o USING (doc_id)
)
SELECT doc_id, mode, length(message)::INT AS chars, md5(message) AS digest FROM m"""


_MONTHS = "['stycznia', 'lutego', 'marca', 'kwietnia', 'maja', 'czerwca', 'lipca', 'sierpnia', 'września', 'października', 'listopada', 'grudnia']"


def _polish(x: str, most: int) -> str:
    """A number as Polish text, with as many decimals as it needs, at most `most`."""
    text = f"format('{{:.{most}f}}', round({x}, {most})::DOUBLE)"
    whole = f"split_part({text}, '.', 1)"
    grouped = f"CASE WHEN length({whole}) > 4 THEN replace(format('{{:,}}', {whole}::BIGINT), ',', chr(160)) ELSE {whole} END"
    return f"({grouped} || CASE WHEN split_part({text}, '.', 2) = '{'0' * most}' AND {most} = 1 THEN '' ELSE ',' || split_part({text}, '.', 2) END)"


_VALUE = "(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END)::DOUBLE::VARCHAR"
_TITLE = "'Zażółć\\tgęślą'"


def _canonical_sql() -> str:
    date = "CASE WHEN o_orderkey % 2 = 0 THEN '\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"' ELSE 'null' END"
    line = lambda depth, text: f"chr(10) || '{'  ' * depth}' || {text}"
    saved = " || ".join([
        "'{'", line(1, "'\"document\": {'"), line(2, "'\"fileName\": \"a\\\"' || o_orderkey || '.pdf\",'"), line(2, "'\"pages\": 2,'"), line(2, "'\"language\": \"pl\",'"), line(2, "'\"type\": \"faktura\",'"), line(2, f"'\"title\": \"' || {_TITLE} || '\",'"), line(2, f"'\"date\": ' || {date}"), line(1, "'},'"),
        line(1, "'\"summary\": \"Raz. Dwa. Trzy.\",'"), line(1, "'\"keyPoints\": ['"), line(2, "'\"a\",'"), line(2, "'\"b\",'"), line(2, "'\"c\"'"), line(1, "'],'"), line(1, "'\"entities\": {'"), line(2, "'\"organizations\": [],'"), line(2, "'\"people\": ['"), line(3, "'\"' || o_orderpriority || '\"'"), line(2, "']'"), line(1, "'},'"),
        line(1, "'\"amounts\": ['"), line(2, "'{'"), line(3, f"'\"value\": ' || regexp_replace({_VALUE}, '\\.0$', '') || ','"), line(3, "'\"currency\": \"PLN\",'"), line(3, "'\"context\": \"c\"'"), line(2, "'}'"), line(1, "'],'"), line(1, "'\"dates\": [],'"), line(1, "'\"keywords\": [],'"),
        line(1, "'\"analysis\": {'"), line(2, "'\"complete\": true,'"), line(2, "'\"pagesWithoutText\": [],'"), line(2, "'\"titleFallback\": false'"), f"CASE WHEN o_orderkey % 5 = 0 THEN ',' || {line(2, chr(39) + chr(34) + 'ocrPages' + chr(34) + ': [' + chr(39))} || {line(3, chr(39) + '1,' + chr(39))} || {line(3, chr(39) + '2' + chr(39))} || {line(2, chr(39) + ']' + chr(39))} ELSE '' END",
        line(1, "'}'"), line(0, "'}'"), "chr(10)",
    ])
    canonical = f"""'{{"amounts":[{{"context":"c","currency":"PLN","value":' || {_VALUE} || '}}],"analysis":{{"complete":true,' || CASE WHEN o_orderkey % 5 = 0 THEN '"ocrPages":[1,2],' ELSE '' END || '"pagesWithoutText":[],"titleFallback":false}},"dates":[],"document":{{"date":' || {date}
  || ',"fileName":"a\\"' || o_orderkey || '.pdf","language":"pl","pages":2,"title":"' || {_TITLE} || '","type":"faktura"}},"entities":{{"organizations":[],"people":["' || o_orderpriority || '"]}},"keyPoints":["a","b","c"],"keywords":[],"summary":"Raz. Dwa. Trzy."}}'"""
    return f"SELECT o_orderkey, sha256({canonical}) AS digest, md5({saved}) AS saved FROM orders"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+\n', chr(10), 'g'), '[ \t]+$', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

_UNREVIEWED = "'unreviewed: summary_factual|unreviewed: key_points_factual|unreviewed: contexts_meaning|unreviewed: language_fidelity'"


def oracle_sql(sentences: str) -> dict[str, str]:
    """sentences: SQL that gives sentence counts of documents' texts."""
    heads = sentences.replace("FROM documents)", "FROM (SELECT doc_id, substring(coalesce(text, ''), 1, 240) AS text FROM documents))", 1)
    return {
        "requests_conversations": rf"""WITH t AS (
  SELECT conv_id AS id, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, sum(length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g')))::BIGINT AS letters, coalesce(list(turn + 1 ORDER BY turn) FILTER (NOT {_LETTER.format("text")}), []) AS blank, min(turn) = 0 AND max(turn) + 1 = count(*) AS placed FROM conversations GROUP BY conv_id
), w AS (SELECT *, CASE WHEN id % 9 IN (1, 2, 8) THEN 'root' WHEN id % 9 = 3 THEN 'pageCount' WHEN id % 9 = 4 THEN 'sure' WHEN NOT placed OR id % 9 = 5 AND blank <> [1] OR id % 9 = 6 AND list_contains(blank, 1) THEN 'root' ELSE '' END AS where_ FROM t)
SELECT id, CASE WHEN where_ <> '' THEN 'INVALID_REQUEST' WHEN chars > CASE WHEN id % 2 = 0 THEN 30000 ELSE 48000 END THEN 'DOCUMENT_TOO_LONG' WHEN len(blank) = n THEN 'NO_TEXT_LAYER' WHEN id % 9 = 6 AND id % 2 = 1 THEN 'INVALID_REQUEST' WHEN letters < 200 THEN 'INSUFFICIENT_CONTENT' ELSE 'ADMITTED' END AS verdict,
  where_, CASE WHEN where_ = '' THEN chars END AS total_chars, CASE WHEN where_ = '' THEN letters END AS total_letters, CASE WHEN where_ = '' THEN n END::INT AS n_pages FROM w""",
        "single_answers_documents": rf"""WITH counted AS ({heads}),
h AS (SELECT doc_id, lang, regexp_replace(substring(coalesce(text, ''), 1, 240), '^\s+|\s+$', '', 'g') AS summary, list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[1:8], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines,
  regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '^\s+|\s+$', '', 'g') AS title FROM documents),
k AS (SELECT h.*, list_filter(lines, lambda x, i: list_position(list_transform(lines, lambda y: lower(y)), lower(x)) = i) AS points, least, most, closed FROM h JOIN counted USING (doc_id)),
p AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN ['amounts.0.value: Input should be a valid number'] ELSE list_filter([CASE WHEN length(title) > 300 THEN 'document.title: does not match the contract' END, CASE WHEN summary = '' OR NOT closed OR least > 5 OR most < 3 THEN 'summary: does not match the contract' END,
  CASE WHEN len(points) NOT BETWEEN 3 AND 7 OR len(list_filter(points, lambda x: length(x) > 500)) > 0 THEN 'keyPoints: does not match the contract' END], lambda x: x IS NOT NULL) END AS problems FROM k)
SELECT doc_id, array_to_string(problems, '|') AS problems, CASE WHEN len(problems) = 0 THEN len(points) END::INT AS points, CASE WHEN len(problems) = 0 THEN md5(summary) END AS summary, CASE WHEN len(problems) = 0 THEN 'A' END AS people, CASE WHEN len(problems) = 0 THEN lower(lang) END AS language,
  CASE WHEN len(problems) = 0 THEN title = '' END AS untitled FROM p""",
        "strict_answers_documents": """SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 3 = 0 THEN 'people: Field required' WHEN doc_id % 7 = 0 THEN 'people.0: Input should be a valid string|people.1: Input should be a valid string' END,
CASE WHEN doc_id % 5 = 0 THEN 'amounts.0.value: Input should be a valid number' END) AS problems FROM documents""",
        "analyses_orders": """WITH r AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k, o_orderkey % 16 AS h, o_totalprice::DECIMAL(18,2) AS price, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS due, strftime(o_orderdate::DATE, '%Y-%m-%d') AS placed FROM orders),
c AS (SELECT *, CASE WHEN k IN (2, 7) THEN 'AI_INVALID_OUTPUT' WHEN k = 3 THEN 'INSUFFICIENT_CONTENT' WHEN h = 4 THEN 'AI_QUOTA_EXCEEDED' WHEN h = 12 OR h = 6 THEN 'AI_TIMEOUT' ELSE 'OK' END AS outcome FROM r)
SELECT doc_id, outcome, CASE WHEN k IN (0, 3, 4) THEN 1 ELSE 2 END AS attempts, CASE k WHEN 2 THEN 'summary: must contain 3-5 sentences ending with punctuation' WHEN 7 THEN 'mainDateId.0: id 2 is not a date candidate' ELSE '' END AS problems, CASE WHEN outcome = 'OK' THEN 'Dokument bez tytułu' END AS title,
  CASE WHEN outcome = 'OK' THEN due END AS date, CASE WHEN outcome = 'OK' THEN round(price * 100)::BIGINT || '|' || ((doc_id % 900 + 100) * 100 + 50) END AS amounts, CASE WHEN outcome = 'OK' THEN due || '|' || placed END AS dates, CASE WHEN outcome = 'OK' THEN 'a|b|c' END AS points FROM c""",
        "prompts_conversations": _prompts_sql(),
        "digests_conversations": rf"""WITH RECURSIVE readable AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, text FROM conversations WHERE {_LETTER.format("text")}), {_digest_sql("readable", 1500)} SELECT doc_id, page, md5(shown) AS text, digest FROM cut""",
        "canonical_results_orders": _canonical_sql(),
        "recognition_lists_conversations": rf"""WITH {_BLANK_TURNS},
o AS (SELECT z.*, CASE WHEN z.page % 2 = 1 THEN {_CLEAN.format("c.text")} ELSE '..' END AS found FROM z JOIN conversations c ON c.conv_id = z.doc_id AND c.turn + 1 = z.page),
a AS (SELECT doc_id, page, NOT readable AND {_LETTER.format("found")} AS one, CASE WHEN NOT readable AND {_LETTER.format("found")} THEN found ELSE text END AS text FROM o),
e AS (SELECT *, NOT {_LETTER.format("text")} AND doc_id % 4 > 0 AS two FROM a),
f AS (SELECT doc_id, page, one OR two AS taken, CASE WHEN two THEN 'poprawka ' || page ELSE text END AS text FROM e)
SELECT doc_id, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (NOT {_LETTER.format("text")}), '') AS blank, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (taken), '') AS recognised, md5(string_agg(text, chr(10) ORDER BY page)) AS digest FROM f GROUP BY doc_id""",
        "latest_results_events": """WITH e AS (SELECT user_id AS owner, (ts::DATE - DATE '1970-01-01')::BIGINT AS run_id, event_type IN ('purchase', 'view') AS result, ts, event_id FROM events), m AS (SELECT owner, max(run_id) AS run_id FROM e GROUP BY owner)
SELECT owner, run_id, arg_max(event_id, ts)::VARCHAR AS payload FROM e JOIN m USING (owner, run_id) WHERE result GROUP BY owner, run_id""",
        "display_orders": f"""SELECT o_orderkey, {_polish("o_totalprice::DECIMAL(18,2)", 2)} || chr(160) || CASE o_orderstatus WHEN 'F' THEN 'zł' WHEN 'O' THEN '€' ELSE 'CHF' END AS amount, day(o_orderdate) || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) AS date,
['1', '1 i 2', '1, 2 i 3', '1, 2, 3 i 4'][o_orderkey % 4 + 1] AS pages, CASE WHEN trunc(o_totalprice)::BIGINT * 10 < 1048576 THEN greatest(1, floor(trunc(o_totalprice)::BIGINT * 10 / 1024 + 0.5)::BIGINT) || ' KB' ELSE {_polish("(trunc(o_totalprice)::BIGINT * 10 / 1048576)::DECIMAL(18,6)", 1)} || ' MB' END AS size,
{_polish("(o_orderkey / 1000)::DECIMAL(18,6)", 1)} || ' s' AS took FROM orders""",
        "rescored_supplier": f"""WITH s AS (SELECT s_suppkey, s_suppkey % 6 AS k FROM supplier)
SELECT 'run ' || s_suppkey AS label, CASE k WHEN 0 THEN 'accepted' WHEN 3 THEN 'needs_manual_review' WHEN 5 THEN 'needs_manual_review' ELSE 'failed' END AS status, CASE k WHEN 0 THEN 17 WHEN 1 THEN 13 WHEN 3 THEN 16 WHEN 5 THEN 17 ELSE 0 END::BIGINT AS passed, CASE k WHEN 0 THEN 17 WHEN 1 THEN 16 WHEN 3 THEN 16 WHEN 5 THEN 17 ELSE 0 END::BIGINT AS total,
  CASE k WHEN 1 THEN 'checks' WHEN 2 THEN 'schema' WHEN 4 THEN 'HTTP 502' ELSE '' END AS failures, CASE WHEN k IN (1, 5) THEN {_UNREVIEWED} WHEN k = 3 THEN {_UNREVIEWED} || '|termin: event' ELSE '' END AS pending,
  CASE WHEN k = 2 THEN 'document.type: Input should be ''faktura'', ''umowa'', ''oferta'', ''raport'' or ''inne''' WHEN k <> 4 THEN '' END AS ill FROM s""",
    }
