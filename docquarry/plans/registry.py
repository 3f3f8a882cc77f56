"""The queries of the fact extraction operators and the SQL that checks them.

Where text was rendered from a table, the SQL states what must be found from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import distinct_organisations, provider_problem
from ..functions.sentences import ABBREVIATIONS, sentence_interval
from ..functions.text import clean_recognised, safe_name
from ..operators.admission import admit, totals
from ..operators.candidates import candidates, running_lines
from ..operators.checks import check_scores, crowded_minutes, limited_minutes, selection_problems
from ..operators.chunks import CHUNK, chunks, overview_shares, too_long
from ..operators.contexts import candidate_contexts
from ..operators import requests, selection, validation
from ..operators.layout import page_text, with_recognised
from ..operators.results import first_of_each, kept_results, marked_pages
from ..operators.tokens import amounts, dates
from ..sources import pages
from . import edges, exchange, reviews


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(pages.orders(spark, sf_dir)).filter("NOT too_many").drop("too_many")
    return found.withColumns({"value": F.col("value").cast("double"), "date": F.col("date").cast("string")})


def order_amounts(spark, sf_dir):
    return amounts(pages.orders(spark, sf_dir)).filter("currency IS NOT NULL").select("doc_id", F.col("value").cast("double").alias("value"), "currency", "adjacent", "start")


def order_dates(spark, sf_dir):
    return dates(pages.orders(spark, sf_dir)).select("doc_id", "start", F.col("date").cast("string").alias("date"))


def admission(spark, sf_dir):
    return admit(pages.documents(spark, sf_dir)).select("doc_id", "total_chars", "total_letters", "verdict")


def page_order(spark, sf_dir):
    return totals(pages.conversations(spark, sf_dir)).select("doc_id", "n_pages", "total_chars", F.size("pages_without_text").cast("long").alias("blank_pages"), "in_order")


def running_footers(spark, sf_dir):
    return running_lines(pages.conversations(spark, sf_dir, footer=True)).groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))


def recognised_text(spark, sf_dir):
    return pages.documents(spark, sf_dir).select("doc_id", F.md5(clean_recognised("text").cast("binary")).alias("digest"))


def result_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", safe_name(F.col("url")).alias("name"))


def invoice_contexts(spark, sf_dir):
    return candidate_contexts(pages.invoices(spark, sf_dir)).select("doc_id", "candidate_id", "kind", "context")


def result_rules(spark, sf_dir):
    """Orders as results; one rule is broken by each remainder of the key by 16."""
    k = F.col("o_orderkey") % 16
    broken = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    texts, pages_ = F.array(*map(F.lit, ("one", "two", "three"))), F.array(F.lit(2))
    made = {
        "file_name": broken(0, F.lit(" "), F.lit("a.pdf")), "pages": broken(1, F.lit(0), F.lit(3)), "language": broken(2, F.lit("PL"), F.lit("pl")), "type": broken(3, F.lit("list"), F.lit("umowa")),
        "title": broken(4, F.repeat(F.lit("x"), 301), F.lit("Title")), "date": broken(5, F.lit("2026-02-30"), broken(6, F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))),
        "summary": broken(7, F.lit("One. Two."), F.lit("One is here. Two is here. Three is here.")), "key_points": broken(8, F.slice(texts, 1, 2), texts), "organizations": broken(9, F.array(F.lit("")), texts), "people": texts,
        "amounts": F.array(F.struct(F.col("o_totalprice").alias("value"), broken(10, F.lit("ANG"), F.lit("PLN")).alias("currency"), F.lit("c").alias("context"))),
        "dates": F.array(F.struct(broken(11, F.lit("0000-01-01"), F.lit("2026-01-01")).alias("date"), F.lit("c").alias("context"))), "keywords": broken(12, F.array_repeat(F.lit("k"), 21), texts),
        "complete": k == 13, "pages_without_text": broken(14, F.array(F.lit(4)), pages_), "ocr_pages": broken(15, pages_, F.array(F.lit(3))),
    }
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns(made).select("o_orderkey", F.array_join(validation.result_problems(), "|").alias("problems"))


def attested_people(spark, sf_dir):
    """Customers' names as people: every second one is on its page, over a line end; every fourth only as a part of a word."""
    rows = pages.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Osoba "), F.translate("c_name", "#", " ")).alias("name"))
    written = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Podpisał OSOBA\n "), F.substring("name", 7, 100), F.lit("."))).when(F.col("doc_id") % 4 == 1, F.concat("name", F.lit("x"))).otherwise("nikt")
    return selection.attested(rows.select("doc_id", F.lit(0).alias("pos"), "name"), rows.select("doc_id", F.lit(1).alias("page"), written.alias("text"))).select("doc_id", "attested")


def full_names(spark, sf_dir):
    """Suppliers as organisations: one full name, two, the end of a longer name, or none in the source, by the key's remainder by four."""
    rows = pages.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("Dom "), F.col("s_suppkey").cast("string"), F.lit(" Sowa")).alias("name"))
    k, n = F.col("doc_id") % 4, F.col("name")
    text = F.when(k == 0, F.concat(F.lit("przez "), n, F.lit("\nS.A. oraz "), n, F.lit(" S.A."))).when(k == 1, F.concat(n, F.lit(" S.A. i "), n, F.lit(" GmbH"))).when(k == 2, F.concat(F.lit("Nowy "), n, F.lit(" S.A."))).otherwise(n)
    return selection.full_organisations(rows.select("doc_id", F.lit(0).alias("pos"), "name"), rows.select("doc_id", F.lit(1).alias("page"), text.alias("text"))).select("doc_id", "name")


def assembled_orders(spark, sf_dir):
    """Invoices whose candidates 2 and 4, and 3 twice, are chosen; the narrative has no title for every third."""
    rows, keys = pages.invoices(spark, sf_dir), pages.order_keys(spark, sf_dir)
    facts = selection.chosen_facts(keys.select("doc_id", F.explode(F.array(F.lit(4), F.lit(2), F.lit(3), F.lit(3))).alias("candidate_id")), candidate_contexts(rows))
    papers = keys.select("doc_id", F.lit("a.pdf").alias("file_name"), F.lit(1).alias("pages"), F.array().cast("array<int>").alias("pages_without_text"), F.lit(None).cast("array<int>").alias("ocr_pages"))
    words = F.array(F.lit("B"), F.lit("a"), F.lit(" b "))
    said = {"language": F.lit("de"), "type": F.lit("faktura"), "title": F.when(F.col("doc_id") % 3 > 0, "T"), "date": F.lit(None).cast("string"), "summary": F.lit("s"), "key_points": words, "organizations": words, "people": words, "keywords": words}
    out = selection.assembled(papers, keys.select("doc_id").withColumns(said), facts)
    amount = F.array_join(F.transform("amounts", lambda a: F.concat_ws(" ", F.bround(a["value"] * 100, 0).cast("long").cast("string"), a["currency"])), "|")
    return out.select("doc_id", "title", "title_fallback", F.array_join("people", "|").alias("people"), amount.alias("amounts"), F.array_join("dates.date", "|").alias("dates"))


def file_gates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    size, name = F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.col("page_id") % 5 * 4_000_000), F.when(F.col("page_id") % 3 == 0, "a.PDF").otherwise("a.txt")
    marked = F.concat(F.repeat(F.lit("x"), (F.col("page_id") % 1100).cast("int")), F.lit("%PDF-1.7"), "html").cast("binary")
    return rows.select("page_id", requests.file_problem(name, size, F.when(F.col("page_id") % 7 == 0, "application/pdf")).alias("problem"), requests.has_signature(marked).alias("signed"), requests.bounded(F.col("html").cast("binary"), 3000)["too_large"].alias("too_large"))


def client_gates(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    each = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("n_pages"), F.char_length(text).alias("total_chars"), F.char_length(F.regexp_replace(text, r"[^\p{L}]", "")).alias("total_letters"), F.char_length(text).alias("longest"), F.octet_length(text).alias("bytes"))
    each = each.withColumn("blank_pages", F.when(F.col("total_letters") == 0, 1).otherwise(0))
    return requests.client_problem(each, F.col("bytes")).select("doc_id", "problem")


def settings_parsed(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, "many").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_partkey") * 50)).otherwise(None)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", requests.setting(raw, "max_tokens").alias("max_tokens"), requests.setting(raw, "timeout_seconds").alias("timeout"))


def error_status(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c, _, _ in requests.ERRORS]), (F.col("event_id") % 15 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(code.alias("code"))
    return rows.join(F.broadcast(requests.error_codes(spark)), "code").groupBy("status", "retryable").agg(F.count(F.lit(1)).alias("n"))


def usage_events(spark, sf_dir):
    e = F.col("event_id")
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), (e % 5 > 0).alias("completed"), F.when(e % 7 > 0, e % 100).alias("prompt_tokens"), (e % 11 - 1).alias("completion_tokens"))
    return requests.call_usage(calls)


def payloads(spark, sf_dir):
    """A model's answer in three styles and as no JSON; what is read out, and how strictly it is typed."""
    k, inner = F.col("o_orderkey") % 4, F.concat(F.lit('{"id": '), F.when(F.col("o_orderkey") % 8 < 4, F.col("o_orderkey").cast("string")).otherwise('"7"'), F.lit("}"))
    raw = F.when(k == 0, F.concat(F.lit('{"response": '), inner, F.lit("}"))).when(k == 1, F.concat(F.lit('{"choices": [{"message": {"content": "'), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit('"}}]}'))).when(k == 2, inner).otherwise("sorry")
    read = requests.payload(raw)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.try_variant_get(read, "$.id", "string").alias("id"), (requests.strict_type(read, "$.id") == "BIGINT").alias("whole"))


def narrative_marks(spark, sf_dir):
    text = F.concat(F.lit("kwota ⟦A"), F.col("o_orderkey"), F.lit("⟧ "), F.when(F.col("o_orderkey") % 2 == 0, "15,00 zł").otherwise("zł"))
    points = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("A "), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit(" A"), F.lit("b")))
    rules = selection.first_problem(F.when(selection.has_mark(text), F.array(F.lit("mark"))).otherwise(F.array().cast("array<string>")), selection.overview_problems(F.lit("One is. Two is. Three is."), points))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", selection.without_copied_marks(text).alias("text"), F.array_join(rules, "|").alias("problems"))


def selections(spark, sf_dir):
    found = candidates(pages.orders(spark, sf_dir)).select("doc_id", "candidate_id", "kind")
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    wanted = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("candidate_id"), F.lit("amount").alias("kind")) for p, c in enumerate([2, 2, 1, 9])])
    return selection_problems(keys.select("doc_id", F.inline(wanted)), found)


def verdict_scores(spark, sf_dir):
    joined = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return check_scores(joined.select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("ok")))


def rate_limits(spark, sf_dir):
    """With a limit that some users exceed."""
    return limited_minutes(spark.read.parquet(f"{sf_dir}/events.parquet"), 1)


def crowded(spark, sf_dir):
    return crowded_minutes(spark.read.parquet(f"{sf_dir}/events.parquet"), 1)


def sentences(spark, sf_dir):
    found = sentence_interval(F.col("text"))
    return pages.documents(spark, sf_dir).select("doc_id", found.alias("s")).select("doc_id", "s.least", "s.most", "s.closed")


def chunk_cover(spark, sf_dir):
    """Each document's new text in order, which must be the document's, however long it is."""
    pieces = chunks(pages.documents(spark, sf_dir), most_chars=None)
    piece = F.struct("seq", "new_text")
    sized = pieces.groupBy("doc_id", "chunk").agg(F.sum(F.char_length("overlap") + F.char_length("new_text")).alias("size"), F.collect_list(piece).alias("pieces"))
    whole = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("pieces"))), lambda p: p["new_text"]), "")
    return sized.groupBy("doc_id").agg(F.md5(whole.cast("binary")).alias("digest"), (F.max("size") <= CHUNK).alias("bounded"), (F.count(F.lit(1)) == 1).alias("whole"))


def long_documents(spark, sf_dir):
    """With a lower limit than documents have, so that there are some."""
    return too_long(pages.documents(spark, sf_dir), 10_000)


def overviews(spark, sf_dir):
    return overview_shares(pages.conversations(spark, sf_dir), budget=300)


def layouts(spark, sf_dir):
    """The words of each turn as items, eight to a line, rebuilt as lines."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = pages.conversations(spark, sf_dir).select("doc_id", "page", F.posexplode(words).alias("n", "str"))
    item = {"x": F.col("n") % 8 * 100.0, "y": 800.0 - F.floor(F.col("n") / 8) * 12.0 + F.col("n") % 3, "w": F.lit(90.0), "h": F.lit(10.0)}
    return page_text(each.withColumns(item)).select("doc_id", "page", "text")


def recognised_pages(spark, sf_dir):
    """Every third turn loses its text and gets it back from a recogniser, or from an editor where there is one."""
    turns = pages.conversations(spark, sf_dir)
    blank = turns.withColumn("text", F.when(F.col("page") % 3 == 0, " 1 ").otherwise(F.col("text")))
    read = turns.select("doc_id", "page", F.concat("text", F.lit(" \n\n\n\n x ")).alias("machine"), F.when(F.col("page") % 2 == 0, "edited").alias("edited"))
    return with_recognised(blank, read).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"), "recognised")


def marked_orders(spark, sf_dir):
    rows = pages.orders(spark, sf_dir)
    return marked_pages(rows, candidates(rows)).select("doc_id", "text")


def single_facts(spark, sf_dir):
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS doc_id", "l_linenumber AS candidate_id", "'amount' AS kind", "CAST(l_quantity AS DECIMAL(38,2)) AS value", "'PLN' AS currency", "CAST(NULL AS DATE) AS date", "l_returnflag AS context")
    return first_of_each(facts).select("doc_id", "candidate_id", "context")


def results_kept(spark, sf_dir):
    """Orders as a customer's results: at most four, in at most 1,100 characters."""
    entry = F.repeat(F.lit("x"), (F.col("o_orderkey") % 1200).cast("int"))
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("saved_at"), entry.alias("entry"))
    return kept_results(history, 4, 1100).select("owner", "id", F.col("rank").cast("long").alias("rank"), F.col("chars").cast("long").alias("chars"))


def organisations(spark, sf_dir):
    forms = F.array("n_name", F.lower("n_name"), F.concat(F.lit(" "), "n_name", F.lit("  S.A.")), F.lit("Beta"), F.lit("Beta Transport"), F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.array_join(distinct_organisations(forms), "|").alias("names"))


def provider_problems(spark, sf_dir):
    reason = F.when(F.col("o_orderstatus") == "F", "JSON Mode couldn't be met").when(F.col("o_orderstatus") == "O", "daily Quota used").otherwise("timeout")
    message = F.concat(F.lit("Error 99: "), F.col("o_orderkey") % 8999 + 5000, F.lit(": "), reason)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", provider_problem(message).alias("p")).select("o_orderkey", "p.category", "p.code")


_GROUPED = "format('{:,.2f}', o_totalprice::DECIMAL(18,2)::DOUBLE)"
_RENDERED = f"""
r AS (SELECT o_orderkey AS doc_id, round(o_totalprice, 2) AS price, o_orderdate::DATE AS placed, (o_orderdate::DATE + 30)::DATE AS due,
  'Order ' || o_orderkey || ' of ' AS head,
  CASE o_orderstatus WHEN 'F' THEN translate({_GROUPED}, ',.', '.,') WHEN 'O' THEN {_GROUPED} ELSE translate({_GROUPED}, ',.', ' ,') END AS number,
  CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'USD ' ELSE '' END AS pre, CASE o_orderstatus WHEN 'F' THEN ' zł' WHEN 'O' THEN '' ELSE ' EUR' END AS post,
  CASE o_orderstatus WHEN 'F' THEN 'PLN' WHEN 'O' THEN 'USD' ELSE 'EUR' END AS currency FROM orders),
p AS (SELECT *, length(head) AS a, length(head) + 10 + length(' amounts to ') + length(pre) AS b FROM r),
q AS (SELECT *, b + length(number) + length(post) + length(', payable by ') AS c FROM p)"""

_SQL = {
    "candidates_orders": f"""WITH {_RENDERED}
SELECT doc_id, 1 AS candidate_id, 'date' AS kind, 1 AS page, a::INT AS start, (a + 10)::INT AS "end", strftime(placed, '%d.%m.%Y') AS text, NULL::DOUBLE AS value, NULL::VARCHAR AS currency, strftime(placed, '%Y-%m-%d') AS date FROM q
UNION ALL SELECT doc_id, 2, 'amount', 1, b::INT, (b + length(number))::INT, number, price::DECIMAL(18,2)::DOUBLE, currency, NULL FROM q
UNION ALL SELECT doc_id, 3, 'date', 1, c::INT, (c + 10)::INT, strftime(due, '%Y-%m-%d'), NULL, NULL, strftime(due, '%Y-%m-%d') FROM q""",
    "amounts_orders": f"WITH {_RENDERED} SELECT doc_id, price::DECIMAL(18,2)::DOUBLE AS value, currency, true AS adjacent, b::INT AS start FROM q",
    "dates_orders": f"WITH {_RENDERED} SELECT doc_id, a::INT AS start, strftime(placed, '%Y-%m-%d') AS date FROM q UNION ALL SELECT doc_id, c::INT, strftime(due, '%Y-%m-%d') FROM q",
    "admission_documents": r"""WITH t AS (SELECT doc_id, sum(length(coalesce(text, '')))::BIGINT AS total_chars, sum(length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')))::BIGINT AS total_letters FROM documents GROUP BY doc_id)
SELECT *, CASE WHEN total_chars > 30000 THEN 'DOCUMENT_TOO_LONG' WHEN total_letters = 0 THEN 'NO_TEXT_LAYER' WHEN total_letters < 200 THEN 'INSUFFICIENT_CONTENT' ELSE 'ADMITTED' END AS verdict FROM t""",
    "page_order_conversations": r"""SELECT conv_id AS doc_id, count(*) AS n_pages, sum(length(coalesce(text, '')))::BIGINT AS total_chars, count(*) FILTER (NOT coalesce(regexp_matches(text, '\p{L}'), false)) AS blank_pages,
min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS in_order FROM conversations GROUP BY conv_id""",
    "running_footers_conversations": "SELECT conv_id AS doc_id, count(DISTINCT turn) AS n_pages FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING count(DISTINCT turn) >= 3",
    "recognised_text_documents": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '[ \t]+$', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
    "result_names_pages": r"""SELECT page_id, coalesce(nullif(substring(regexp_replace(regexp_replace(url, '(?i)\.pdf$', ''), '[^\p{L}\p{N}._-]+', '_', 'g'), 1, 80), ''), 'dokument') || '-analiza.json' AS name FROM pages""",
    "contexts_invoices": f"""WITH r AS (SELECT o_orderkey AS k, translate({_GROUPED}, ',.', ' ,') AS price, strftime(o_orderdate::DATE + 30, '%d.%m.%Y') AS due, strftime(o_orderdate::DATE, '%Y-%m-%d') AS placed, (o_orderkey % 900 + 100) || ',50 EUR' AS more FROM orders)
SELECT k AS doc_id, 1 AS candidate_id, 'date' AS kind, 's. 1: [FAKTURA SPRZEDAŻY nr ' || k || '] Termin płatności: »' || due || '«' AS context FROM r
UNION ALL SELECT k, 2, 'amount', 's. 1: [Pozycja Wartość Dnia] Towar »' || price || ' zł« ' || placed FROM r
UNION ALL SELECT k, 3, 'date', 's. 1: [Pozycja Wartość Dnia] Towar ' || price || ' zł »' || placed || '«' FROM r
UNION ALL SELECT k, 4, 'amount', 's. 1: Strony uznają, że dopłata nie przekroczy »' || more || '« w tym roku.' FROM r""",
    "result_rules_orders": """SELECT o_orderkey, CASE o_orderkey % 16 WHEN 0 THEN 'document.fileName' WHEN 1 THEN 'document.pages|analysis' WHEN 2 THEN 'document.language' WHEN 3 THEN 'document.type' WHEN 4 THEN 'document.title' WHEN 5 THEN 'document.date'
WHEN 7 THEN 'summary' WHEN 8 THEN 'keyPoints' WHEN 9 THEN 'entities.organizations' WHEN 10 THEN 'amounts' WHEN 11 THEN 'dates' WHEN 12 THEN 'keywords' WHEN 13 THEN 'analysis' WHEN 14 THEN 'analysis' WHEN 15 THEN 'analysis' ELSE '' END AS problems FROM orders""",
    "attested_people_customer": "SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS attested FROM customer",
    "full_names_supplier": r"SELECT s_suppkey AS doc_id, 'Dom ' || s_suppkey || ' Sowa' || CASE s_suppkey % 4 WHEN 0 THEN ' S.A.' ELSE '' END AS name FROM supplier",
    "assembled_orders": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 > 0 THEN 'T' ELSE 'Dokument ohne Titel' END AS title, o_orderkey % 3 = 0 AS title_fallback, 'B|a' AS people,
round(o_totalprice::DECIMAL(18,2) * 100)::BIGINT || ' PLN|' || ((o_orderkey % 900 + 100) * 100 + 50) || ' EUR' AS amounts, strftime(o_orderdate::DATE, '%Y-%m-%d') AS dates FROM orders""",
    "file_gates_pages": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 3 > 0 AND page_id % 7 > 0 THEN 'not-pdf' WHEN page_id % 5 * 4000000 > 10485760 THEN 'too-large' END AS problem,
page_id % 1100 <= 1019 AS signed, strlen(html) > 3000 AS too_large FROM pages""",
    "client_gates_documents": r"""SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\p{L}') THEN 'no-text-layer' WHEN length(text) > 20000 THEN 'page-too-long' WHEN strlen(text) > 262144 THEN 'document-too-long'
WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 200 THEN 'insufficient-content' END AS problem FROM documents""",
    "settings_part": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN greatest(256, least(4096, p_partkey * 50)) ELSE 2048 END::INT AS max_tokens, CASE WHEN p_partkey % 3 = 1 THEN least(60, p_partkey * 50) ELSE 40 END::DOUBLE AS timeout FROM part",
    "error_status_events": """WITH c AS (SELECT event_id % 15 AS k FROM events) SELECT [400, 403, 413, 413, 415, 422, 422, 422, 429, 502, 502, 503, 503, 504, 500][k + 1] AS status, k IN (8, 9, 10, 11, 13, 14) AS retryable, count(*) AS n FROM c GROUP BY ALL""",
    "usage_events": """WITH c AS (SELECT user_id AS doc_id, event_id % 5 > 0 AS done, event_id % 100 AS p, event_id % 11 - 1 AS q, event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 AS told FROM events)
SELECT doc_id, count(*) AS started, count(*) FILTER (done) AS completed, count(*) FILTER (told) AS reported, count(*) = count(*) FILTER (told) AS complete, coalesce(sum(p) FILTER (told), 0)::BIGINT AS prompt_tokens, coalesce(sum(q) FILTER (told), 0)::BIGINT AS completion_tokens FROM c GROUP BY doc_id""",
    "payloads_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 8 < 4 THEN o_orderkey::VARCHAR ELSE '7' END AS id, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 8 < 4 END AS whole FROM orders",
    "narrative_marks_orders": """SELECT o_orderkey, 'kwota ' || CASE WHEN o_orderkey % 2 = 0 THEN ' 15,00 zł' ELSE '⟦A' || o_orderkey || '⟧ zł' END AS text, CASE WHEN o_orderkey % 2 = 1 THEN 'mark' WHEN o_orderkey % 3 > 0 THEN 'keyPoints' ELSE '' END AS problems FROM orders""",
    "selections_orders": "SELECT o_orderkey AS doc_id, pos, candidate_id, problem FROM orders, (VALUES (0, 2, NULL), (1, 2, 'repeated'), (2, 1, 'wrong kind'), (3, 9, 'unknown')) v(pos, candidate_id, problem)",
    "verdict_scores_labels": "SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS category, count(*) FILTER (quality = 1) AS passed, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "rate_limits_events": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "crowded_minutes_events": "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    # boundaries are judged between neighbouring words, so no pattern spans a text
    "sentences_documents": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w),
b AS (SELECT doc_id, regexp_extract(ws[i], '([.!?…]+)[\"''”’»)\]]*$', 1) AS run, lower(regexp_replace(regexp_extract(ws[i], '((?:[\p{{L}}.]*\p{{L}})?)[.!?…]+[\"''”’»)\]]*$', 1), '^\.+', '')) AS word,
  regexp_extract(ws[i + 1], '^[\"''„“«(\[]*(.)', 1) AS c FROM p WHERE regexp_matches(ws[i], '[.!?…][\"''”’»)\]]*$')),
k AS (SELECT doc_id, CASE WHEN regexp_matches(c, '\p{{Nd}}') THEN 1 WHEN NOT regexp_matches(c, '\p{{Lu}}') THEN 0
  WHEN run = '.' AND word <> '' AND (length(word) = 1 OR contains(word, '.') OR list_contains(string_split('{ABBREVIATIONS}', ' '), word)) THEN 1 ELSE 2 END AS kind FROM b),
s AS (SELECT doc_id, count(*) FILTER (kind = 2) AS sure, count(*) FILTER (kind = 1) AS unsure FROM k GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(sure, 0) + 1 END::INT AS least, CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(sure + unsure, 0) + 1 END::INT AS most,
  coalesce(regexp_matches(ws[-1], '[.!?…][\"''”’»)\]]*$'), false) AS closed FROM w LEFT JOIN s USING (doc_id)""",
    "chunks_documents": r"SELECT doc_id, md5(text) AS digest, true AS bounded, length(text) <= 10000 AS whole FROM documents WHERE regexp_matches(text, '\p{L}')",
    "too_long_documents": r"SELECT doc_id, sum(length(text))::BIGINT AS n_chars FROM documents WHERE regexp_matches(text, '\p{L}') GROUP BY doc_id HAVING sum(length(text)) > 10000",
    "overviews_conversations": r"""WITH RECURSIVE p AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, length(text)::INT AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE regexp_matches(text, '\p{L}')),
t AS (SELECT doc_id, page, n_chars, r, n, least(n_chars, 300 // n) AS share, 300 - least(n_chars, 300 // n) AS budget FROM p WHERE r = 1
UNION ALL SELECT p.doc_id, p.page, p.n_chars, p.r, p.n, least(p.n_chars, budget // (p.n - p.r + 1)), budget - least(p.n_chars, budget // (p.n - p.r + 1)) FROM t JOIN p ON p.doc_id = t.doc_id AND p.r = t.r + 1)
SELECT doc_id, page, n_chars, share::BIGINT AS share FROM t""",
    "layouts_conversations": r"""WITH w AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM conversations WHERE text IS NOT NULL)
SELECT doc_id, page, array_to_string(list_transform(range(0, len(ws), 8), lambda k: array_to_string(ws[k + 1:k + 8], ' ')), chr(10)) AS text FROM w WHERE len(ws) > 0""",
    "recognised_pages_conversations": r"""WITH t AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, text FROM conversations)
SELECT doc_id, page, md5(CASE WHEN page % 3 <> 0 THEN text WHEN page % 2 = 0 THEN 'edited' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || ' x' END) AS digest, page % 3 = 0 AS recognised FROM t""",
    "marked_orders": f"""WITH {_RENDERED}
SELECT doc_id, head || '⟦D1⟧' || strftime(placed, '%d.%m.%Y') || ' amounts to ' || pre || '⟦A2⟧' || number || post || ', payable by ⟦D3⟧' || strftime(due, '%Y-%m-%d') || '.' AS text FROM q""",
    "single_facts_lineitem": "SELECT l_orderkey AS doc_id, min(l_linenumber) AS candidate_id, l_returnflag AS context FROM lineitem GROUP BY l_orderkey, l_quantity, l_returnflag",
    "results_kept_orders": """WITH f AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate, o_orderkey % 1200 AS n FROM orders WHERE o_orderkey % 1200 + 26 <= 1100),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY o_orderdate DESC, id) AS rank FROM f),
c AS (SELECT owner, id, rank, (sum(n + 1) OVER (PARTITION BY owner ORDER BY rank) + 25)::BIGINT AS chars FROM r WHERE rank <= 4)
SELECT * FROM c WHERE chars <= 1100""",
    "organisations_nation": "SELECT n_nationkey, n_name || ' S.A.|Beta|Beta Transport' AS names FROM nation",
    "provider_problems_orders": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'invalid_output' WHEN 'O' THEN 'quota' ELSE 'unavailable' END AS category, CASE WHEN o_orderkey % 8999 + 5000 <= 9999 THEN (o_orderkey % 8999 + 5000)::INT END AS code FROM orders",
}


def queries() -> dict:
    return {
        "candidates_orders": flagship,
        "amounts_orders": order_amounts,
        "dates_orders": order_dates,
        "admission_documents": admission,
        "page_order_conversations": page_order,
        "running_footers_conversations": running_footers,
        "recognised_text_documents": recognised_text,
        "result_names_pages": result_names,
        "contexts_invoices": invoice_contexts,
        "result_rules_orders": result_rules,
        "attested_people_customer": attested_people,
        "full_names_supplier": full_names,
        "assembled_orders": assembled_orders,
        "file_gates_pages": file_gates,
        "client_gates_documents": client_gates,
        "settings_part": settings_parsed,
        "error_status_events": error_status,
        "usage_events": usage_events,
        "payloads_orders": payloads,
        "narrative_marks_orders": narrative_marks,
        "selections_orders": selections,
        "verdict_scores_labels": verdict_scores,
        "rate_limits_events": rate_limits,
        "crowded_minutes_events": crowded,
        "sentences_documents": sentences,
        "chunks_documents": chunk_cover,
        "too_long_documents": long_documents,
        "overviews_conversations": overviews,
        "layouts_conversations": layouts,
        "recognised_pages_conversations": recognised_pages,
        "marked_orders": marked_orders,
        "single_facts_lineitem": single_facts,
        "results_kept_orders": results_kept,
        "organisations_nation": organisations,
        "provider_problems_orders": provider_problems,
        **reviews.queries(),
        **exchange.queries(),
        **edges.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **reviews.oracle_sql(_RENDERED), **exchange.oracle_sql(_SQL["sentences_documents"]), **edges.oracle_sql()}
