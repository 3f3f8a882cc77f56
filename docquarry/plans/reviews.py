"""Queries of grounding, merging and evaluation, and the SQL that checks them: what each row must give follows from its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import composed
from ..operators import evaluation, grounding, selection
from ..operators.candidates import candidates
from ..operators.contexts import candidate_contexts
from ..operators.tokens import dates
from ..sources import pages
from ..sources.tables import settled


def _key():
    return F.col("doc_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of orders, each with "Net " before it, and the order's price, currency, amount as written and due date."""
    currency = F.when(F.col("o_orderstatus") == "F", "PLN").when(F.col("o_orderstatus") == "O", "USD").otherwise("EUR")
    rows = pages.orders(spark, sf_dir, F.col("o_totalprice").cast("decimal(18,2)").alias("price"), currency.alias("currency"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("due"))
    return rows.select("doc_id", "price", "currency", "due", "page", F.concat(F.lit("Net "), "text").alias("text"), F.regexp_extract("text", "amounts to (.*), payable", 1).alias("written"))


def _segments(rows: DataFrame, *numbers: int) -> DataFrame:
    return rows.select("doc_id", F.explode(F.array(*map(F.lit, numbers))).alias("chunk"), F.lit(0).alias("seq"), "page", F.lit(4).alias("start"), F.substring("text", 1, 4).alias("overlap"), F.substring("text", 5, 500).alias("new_text"))


def _fact(**columns):
    plain = {"chunk": F.lit(1), "pos": F.lit(0), "kind": F.lit("amount"), "page": F.lit(1), "value": F.col("price"), "currency": F.col("currency"), "basis": F.lit("net"), "period": F.lit("unspecified"), "status": F.lit("current"), "date": F.lit(None).cast("string"), "context": F.lit("c"), "evidence": F.concat(F.lit("amounts  TO "), "written")}
    return F.struct(*[(columns.get(c, v)).alias(c) for c, v in plain.items()])


def _dated(**columns):
    none = F.lit(None)
    return _fact(**{"kind": F.lit("date"), "value": none.cast("decimal(18,2)"), "currency": none.cast("string"), "basis": none.cast("string"), "period": none.cast("string"), "status": none.cast("string"), "date": F.col("due"), "evidence": F.concat(F.lit("payable by "), "due"), **columns})


def grounded_orders(spark, sf_dir):
    """One thing is wrong with a fact, by the key's remainder by seven."""
    k, rows = _key() % 7, _orders(spark, sf_dir)
    pick = lambda n, odd, plain: F.when(k == n, odd).otherwise(plain)
    amount = _fact(evidence=pick(0, F.lit("not there"), F.concat(F.lit("amounts  TO "), "written")), value=pick(1, (F.col("price") + 1).cast("decimal(18,2)"), F.col("price")), currency=pick(2, F.lit("CHF"), F.col("currency")), period=pick(3, F.lit("monthly"), F.lit("unspecified")), page=pick(4, F.lit(9), F.lit(1)))
    facts = rows.select("doc_id", F.inline(F.array(F.when(k < 5, amount).otherwise(_dated(date=pick(6, F.lit("1990-01-01"), F.col("due")))))))
    return grounding.grounded(facts, _segments(rows, 1), rows).select("doc_id", "kind", "problem", "start", "end")


def merged_orders(spark, sf_dir):
    """Three chunks with the same text: an amount twice, with an equal context for even keys; the third chunk does not hold for every third key."""
    rows = _orders(spark, sf_dir)
    other = F.when(_key() % 2 == 0, "opłata - STAŁA").otherwise("Kara")
    wrong = _dated(chunk=F.lit(3), pos=F.lit(1), evidence=F.when(_key() % 3 == 0, "not there").otherwise(F.concat(F.lit("payable by "), "due")), context=F.lit("termin"))
    facts = rows.select("doc_id", F.inline(F.array(_fact(context=F.lit("Opłata – stała")), _fact(chunk=F.lit(2), context=other), _dated(chunk=F.lit(3), context=F.lit("Termin")), wrong)))
    merged = grounding.merged_facts(grounding.grounded(facts, _segments(rows, 1, 2, 3), rows))
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    lists = rows.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("chunk"), words("Lis", "Lis S.A.").alias("organizations"), words().alias("people"), words("b", "C").alias("keywords")), F.struct(F.lit(2).alias("chunk"), words("lis").alias("organizations"), words("Ewa", " ewa").alias("people"), words().alias("keywords")))))
    said = rows.select("doc_id", F.lit("pl").alias("language"), F.lit("umowa").alias("type"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("date"), F.lit("s").alias("summary"), words("p").alias("key_points"), words("a", "B").alias("keywords"))
    papers = rows.select("doc_id", F.lit("a.pdf").alias("file_name"), F.lit(1).alias("pages"), F.array().cast("array<int>").alias("pages_without_text"), F.lit(None).cast("array<int>").alias("ocr_pages"))
    out = grounding.merged_results(papers, said, lists, merged)
    money = F.array_join(F.transform("amounts", lambda a: F.concat_ws(" ", F.bround(a["value"] * 100, 0).cast("long").cast("string"), a["currency"], a["context"])), "|")
    days = F.array_join(F.transform("dates", lambda d: F.concat_ws(" ", d["date"], d["context"])), "|")
    return out.select("doc_id", money.alias("amounts"), days.alias("dates"), *[F.array_join(c, "|").alias(c) for c in ("organizations", "people", "keywords")])


def merged_counts(spark, sf_dir):
    """How many equal facts went, over orders whose amount five chunks give."""
    rows = _orders(spark, sf_dir)
    facts = rows.select("doc_id", F.inline(F.array(*[_fact(chunk=F.lit(c), context=F.when(_key() % 4 < c, F.lit("x")).otherwise("y")) for c in range(1, 6)])))
    merged = grounding.merged_facts(grounding.grounded(facts, _segments(rows, 1, 2, 3, 4, 5), rows))
    return merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("duplicates").alias("duplicates"))


def _amounts(*entries):
    return F.array(*[F.struct(v.cast("double").alias("value"), F.lit(c).alias("currency"), F.lit(x).alias("context")) for v, c, x in entries])


def checked_facts(spark, sf_dir):
    """Two qualifiers asked of one amount, and its entries by the key's remainder by four."""
    price = F.col("price")
    given = F.when(_key() % 4 == 0, _amounts((price, "PLN", "Opłata netto miesięcznie"))).when(_key() % 4 == 1, _amounts((price, "PLN", "brutto"), (price, "PLN", "s. 1: [Opłata brutto] Cena netto »x«"))).when(_key() % 4 == 2, _amounts((price, "EUR", "netto"))).otherwise(_amounts((price, "PLN", "netto lub brutto, nie dotyczy")))
    rows = pages.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"))
    results = rows.select("doc_id", given.alias("amounts"), F.array(F.struct(F.col("placed").alias("date"), F.when(_key() % 3 == 0, "Zawarcie umowy").otherwise("Umowa").alias("context"))).alias("dates"))
    none = F.lit(None).cast("string")
    amount = F.struct(F.lit(0).alias("pos"), F.lit("amount").alias("kind"), F.col("price").alias("value"), F.lit("PLN").alias("currency"), none.alias("date"), F.array(F.lit("net"), F.lit("monthly")).alias("qualifiers"), F.lit("fee").alias("label"), F.array().cast("array<array<string>>").alias("event"))
    date = F.struct(F.lit(0).alias("pos"), F.lit("date").alias("kind"), F.lit(None).cast("decimal(18,2)").alias("value"), none.alias("currency"), F.col("placed").alias("date"), F.array().cast("array<string>").alias("qualifiers"), F.lit("signed").alias("label"), F.array(F.array(F.lit("zawar"), F.lit("podpis")), F.array(F.lit("umow"))).alias("event"))
    return evaluation.fact_checks(rows.select("doc_id", F.inline(F.array(amount, date))), results).select("doc_id", "category", "name", "ok")


def ungrounded_orders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    results = rows.select("doc_id", F.array(F.struct((F.col("price") + F.when(_key() % 3 == 0, 1).otherwise(0)).cast("double").alias("value"), "currency")).alias("amounts"), F.array(F.struct(F.when(_key() % 4 == 0, "1990-01-01").otherwise(F.col("due")).alias("date"))).alias("dates"), F.when(_key() % 2 == 0, F.col("due")).alias("date"), F.array(F.lit("Net Order"), F.when(_key() % 5 == 0, "Jan Nikt").otherwise("PAYABLE by")).alias("people"))
    return evaluation.grounding_checks(results, rows).select("doc_id", "name", "ok")


def forbidden_orders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    results = rows.select("doc_id", F.array(F.struct(F.col("price").cast("double").alias("value"), "currency")).alias("amounts"))
    return evaluation.forbidden_checks(rows.select("doc_id", F.col("price").alias("value"), F.lit("EUR").alias("currency")), results).select("doc_id", "ok")


def _expected(rows, amount_evidence, **columns):
    plain = {"pos": F.lit(0), "kind": F.lit("amount"), "value": F.col("price"), "currency": F.col("currency"), "date": F.lit(None).cast("string"), "page": F.lit(1), "evidence": amount_evidence}
    amount = F.struct(*[columns.get(c, v).alias(c) for c, v in plain.items()])
    other = {**plain, "kind": F.lit("date"), "value": F.lit(None).cast("decimal(18,2)"), "currency": F.lit(None).cast("string"), "date": F.col("due"), "evidence": F.concat(F.lit("payable by "), "due")}
    date = F.struct(*[v.alias(c) for c, v in other.items()])
    return rows.select("doc_id", F.inline(F.array(amount, date)))


def case_problems_orders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    asked = _expected(rows, F.when(_key() % 5 == 1, "not there").otherwise(F.concat(F.lit("AMOUNTS to "), "written")), page=F.when(_key() % 5 == 0, 2).otherwise(1), currency=F.when(_key() % 5 == 2, "CHF").otherwise(F.col("currency")))
    blank = rows.filter(_key() % 5 == 4).select("doc_id", "page")
    return evaluation.case_problems(asked, rows, blank).select("doc_id", "kind", "problem")


def ideal_orders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    asked = _expected(rows, F.when(_key() % 3 == 0, F.lit("amounts to")).otherwise(F.concat(F.lit("amounts   to "), "written")))
    return evaluation.ideal_selection(asked, rows, candidates(rows.select("doc_id", "page", "text"))).select("doc_id", "kind", "candidate_id")


def rebuilt_invoices(spark, sf_dir):
    """Candidates 4, 2 and 3 chosen, made to results, and found again. Candidates are met twice; written once, they are made once, by one short plan."""
    rows = pages.invoices(spark, sf_dir)
    found = settled(candidate_contexts(rows))
    facts = selection.chosen_facts(pages.order_keys(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(4), F.lit(2), F.lit(3))).alias("candidate_id")), found)
    return evaluation.rebuilt_selection(facts, found)


def segments_orders(spark, sf_dir):
    written = F.regexp_extract("text", "amounts to (.*), payable", 1)
    context = F.concat(F.lit("s. 1: [Raty brutto] Pierwsza rata 10,00 zł. Druga rata netto »"), written, F.when(_key() % 2 == 0, F.lit("« miesięcznie, potem 5,00 zł rocznie")).otherwise("« na »zawsze«"))
    # segments go through a generator of one row, so that each is found once
    rows = pages.orders(spark, sf_dir).select("doc_id", context.alias("context"))
    rows = rows.select("doc_id", "context", F.inline(F.array(F.struct(evaluation.segment(F.col("context")).alias("segment")))))
    return rows.select("doc_id", "segment", F.array_join(evaluation.qualifiers(F.coalesce("segment", "context")), ",").alias("qualifiers"))


_VALID = {
    "file_name": "'a.pdf'", "pages": "1", "language": "'pl'", "type": "'umowa'", "title": "'Umowa ⟦A1⟧'", "date": "NULL", "summary": "'Jest raz. Jest dwa. Jest trzy.'", "key_points": "array('a', 'b', 'c')", "organizations": "array('LIS  s.a.')", "people": "array('Ewa')",
    "amounts": "array(named_struct('value', 5D, 'currency', 'PLN', 'context', 'Cena »5,00 zł« netto'))", "dates": "array(named_struct('date', '2026-01-02', 'context', 'Ñandú'))", "keywords": "array('k')", "complete": "true", "pages_without_text": "CAST(array() AS array<int>)", "ocr_pages": "CAST(NULL AS array<int>)",
}


def _results(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    return keys.selectExpr("doc_id", *[f"CAST({v} AS string) AS {c}" if v == "NULL" else f"{v} AS {c}" for c, v in _VALID.items()])


def verdict_orders(spark, sf_dir):
    """An error, a failed check, no time, a bad review, a review of another result, and all well, by the key's remainder by six."""
    k, rows = _key() % 6, _results(spark, sf_dir)
    runs = rows.withColumns({"http_status": F.when(k == 0, 500).otherwise(200), "latency_ms": F.when(k != 2, 900), "digest": F.lit("x")})
    checks = rows.select("doc_id", F.lit("amounts").alias("category"), F.lit("n").alias("name"), F.inline(F.array(F.struct((k != 1).alias("ok"), F.lit(False).alias("manual")), F.struct(F.lit(False).alias("ok"), F.lit(True).alias("manual")))))
    told = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.when((k == 3) & F.lit(d == "language_fidelity"), "fail").otherwise("pass").alias("verdict")) for d in evaluation.DIMENSIONS])).alias("v")
    reviews = rows.select("doc_id", F.when(k == 4, "y").otherwise("x").alias("digest"), told).select("doc_id", "digest", "v.*")
    out = evaluation.verdicts(runs, checks, rows.filter("false").select("doc_id"), reviews)
    return out.select("doc_id", "status", F.col("passed").cast("long").alias("passed"), F.col("total").cast("long").alias("total"), F.size("pending").alias("n_pending"))


def result_checks_orders(spark, sf_dir):
    rows = _results(spark, sf_dir)
    papers = rows.select("doc_id", F.when(_key() % 2 == 0, " a.pdf ").otherwise("b.pdf").alias("file_name"), F.lit(1).alias("pages"), F.when(_key() % 3 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("pages_without_text"))
    none = "CAST(NULL AS array<string>)"
    cases = rows.selectExpr("doc_id", f"named_struct('type', 'umowa', 'language', IF(doc_id % 5 = 0, 'en', 'pl'), 'date', CAST(NULL AS string), 'title_contains', array('Umowa', 'umowa'), 'organizations', array('Lis S.A.'), 'people', {none}, 'legal_forms', true, 'forbidden_narrative', array('\\\\bdwa\\\\b')) AS expect")
    return evaluation.result_checks(rows, papers, cases).select("doc_id", "category", "name", "ok")


def review_orders(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("summary", F.concat(F.lit("Razem "), _key().cast("string"), F.lit(",50 zł.")))
    texts = rows.select("doc_id", F.lit(1).alias("page"), F.concat(F.when(_key() % 2 == 0, _key()).otherwise(0).cast("string"), F.lit(",50 zł dnia 02.01.2026")).alias("text"))
    return evaluation.review_evidence(rows, texts)


def composed_names(spark, sf_dir):
    written = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Zofia Łoś ").otherwise("Zo\u0301łc\u0301 \u212b "), "c_name")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.md5(composed(written).cast("binary")).alias("digest"))


def page_dates(spark, sf_dir):
    found = dates(pages.conversations(spark, sf_dir, footer=True)).groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("date")).alias("d"))
    return found.select("doc_id", "page", F.array_contains("d", F.lit("2026-03-12").cast("date")).alias("dated"))


def queries() -> dict:
    return {
        "grounded_orders": grounded_orders,
        "merged_orders": merged_orders,
        "merged_counts_orders": merged_counts,
        "fact_checks_orders": checked_facts,
        "grounding_checks_orders": ungrounded_orders,
        "forbidden_orders": forbidden_orders,
        "case_problems_orders": case_problems_orders,
        "ideal_selection_orders": ideal_orders,
        "rebuilt_selection_invoices": rebuilt_invoices,
        "segments_orders": segments_orders,
        "verdicts_orders": verdict_orders,
        "result_checks_orders": result_checks_orders,
        "review_evidence_orders": review_orders,
        "composed_names_customer": composed_names,
        "page_dates_conversations": page_dates,
    }


def oracle_sql(rendered: str) -> dict[str, str]:
    """rendered: the common tables that say where each part of an order's text stands."""
    return {
        "grounded_orders": f"""WITH {rendered}
SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN 'amount' ELSE 'date' END AS kind, ['evidence', 'value', 'currency', 'qualifier', NULL, NULL, 'date'][doc_id % 7 + 1] AS problem,
CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 < 5 THEN a + 15 ELSE c - 7 END::INT AS start, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 < 5 THEN b + length(number) + length(post) + 4 ELSE c + 14 END::INT AS "end" FROM q""",
        "merged_orders": f"""WITH {rendered}, f AS (SELECT *, round(price::DECIMAL(18,2) * 100)::BIGINT || ' ' || currency AS fact FROM q)
SELECT doc_id, fact || ' Opłata – stała (netto)' || CASE WHEN doc_id % 2 = 1 THEN '|' || fact || ' Kara (netto)' ELSE '' END AS amounts, CASE WHEN doc_id % 3 = 0 THEN '' ELSE strftime(due, '%Y-%m-%d') || ' Termin' END AS dates,
'Lis S.A.' AS organizations, 'Ewa' AS people, 'a|B|C' AS keywords FROM f""",
        "merged_counts_orders": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS kept, CASE WHEN o_orderkey % 4 = 0 THEN 4 ELSE 3 END AS duplicates FROM orders",
        "fact_checks_orders": """WITH k AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k FROM orders)
SELECT doc_id, 'amounts' AS category, 'present: fee' AS name, k <> 2 AS ok FROM k UNION ALL SELECT doc_id, 'qualifiers', 'fee: net', k <> 2 FROM k UNION ALL SELECT doc_id, 'qualifiers', 'fee: monthly', k = 0 FROM k
UNION ALL SELECT doc_id, 'qualifiers', 'fee: no contradiction', k = 0 FROM k WHERE k <> 2 UNION ALL SELECT doc_id, 'dates', 'present: signed', true FROM k UNION ALL SELECT doc_id, 'dates', 'signed: event', doc_id % 3 = 0 FROM k""",
        "grounding_checks_orders": """SELECT o_orderkey AS doc_id, 'every ' || kind || ' is in the source' AS name, CASE kind WHEN 'amount' THEN o_orderkey % 3 > 0 WHEN 'date' THEN o_orderkey % 4 > 0 ELSE o_orderkey % 5 > 0 END AS ok
FROM orders, (VALUES ('amount'), ('date'), ('person')) v(kind)""",
        "forbidden_orders": "SELECT o_orderkey AS doc_id, o_orderstatus IN ('F', 'O') AS ok FROM orders",
        "case_problems_orders": """SELECT o_orderkey AS doc_id, 'amount' AS kind, ['page', 'evidence', 'fact', NULL, 'page'][o_orderkey % 5 + 1] AS problem FROM orders WHERE o_orderkey % 5 <> 3
UNION ALL SELECT o_orderkey, 'date', 'page' FROM orders WHERE o_orderkey % 5 = 4""",
        "ideal_selection_orders": "SELECT o_orderkey AS doc_id, 'amount' AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 2 END AS candidate_id FROM orders UNION ALL SELECT o_orderkey, 'date', 3 FROM orders",
        "rebuilt_selection_invoices": "SELECT o_orderkey AS doc_id, kind, candidate_id FROM orders, (VALUES ('amount', 2), ('amount', 4), ('date', 3)) v(kind, candidate_id)",
        "segments_orders": f"""WITH {rendered}
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Druga rata netto ' || pre || number || post || ' miesięcznie, potem ' END AS segment, CASE WHEN doc_id % 2 = 0 THEN 'net,monthly' ELSE 'net,gross' END AS qualifiers FROM q""",
        "verdicts_orders": """WITH k AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS k FROM orders)
SELECT doc_id, CASE WHEN k IN (0, 1, 3) THEN 'failed' WHEN k IN (2, 4) THEN 'needs_manual_review' ELSE 'accepted' END AS status, [1, 1, 1, 2, 2, 2][k + 1]::BIGINT AS passed, [1, 2, 1, 2, 2, 2][k + 1]::BIGINT AS total, [0, 0, 1, 0, 5, 0][k + 1]::INT AS n_pending FROM k""",
        "result_checks_orders": r"""SELECT o_orderkey AS doc_id, category, name, CASE name WHEN 'file_name' THEN o_orderkey % 2 = 0 WHEN 'pages_without_text' THEN o_orderkey % 3 > 0 WHEN 'complete' THEN o_orderkey % 3 > 0 WHEN 'language' THEN o_orderkey % 5 > 0
ELSE name NOT IN ('no marks', 'title: umowa', 'free of \bdwa\b') END AS ok FROM orders, (VALUES ('metadata', 'file_name'), ('metadata', 'pages'), ('coverage', 'pages_without_text'), ('coverage', 'complete'), ('language', 'no marks'), ('document', 'type'),
('document', 'language'), ('document', 'title: Umowa'), ('document', 'title: umowa'), ('organizations', 'Lis S.A.'), ('organizations', 'legal forms'), ('injection', 'free of \bdwa\b')) v(category, name)""",
        "review_evidence_orders": """SELECT o_orderkey AS doc_id, 'number' AS field, 0 AS pos, o_orderkey || ',50' AS text, NULL::VARCHAR AS told, o_orderkey % 2 = 0 AS in_source FROM orders
UNION ALL SELECT o_orderkey, 'amount', 0, 'Cena 5,00 zł netto', 'net', NULL FROM orders UNION ALL SELECT o_orderkey, 'date', 0, 'Ñandú', '2026-01-02', true FROM orders UNION ALL SELECT o_orderkey, 'letters', 0, 'Ñú', NULL, NULL FROM orders""",
        "composed_names_customer": "SELECT c_custkey, md5(nfc_normalize(CASE WHEN c_custkey % 2 = 0 THEN 'Zofia Łoś ' ELSE 'Zo' || chr(769) || 'łc' || chr(769) || ' ' || chr(8491) || ' ' END || c_name)) AS digest FROM customer",
        "page_dates_conversations": "SELECT conv_id AS doc_id, (turn + 1)::INT AS page, true AS dated FROM conversations WHERE text IS NOT NULL",
    }
