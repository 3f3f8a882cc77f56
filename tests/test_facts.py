"""Amounts, dates, running lines and gates on small texts with known results."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docquarry.functions.sentences import sentence_interval
from docquarry.operators import admission, candidates, checks, grounding, tokens
from docquarry.streaming import limits

PROSE = "Najemca wpłaci wynajmującemu kaucję za lokal użytkowy w wysokości "


def pages(spark, *texts):
    return spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "doc_id long, page int, text string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Razem 7 456,00 zł z VAT.", [("7456.00", "PLN")]),
        ("Razem 7\u00a0456,10 zł z VAT.", [("7456.10", "PLN")]),
        ("Wartość 62.950,00 zł.", [("62950.00", "PLN")]),
        ("Fee of 98.76 USD.", [("98.76", "USD")]),
        ("Rent is GBP 2,310.50 a month.", [("2310.50", "GBP")]),
        ("Paid in XDR 15.00 and ANG 16.00", [("15.00", "XDR")]),
        ("Obniżka o 15% ceny.", []),
        ("REGON: 0123456789", []),
        ("Wydano 8 kluczy do 3 szaf.", []),
        ("Raty 6 i 450 zł", [("450.00", "PLN")]),
        (PROSE + "317\n400,00 zł", [("317400.00", "PLN")]),
        ("Krzesło B 24\n650,00 zł", []),
        (PROSE + "str. 2 z 15\n650,00 zł", []),
        ("Podatek 5%\n310,00 zł", [("310.00", "PLN")]),
        ("REGON 0123456789\n231,00 zł", [("231.00", "PLN")]),
        ("317 400,\n00 zł", []),
        ("", []),
        (None, []),
    ],
)
def test_amounts(spark, text, expected):
    found = [r for r in tokens.amounts(pages(spark, text)).collect() if r["currency"]]
    assert [(str(r["value"]), r["currency"]) for r in found] == expected
    assert all(" ".join(text[r["start"] : r["end"]].split()) == " ".join(r["text"].split()) for r in found)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("z 07.11.2024 r.", ["2024-11-07"]),
        ("9 października 2025", ["2025-10-09"]),
        ("9 PAŹDZIERNIKA 2025", ["2025-10-09"]),
        ("3 lutego 2025 and August 21, 2027", ["2025-02-03", "2027-08-21"]),
        ("107.11.2024 and 2024-11-070", []),
        ("30.02.2025, 05.14.2025, 0000-01-15 and 0001-01-02", ["0001-01-02"]),
    ],
)
def test_dates(spark, text, expected):
    found = tokens.dates(pages(spark, text)).collect()
    assert [r["date"] for r in sorted(found, key=lambda r: r["start"])] == [datetime.date.fromisoformat(d) for d in expected]


@pytest.mark.parametrize(("n", "kept"), [(4, 0), (2, 2)])
def test_running_lines_go_from_three_pages_on(spark, n, kept):
    texts = [f"Treść {chr(97 + k)}\ndalej\ni dalej\nSeite {k + 1} von {n}, 07.11.2024" for k in range(n)]
    assert candidates.candidates(pages(spark, *texts)).count() == kept


@pytest.mark.parametrize("line", ["Kurs 3/4 z 07.11.2024 kwota 5,00 zł", "Page {}: fee 5,00 EUR of 07.11.2024", "v. {} z 07.11.2024 za 5,00 zł"])
def test_lines_without_a_page_number_are_no_running_lines(spark, line):
    assert candidates.candidates(pages(spark, *[line.format(k) for k in range(3)])).count() == 6


def test_pages_without_a_letter_give_nothing(spark):
    assert candidates.candidates(pages(spark, "12,00 €", "12,00 € a")).count() == 1


def test_declared_currency(spark):
    found = candidates.candidates(pages(spark, "Currency: CZK\n41 200,00 and 8 310,90, 25 EUR, 9 days")).collect()
    assert [(str(r["value"]), r["currency"]) for r in found] == [("41200.00", "CZK"), ("8310.90", "CZK"), ("25.00", "EUR")]


def test_admission(spark):
    verdict = lambda *t: admission.admit(pages(spark, *t)).first()["verdict"]
    assert verdict("a" * 30_001) == "DOCUMENT_TOO_LONG"
    assert verdict("1 2 3", None) == "NO_TEXT_LAYER"
    assert verdict("short") == "INSUFFICIENT_CONTENT"
    assert verdict("a" * 200) == "ADMITTED"


def test_limits_on_a_stream(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    rows = [(1, base + datetime.timedelta(seconds=k)) for k in range(7)] + [(2, base)] + [(3, base + datetime.timedelta(hours=1))]
    batch = spark.createDataFrame(rows, "user_id long, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    query = limits.limited(limits.request_stream(spark, str(tmp_path / "in"), batch)).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["user_id"], r["n"]) for r in spark.table("limited").collect()] == [(1, 7)]
    assert checks.limited_minutes(batch).count() == 1


def test_rows_are_dealt_before_texts_are_made(spark):
    """Filters on a rendered text stay behind the dealing of rows, and larger tables get more tasks."""
    from docquarry.sources import pages

    plan = pages.orders(spark, "/root/testdata/sf0.001").filter("text RLIKE 'x[0-9]'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Repartition")
    assert pages.table(spark, "/root/testdata/sf0.1", "orders").rdd.getNumPartitions() == 4
    assert pages.table(spark, "/root/testdata/sf0.1", "lineitem").rdd.getNumPartitions() == 12


def test_many_rows_in_few_bytes_are_dealt_to_more_tasks(spark, tmp_path):
    """A task's rows are bounded however well a table is compressed."""
    from docquarry.sources import pages

    spark.range(400_000).selectExpr("CAST(1 AS LONG) AS a").coalesce(1).write.parquet(f"{tmp_path}/many.parquet")
    dealt = pages.table(spark, str(tmp_path), "many")
    assert dealt.rdd.getNumPartitions() == 8 and dealt.count() == 400_000


def test_segments_are_found_once(spark):
    from docquarry.operators import evaluation
    from docquarry.plans import registry

    plan = registry.queries()["segments_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(evaluation.LEAD) == 1


def test_entries_are_judged_once_for_all_checks(spark):
    from docquarry.operators import evaluation
    from docquarry.plans import registry

    found = registry.queries()["fact_checks_orders"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("not applicable") == 1
    schema = "doc_id long, pos int, kind string, value decimal(18,2), currency string, date string, qualifiers array<string>, label string"
    asked = spark.createDataFrame([(1, 0, "amount", Decimal(5), "PLN", None, ["net", None], "fee"), (1, 1, "amount", Decimal(6), "PLN", None, None, None), (2, 0, "date", None, None, "2026-01-02", ["net"], "signed")], schema)
    results = spark.createDataFrame([(1, [(5.0, "PLN", "netto")], None), (2, None, [("2026-01-02", "x")])], "doc_id long, amounts array<struct<value:double,currency:string,context:string>>, dates array<struct<date:string,context:string>>")
    assert sorted(map(str, map(tuple, evaluation.fact_checks(asked, results).collect()))) == sorted(map(str, [
        (1, "amounts", "present: fee", True, False), (1, "amounts", None, False, False), (2, "dates", "present: signed", True, False),
        (1, "qualifiers", "fee: net", True, False), (1, "qualifiers", None, False, False), (1, "qualifiers", "fee: no contradiction", True, False),
    ]))


def test_codes_and_dates_as_before(spark):
    from docquarry.functions.codes import currency_code
    from docquarry.operators.tokens import date_tokens

    rows = spark.createDataFrame([(c,) for c in ("AED", "ED ", "D A", "AE", "", "zł", "euro", "XXX", "ZWG", None)], "c string")
    assert [r[0] for r in rows.select(currency_code(F.col("c"))).collect()] == ["AED", None, None, None, None, "PLN", "EUR", None, "ZWG", None]
    text = "2024-02-30 2024-02-29 1.2.2024 30.02.2024 0000-01-01 5 MARCA 2024 May 7, 2024 7 foo 2024 2024-13-01"
    (found,) = spark.createDataFrame([(text,)], "t string").select(F.transform(date_tokens(F.col("t")), lambda d: d["date"].cast("string"))).first()
    assert found == ["2024-02-29", "2024-02-01", "2024-03-05", "2024-05-07"]


def test_rebuilt_selection_makes_candidates_once(spark):
    """What meets the candidates three times reads them as they were written."""
    from docquarry.plans import reviews

    plan = reviews.rebuilt_invoices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and len(plan) < 50_000


def test_sentences_of_long_words(spark):
    # words are read once: this took time in the square of a word's length
    word = "a" * 300_000
    rows = [(1, f"{word} B. {word}. C."), (2, "\x01. A\x02. 1"), (3, "x. . J.K. Nowak, etc... B? c! D")]
    found = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", sentence_interval(F.col("text")).alias("s")).orderBy("doc_id")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan
    assert [tuple(r["s"]) for r in found.collect()] == [(2, 2, True), (2, 3, False), (3, 4, False)]


def test_grounding_works_facts_out_once(spark):
    rows = [(1, 1, 0, "amount", 1, "5.00", "eur", "net", None, "cena  5,00"), (1, 1, 1, "amount", 2, "5.00", "PLN", "net", None, "Cena 5,00"), (1, 1, 2, "amount", 1, "6.00", "EUR", "net", None, "cena 5,00"), (1, 2, 0, "date", 1, None, None, None, "2026-01-02", "dnia 02.01.2026"), (1, 2, 1, "date", 1, None, None, None, "2026-01-02", "ab")]
    facts = spark.createDataFrame(rows, "doc_id long, chunk int, pos int, kind string, page int, value string, currency string, basis string, date string, evidence string").withColumns({"value": F.col("value").cast("decimal(18,2)"), "period": F.lit("unspecified"), "status": F.lit("current"), "context": F.lit("c")})
    pages = spark.createDataFrame([(1, 1, "Tu cena 5,00 EUR netto."), (1, 2, "Dnia 02.01.2026 i Cena\n5,00 zł"), (2, 1, None)], "doc_id long, page int, text string")
    parts = [(1, 1, 0, 1, 0, "", "Tu cena 5,00 EUR netto."), (1, 1, 1, 2, 0, "", "Dnia 02.01.2026 i Cena\n5,00 zł"), (1, 2, 2, 2, 0, "", "Dnia 02.01.2026 i Cena\n5,00 zł")]
    segments = spark.createDataFrame(parts, "doc_id long, chunk int, seq int, page int, start int, overlap string, new_text string")
    judged = grounding.grounded(facts, segments, pages)
    found = {(r["chunk"], r["pos"]): (r["found_page"], r["start"], r["end"], r["problem"]) for r in judged.collect()}
    assert found == {(1, 0): (1, 3, 12, None), (1, 1): (2, 18, 27, "qualifier"), (1, 2): (1, 3, 12, "value"), (2, 0): (2, 0, 15, None), (2, 1): (None, None, None, "evidence")}
    assert [r["chunk"] for r in grounding.merged_facts(judged.filter("pos = 0")).orderBy("chunk").collect()] == [1, 2] and grounding.merged_facts(judged).count() == 0
    # facts are one branch of the plan, however often what is made of them is looked at
    assert grounding.merged_facts(judged)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3


def test_contexts_find_numbers_once_a_page(spark):
    """Lines are judged by what the page's numbers and dates are, and a row is one by its cells, also where two share digits."""
    from docquarry.operators import contexts
    from docquarry.plans import registry

    plan = registry.queries()["contexts_invoices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"({tokens._NUMBER})") == 1
    line = "€ 5 marca 2026EUR ustalają łączną kwotę zobowiązania na"
    found = contexts.candidate_contexts(pages(spark, f"a\n{line}\nb", "100\nEUR, 12.03.2026 i 5\nmarca 2026")).orderBy("page", "start", "kind").collect()
    assert [r["context"] for r in found] == [
        "s. 1: »€ 5« marca 2026EUR ustalają łączną kwotę zobowiązania na", "s. 1: € »5 marca 2026«EUR ustalają łączną kwotę zobowiązania na", "s. 1: € 5 marca »2026EUR« ustalają łączną kwotę zobowiązania na",
        "s. 2: »100 EUR«, 12.03.2026 i 5 marca 2026", "s. 2: 100 EUR, »12.03.2026« i 5 marca 2026", "s. 2: 100 EUR, 12.03.2026 i »5 marca 2026«",
    ]


def test_only_numbers_that_may_be_amounts_are_looked_at(spark):
    """A page's numbers without cents and currency are not wrapped in marks; what is found is what all numbers would give, in texts of few and of many numbers."""
    bits = ["1 234", "12 345,5", "7,50", "007", "12 345 %", "1 234,567", "PLN 5", "€\u00a03", "1 000 EUR", "2 000\nzł", "1.234.567,89", "19.09.1995", "1995-08-20", "10 200 300,7", "USD\n8 100", "XYZ 4", "6 euro", "nr 12 zł", "12 345 678"]
    rows = [(1, k + 1, "a " + " ; ".join(bits[j % len(bits)] + " " * (j % 3) for j in range(k, k * 3 + 4))) for k in range(len(bits) * 2)]
    frame = pages(spark, *[t for _, _, t in rows])
    every = frame.select("page", F.inline(tokens.marked_numbers(F.col("text")))).filter((F.col("a").isNotNull()) | F.col("b").isNotNull() | F.col("text").rlike(tokens.CENTS))
    worth = frame.select("page", F.inline(tokens.marked_numbers(F.col("text"), worth=True)))
    kept = worth.filter((F.col("a").isNotNull()) | F.col("b").isNotNull() | F.col("text").rlike(tokens.CENTS))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, every.collect())) and kept.count() > 100
    assert worth.count() < frame.select(F.explode(tokens.marked_numbers(F.col("text")))).count()
    # offsets are the text's own, however many matches there are
    for r in worth.join(frame.select("page", F.col("text").alias("whole")), "page").collect():
        assert r["whole"][r["start"] : r["end"]] == r["text"]


def test_running_lines_read_pages_once(spark):
    frame = pages(spark, *[f"tytuł\ntekst {k}\nStrona {k} z 9" for k in range(1, 4)], "Strona 4 z 9 tu")
    found = candidates.running_lines(frame)
    assert sorted((r["page"], r["start"]) for r in found.collect()) == [(1, 14), (2, 14), (3, 14)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_quotes_and_sentences_are_found_in_one_search(spark):
    """A quote's first place, and the sentence around a value, as they were found match by match."""
    from docquarry.functions.normal import spelled
    from docquarry.functions.text import first_place

    rows = [("😀 Ala „ma”  KOTA i ala \"ma\" kota", 'ala "ma" kota', (2, 16)), ("straße STRASSE", "strasse", (0, 6)), ("a.b", "x", None), (None, "x", None), ("x", None, None), ("ab a-b", "a–b", (3, 6))]
    frame = spark.createDataFrame([(k, t, q) for k, (t, q, _) in enumerate(rows)], "k int, t string, q string")
    found = frame.select("k", first_place(F.col("t"), spelled(F.col("q"))).alias("p")).orderBy("k").collect()
    assert [r["p"] and tuple(r["p"]) for r in found] == [p for _, _, p in rows]
    plan = frame.select(first_place(F.col("t"), F.col("q")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1
    around = [("Raz. Dwa 5 trzy; cztery", "5", " Dwa 5 trzy;"), ("a\nb 5 c\nd", "5", "b 5 c\n"), ("x.5.", "5", "x.5."), ("x.\x015 y.\x01z", "5", "\x015 y."), ("5", "5", "5"), ("a" * 300 + " 5 " + "b" * 300, "5", "a" * 199 + " 5 " + "b" * 199)]
    frame = spark.createDataFrame([(k, t, t.index(v), t.index(v) + 1) for k, (t, v, _) in enumerate(around)], "k int, t string, s int, e int")
    found = frame.select("k", grounding.sentence_around(F.col("t"), F.col("s"), F.col("e")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in found] == [x for _, _, x in around]
    segments = spark.createDataFrame([], "doc_id long, chunk int, seq int, page int, start int, overlap string, new_text string")
    facts = spark.createDataFrame([], "doc_id long, chunk int, page int, evidence string")
    assert "BroadcastHashJoin" not in grounding.located(facts, segments)._jdf.queryExecution().executedPlan().toString()
