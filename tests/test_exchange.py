"""JSON shapes, requests, answers, prompts, saved runs and overtaken runs, on rows of every awkward kind."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from docquarry.functions import display, shapes
from docquarry.operators import answers, chunks, contract, layout, prompts, requests, rescoring, selection
from docquarry.operators.contexts import candidate_contexts
from docquarry.sources import cases
from docquarry.sources import requests as incoming
from docquarry.streaming import runs

SHAPE = shapes.Record(
    {"a": shapes.Whole(1, 5), "b": shapes.Number(), "c": shapes.Many(shapes.Text(1, 3), 1, 2), "d": shapes.Record({"k": shapes.Flag()}, closed=True), "t": shapes.filled(5, nullable=True)},
    optional=("t",), rules=((lambda r: shapes.child(r, "a", "int") != 4, "four"),),
)
JUDGED = [
    ('{"a":1,"b":1,"c":["x"],"d":{"k":true}}', []),
    ('{"a":4,"b":2.5e0,"c":["x","y"],"d":{"k":true},"t":null,"other":[]}', ["root: Value error, four"]),
    ('{"a":true,"b":"1","c":[1,""],"d":{"k":1,"z":2},"t":5}', ["a: Input should be a valid integer", "b: Input should be a valid number", "c.0: Input should be a valid string", "c.1: String should have at least 1 character", "d.k: Input should be a valid boolean", "d.z: Extra inputs are not permitted", "t: Input should be a valid string"]),
    ('{"a":1.0,"b":1e999,"c":[],"d":[],"t":"  "}', ["a: Input should be a valid integer", "b: Input should be a finite number", "c: List should have at least 1 item after validation, not 0", "d: Input should be an object", "t: Value error, must not be blank"]),
    ('{"a":9,"c":["x","y","z"],"d":{}}', ["a: Input should be less than or equal to 5", "b: Field required", "c: List should have at most 2 items after validation, not 3", "d.k: Field required"]),
    ('{"a":1,"b":null,"c":null,"d":null}', ["b: Input should be a valid number", "c: Input should be a valid list", "d: Input should be an object"]),
    ("[1]", ["root: Input should be an object"]),
    ("5", ["root: Input should be an object"]),
    ('"x"', ["root: Input should be an object"]),
    ('{"a":1} x', ["root: Field required"]),
    ('1],"value":[2', ["root: Field required"]),
    ('1,"mark":"x"}', ["root: Field required"]),
    ("", ["root: Field required"]),
    (None, ["root: Field required"]),
]


def test_shapes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JUDGED)], "i int, t string").withColumn("v", shapes.strict_json(F.col("t")))
    found = {r["i"]: r["p"] for r in rows.select("i", shapes.problems(F.col("v"), SHAPE).alias("p")).collect()}
    assert [found[i] for i in range(len(JUDGED))] == [p for _, p in JUDGED]


def test_numbers_and_texts(spark):
    rnd = random.Random(1)
    xs = [184500.0, 1e7, 0.1, 1e16, 1e15, 1e23, 8.41e21, 1e-4, 1e-5, 5e-324, -0.0, 0.0, -12.5, 1e21, 1e20, 12345678.25, 99999999999999.98, float("inf")]
    xs += [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(300)] + [round(rnd.uniform(-1e9, 1e9), 2) for _ in range(300)]
    xs = [x for x in xs if x == x]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", shapes.number_text(F.col("x")).alias("t")).collect():
        assert r["t"] == repr(r["x"]).replace("inf", "Infinity")
    texts = ['a"b\\c', "\n\r\t\f\b\x01\x1f\x7f", "żółć 日本 😀 ", ""]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", shapes.string_text(F.col("t")).alias("j")).collect():
        assert r["j"] == json.dumps(r["t"], ensure_ascii=False)


RESULT = {
    "document": {"fileName": "a.pdf", "pages": 2, "language": "pl", "type": "umowa", "title": 'Tytuł "x"', "date": None}, "summary": "Raz jest. Dwa są. Trzy też.", "keyPoints": ["a", "b", "c"], "entities": {"organizations": [], "people": ["Ewa Lis"]},
    "amounts": [{"value": 12345678.0, "currency": "PLN", "context": "c"}, {"value": 5, "currency": "EUR", "context": "d"}, {"value": 0.1, "currency": "EUR", "context": "e"}], "dates": [{"date": "2026-03-12", "context": "d"}], "keywords": [],
    "analysis": {"complete": False, "pagesWithoutText": [2], "titleFallback": False, "ocrPages": [1]},
}


def changed(**fields):
    out = json.loads(json.dumps(RESULT))
    for path, value in fields.items():
        *above, last = path.split("__")
        at = out
        for part in above:
            at = at[int(part) if part.isdigit() else part]
        at[last] = value
    return out


def test_records_are_told_by_their_fields(spark):
    value = spark.createDataFrame([("{}",)], "t string").select(F.try_parse_json("t").alias("v")).cache()
    plan = value.select(shapes.problems(F.col("v"), contract.COMPACT).alias("x"))._jdf.queryExecution().analyzed().toString()
    # the kind of a whole answer, which all of it is read for, is only asked of one without any field
    assert "OR StartsWith(schema_of_variant(try_variant_get(v#" in plan
    odd = spark.createDataFrame([(1, "[]"), (2, "{}"), (3, "5"), (4, '{"zz":1}')], "i int, t string").select("i", shapes.problems(F.try_parse_json("t"), contract.COMPACT).alias("p"))
    found = {r["i"]: r["p"] for r in odd.collect()}
    assert found[1] == found[3] == ["root: Input should be an object"] and found[2] == found[4] and len(found[2]) == 12


def test_text_is_written_once(spark):
    value = spark.createDataFrame([("{}",)], "t string").select(F.try_parse_json("t").alias("v")).cache()
    for style in (shapes.CANONICAL, shapes.PRETTY):
        plan = value.select(shapes.json_text(F.col("v"), contract.RESULT, style).alias("x"))._jdf.queryExecution().analyzed().toString()
        # a few reads for each of the 28 places of a result, not twice as many on every level
        assert plan.count("try_variant_get") < 300
    odd = '{"summary":"a\\u001f\\"\\\\u00ff","keyPoints":["\\t\\u0001",1,null,{"b":[],"a":1.50}],"amounts":[{"value":17.0,"zz":1},{},5],"entities":{},"dates":"no"}'
    written = spark.createDataFrame([(odd,)], "t string").select(shapes.json_text(F.try_parse_json("t"), contract.RESULT)).first()[0]
    assert written == '{"amounts":[{"value":17.0},{},5],"dates":"no","entities":{},"keyPoints":["\\t\\u0001",1,null,{"a":1.5,"b":[]}],"summary":"a\\u001f\\"\\\\u00ff"}'


def test_results(spark):
    wrong = [changed(amounts__0__value=True), changed(amounts__0__value="5"), changed(document__pages=2.0), changed(extra=1), changed(analysis__complete=True), changed(analysis__ocrPages=[2]), changed(document__date="2026-02-30"), changed(keyPoints=["a", "b"]), changed(entities__people="Ewa"), changed(document__language="PL"), changed(summary="Raz. Dwa.")]
    right = [RESULT, changed(analysis=None), changed(keywords=["k"] * 20)]
    del right[0]["analysis"]["ocrPages"]
    rows = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate([*right, *wrong])], "i int, t string").withColumn("v", shapes.strict_json(F.col("t")))
    v = F.col("v")
    for r in rows.select("i", "t", shapes.problems(v, contract.RESULT).alias("p"), requests.result_digest(v).alias("d"), requests.result_text(v).alias("s")).collect():
        x = json.loads(r["t"])
        assert (r["p"] == []) == (r["i"] < len(right)), r
        if r["i"] < len(right):
            assert r["d"] == hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            # browsers write whole numbers without a point
            assert r["s"] == json.dumps(x, ensure_ascii=False, indent=2).replace("12345678.0", "12345678") + "\n"


def test_requests(spark):
    long = "Litery są tu i tam w zdaniu. " * 12
    fine = {"fileName": "a.pdf", "pageCount": 2, "pages": [{"page": 1, "text": long}, {"page": 2, "text": " 1 "}], "pagesWithoutText": [2]}
    body = lambda **k: json.dumps({**fine, **k}, ensure_ascii=False).encode()
    one = lambda text: body(pageCount=1, pages=[{"page": 1, "text": text}], pagesWithoutText=[] if any(c.isalpha() for c in text) else [1])
    bodies = [
        (body(), "ADMITTED"), (b"\xef\xbb\xbf" + body(), "ADMITTED"), (body()[:-3], "INVALID_REQUEST"), (body() + b"\xff", "INVALID_REQUEST"), (body(pageCount="2"), "INVALID_REQUEST"), (body(extra=1), "INVALID_REQUEST"),
        (body(pagesWithoutText=[]), "INVALID_REQUEST"), (body(ocrPages=[1]), "INVALID_REQUEST"), (body(ocrPages=[2]), "INVALID_REQUEST"), (body(fileName="a/b"), "INVALID_REQUEST"), (b"[1]", "INVALID_REQUEST"), (b"", "INVALID_REQUEST"), (None, "INVALID_REQUEST"),
        (one("abc"), "INSUFFICIENT_CONTENT"), (one("1"), "NO_TEXT_LAYER"), (body(pageCount=3, pages=[{"page": i, "text": "a" * 19_000} for i in (1, 2, 3)], pagesWithoutText=[]), "DOCUMENT_TOO_LONG"),
        (body(pages=[{"page": 2, "text": long}, {"page": 1, "text": "1"}]), "INVALID_REQUEST"), (b" " * 300_000, "BODY_TOO_LARGE"), (body(pages=[{"page": 1, "text": long}, {"page": 2.0, "text": "1"}]), "INVALID_REQUEST"),
    ]
    frame = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(bodies)], "id int, body binary")
    found = incoming.requests(frame)
    assert [r["verdict"] for r in found.orderBy("id").collect()] == [v for _, v in bodies]
    assert [r["verdict"] for r in incoming.requests(frame.filter("id = 7"), "compact").collect()] == ["ADMITTED"]
    assert sorted((r["doc_id"], r["page"], len(r["text"])) for r in incoming.admitted_pages(found).collect()) == [(0, 1, len(long)), (0, 2, 3), (1, 1, len(long)), (1, 2, 3)]
    assert incoming.requests(frame.filter("false")).collect() == []


def test_request_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"{}")
    (tmp_path / "b.json").write_bytes(b"\xff")
    found = incoming.requests(incoming.request_files(spark, str(tmp_path)))
    assert {r["id"][-6:]: (r["verdict"], r["problems"][0]) for r in found.collect()} == {"a.json": ("INVALID_REQUEST", "fileName: Field required"), "b.json": ("INVALID_REQUEST", "root: not valid JSON in UTF-8")}


def test_answers(spark):
    raws = ['{"response":{"a":1}}', '{"response":"{\\"a\\":1}"}', '{"choices":[{"message":{"content":"{\\"a\\":1}"}}]}', '{"a":1}', '"{\\"a\\":1}"', "[1]", "5", '{"response":5}', '{"response":null}', '{"response":"x"}', '{"choices":[{"message":{}}]}', "sorry", None, '{"choices":[]}']
    found = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", requests.answer(F.col("raw")).alias("a")).orderBy("i").collect()
    said = [r["a"]["problem"] for r in found]
    objects, none = "response must be a JSON object", "response is not valid JSON"
    assert said == [None] * 5 + [objects, objects, objects, objects, none, objects, none, none, None]


GOOD = {"insufficientContent": False, "language": " PL ", "type": "umowa", "title": " ", "mainDateId": 1, "summary": " Umowa jest. Strony są. Kwota jest. ", "keyPoints": ["a", " A", "b", "c "], "organizations": ["Kwadrat", "kwadrat S.A."], "people": ["Ewa Lis"], "keywords": ["k", "K", " "], "amountIds": [3, 2], "dateIds": [1]}


def attempts_of(spark, rows):
    return spark.createDataFrame([(d, a, None if x is None else x if isinstance(x, str) else json.dumps(x), e, left) for d, a, x, e, left in rows], "doc_id long, attempt int, raw string, error string, left double")


def test_compact_answers(spark):
    v = lambda **k: {**GOOD, **k}
    rows = [
        (1, 1, {"response": v()}, None, 50.0), (2, 1, v(people=["Nie Ma"]), None, 50.0), (2, 2, v(), None, 30.0), (3, 1, v(amountIds=[2, 2, 9, 1], mainDateId=3, people=["X Y", "Zófia", "Lis"]), None, 50.0), (3, 2, "sorry", None, 30.0),
        (4, 1, v(insufficientContent=True, summary="x"), None, 50.0), (5, 1, v(amountIds=["2"]), None, 50.0), (5, 2, v(summary="⟦A2⟧ 5 jest. Tak. Nie."), None, 30.0), (6, 1, v(summary="⟦D1⟧ x. Tak. Nie."), None, 50.0), (7, 1, None, "quota", 50.0),
        (8, 1, None, "invalid_output", 50.0), (8, 2, v(), None, 3.0), (9, 1, v(organizations=["x" * 600]), None, 50.0), (9, 2, v(language="xx", type="list"), None, 30.0),
    ]
    ids = range(1, 10)
    pages = spark.createDataFrame([(i, 1, "Umowa 12.03.2026 Kwadrat S.A. i Ewa\nLis oraz Zófia; Kwota 5,00 zł netto. Potem 7,00 zł.") for i in ids], "doc_id long, page int, text string")
    papers = spark.createDataFrame([(i, " a.pdf ", 1, [], [1]) for i in ids], "doc_id long, file_name string, pages int, pages_without_text array<int>, ocr_pages array<int>")
    judged = answers.compact_answers(attempts_of(spark, rows), answers.bundles(papers, pages, candidate_contexts(pages)))
    found = {(r["doc_id"], r["attempt"]): r for r in judged.collect()}
    lost = "not written in the document; copy the name exactly as one occurrence spells it, or leave it out"
    assert found[3, 1]["problems"] == [f"people.0: {lost}", "amountIds.1: id 2 repeated", "amountIds.2: id 9 is not a candidate", "amountIds.3: id 1 is not a amount candidate", "mainDateId.0: id 3 is not a date candidate"]
    assert found[6, 1]["problems"] == ["summary: contains an internal marker; write plain text"] and found[9, 1]["problems"] == ["entities.organizations: does not match the contract"]
    made = found[1, 1]["result"]
    assert (made["file_name"], made["language"], made["title"], made["date"], made["summary"]) == ("a.pdf", "pl", "Dokument bez tytułu", "2026-03-12", "Umowa jest. Strony są. Kwota jest.")
    assert made["organizations"] == ["Kwadrat S.A."] and made["key_points"] == ["a", "b", "c"] and [a["value"] for a in made["amounts"]] == [5.0, 7.0] and made["ocr_pages"] == [1] and made["title_fallback"]
    ends = {r["doc_id"]: (r["outcome"], r["attempts"]) for r in answers.analyses(judged).collect()}
    assert ends == {1: ("OK", 1), 2: ("OK", 2), 3: ("AI_INVALID_OUTPUT", 2), 4: ("INSUFFICIENT_CONTENT", 1), 5: ("OK", 2), 6: ("AI_TIMEOUT", 2), 7: ("AI_QUOTA_EXCEEDED", 1), 8: ("AI_TIMEOUT", 2), 9: ("AI_INVALID_OUTPUT", 2)}


def test_single_answers(spark):
    own = {k: x for k, x in GOOD.items() if k not in ("mainDateId", "amountIds", "dateIds")} | {"date": " 2026-03-12 ", "amounts": [{"value": 5, "currency": "pln ", "context": " c "}], "dates": [{"date": "2026-03-12 ", "context": "d"}]}
    w = lambda **k: {**own, **k}
    given = [w(), w(amounts=[{"value": True, "currency": "PLN", "context": "c"}]), w(date="12.03.2026"), {"insufficientContent": True}, w(amounts=[{"value": 1.5, "currency": "zł", "context": "c"}]), w(keywords=[f"k{i}" for i in range(21)]), w(dates=None)]
    papers = spark.createDataFrame([(i, "a.pdf", 1, []) for i in range(len(given))], "doc_id long, file_name string, pages int, pages_without_text array<int>")
    found = answers.single_answers(attempts_of(spark, [(i, 1, x, None, 50.0) for i, x in enumerate(given)]), papers).orderBy("doc_id").collect()
    broken = "does not match the contract"
    assert [r["problems"] for r in found] == [[], ["amounts.0.value: Input should be a valid number"], [f"document.date: {broken}"], [], [f"amounts: {broken}"], [f"keywords: {broken}"], ["dates: Input should be a valid list"]]
    assert found[0]["result"]["amounts"][0].asDict() == {"value": 5.0, "currency": "PLN", "context": "c"} and found[0]["result"]["date"] == "2026-03-12" and found[3]["insufficient"]


def test_names_in_either_form(spark):
    names = spark.createDataFrame([(1, 0, "Zófia"), (1, 1, "Zófia Lis"), (1, 2, "ZÓFIA")], "doc_id long, pos int, name string")
    pages = spark.createDataFrame([(1, 1, "była Zófia,"), (1, 2, "Zófia\n Lis")], "doc_id long, page int, text string")
    assert {r["pos"]: r["attested"] for r in selection.attested(names, pages).collect()} == {0: True, 1: True, 2: True}


def test_beginnings(spark):
    def by_hand(text, room):
        end = max(room, 1)
        if len(text) <= room:
            return text
        for mark in ("\n\n", "\n", " "):
            at = text.rfind(mark, max(1, end - 1000), end)
            if at != -1:
                return text[: at + len(mark)]
        return text[:end]

    rnd = random.Random(2)
    rows = [("".join(rnd.choice(["a", "bc", " ", "\n", "\n\n", "x" * 50, "ż"]) for _ in range(rnd.randrange(0, 400))).replace(*(" ", "_") if i % 7 == 0 else ("", "")), rnd.randrange(0, 3000)) for i in range(200)]
    for r in spark.createDataFrame(rows, "t string, n int").select("t", "n", chunks.beginning(F.col("t"), F.col("n")).alias("b")).collect():
        assert r["b"] == by_hand(r["t"], r["n"])


def test_prompts(spark):
    pages = spark.createDataFrame([(1, 1, "a </page> b"), (1, 2, "1"), (1, 3, "c")], "doc_id long, page int, text string")
    papers = spark.createDataFrame([(1, 3, [2], [3])], "doc_id long, pages int, pages_without_text array<int>, ocr_pages array<int>")
    (single,) = prompts.document_messages(papers, pages).collect()
    assert single["message"].endswith('<document>\n<page number="1">\na [tag] b\n</page>\n<page number="2" status="no-extractable-text"></page>\n<page number="3">\nc\n</page>\n</document>') and "(not analysed): 2." in single["message"]
    (compact,) = prompts.document_messages(papers, pages, "compact").collect()
    assert '<page number="3" source="ocr">' in compact["message"] and "Text of pages 3 " in compact["message"]
    (overview,) = prompts.overview_messages(papers, pages).collect()
    assert overview["message"].endswith('c\n</page>\n<page number="2" status="no-extractable-text"></page>\n</document>') and "the full readable text" in overview["message"]
    pieces = spark.createDataFrame([(1, 1, 0, 1, "", "a"), (1, 2, 0, 1, "a", "b"), (1, 2, 1, 3, "", "c")], "doc_id long, chunk int, seq int, page int, overlap string, new_text string")
    second = prompts.chunk_messages(papers, pieces).filter("chunk = 2").first()["message"]
    assert second.startswith("This is part 2 of 2 of a 3-page document (pages 1, 3 in this part). ") and '<page number="1" continued="true">\nab\n</page>' in second
    turns = spark.range(1).select(prompts.correction_history(F.lit("m"), F.lit("x" * 9000), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("p"), i.cast("string")))).alias("h")).first()["h"]
    assert [(t["role"], len(t["content"])) for t in turns[:2]] == [("user", 1), ("assistant", 8000)] and "p8. Return" in turns[2]["content"]


def test_recognised_lists(spark):
    papers = spark.createDataFrame([(1, [2, 3], [4]), (2, [], [])], "doc_id long, pages_without_text array<int>, ocr_pages array<int>")
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, None), (1, 4, "d"), (2, 1, "b")], "doc_id long, page int, text string")
    found = spark.createDataFrame([(1, 0, 2, "x", None), (1, 1, 2, "y", None), (1, 0, 3, "12", None), (1, 0, 1, "no", "no"), (2, 0, 1, "no", None)], "doc_id long, pos int, page int, machine string, edited string")
    papers, pages = layout.recognised_documents(papers, pages, found)
    again = spark.createDataFrame([(1, 0, 3, "12", "edit"), (1, 0, 2, "late", None)], found.schema)
    papers, pages = layout.recognised_documents(papers, pages, again)
    assert {r["doc_id"]: (r["pages_without_text"], r["ocr_pages"]) for r in papers.collect()} == {1: ([], [2, 3, 4]), 2: ([], [])}
    assert {(r["doc_id"], r["page"]): r["text"] for r in pages.collect()} == {(1, 1): "a", (1, 2): "y", (1, 3): "edit", (1, 4): "d", (2, 1): "b"}


def test_settings_and_log(spark):
    given = [{}, {"ENVIRONMENT": "development", "ALLOWED_ORIGINS": " https://a/ ,,https://b", "AI_MODE": "compact", "MAX_BODY_BYTES": " 5 ", "AI_TIMEOUT_SECONDS": "x"}, {"ENVIRONMENT": "test", "AI_MODE": "all", "AI_MODEL": "", "AI_MAX_TOKENS": "99999"}]
    first, second, third = [r["s"] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g map<string,string>").orderBy("i").select(requests.settings(F.col("g")).alias("s")).collect()]
    assert (first["environment"], first["allowed_origins"], first["mode"], first["max_body_bytes"]) == ("production", [], "single", 262_144)
    assert (second["environment"], second["mode"], second["max_body_bytes"], second["timeout_seconds"]) == ("development", "compact", 1_024, 40.0) and second["allowed_origins"] == ["http://127.0.0.1:5173", "http://localhost:5173", "https://a", "https://b"]
    assert (third["environment"], third["mode"], third["max_tokens"], third["model"]) == ("production", "single", 4_096, first["model"])
    calls = spark.createDataFrame([("c", 1, 2.5, "secret", ["p" * 200] * 12), ("c", 2, None, "x", [])], "label string, attempt int, ms double, text string, problems array<string>")
    lines = requests.log_lines(calls).orderBy("attempt").collect()
    assert lines[0].asDict().keys() == {"event", "label", "attempt", "problems"} and len(lines[0]["problems"]) == 10 and len(lines[0]["problems"][0]) == 160 and lines[1]["problems"] is None


def test_display(spark):
    found = spark.range(1).select(display.amount(F.lit(1234.5), F.lit("PLN")), display.amount(F.lit(-12345.675), F.lit("CHF")), display.long_date(F.lit("2026-03-01")), display.page_list(F.array(F.lit(1), F.lit(2), F.lit(5))), display.page_list(F.array().cast("array<int>")), display.size(F.lit(100)), display.size(F.lit(1_572_864)), display.seconds(F.lit(61_249)), display.type_label(F.lit("inne")), display.saved_at(F.lit("2026-05-02 07:05:00").cast("timestamp"))).first()
    assert [x.replace(" ", " ") for x in found] == ["1234,50 zł", "-12 345,68 CHF", "1 marca 2026", "1, 2 i 5", "", "1 KB", "1,5 MB", "61,2 s", "Inny dokument", "2 maj 2026, 07:05"]


def test_rescoring_files(spark, tmp_path):
    request = {"fileName": "a.pdf", "pageCount": 2, "pages": [{"page": 1, "text": "Umowa. Ewa"}, {"page": 2, "text": "Lis płaci 5,00 PLN netto. Termin 12.03.2026."}], "pagesWithoutText": []}
    expect = {"amounts": [{"value": 5, "currency": "PLN", "label": "kwota", "page": 2, "evidence": "płaci 5,00 PLN", "qualifiers": ["net"]}], "dates": [{"date": "2026-03-12", "label": "t", "page": 2, "evidence": "Termin 12.03.2026", "event": [["nieznan"]], "eventReview": "manual"}], "people": ["Ewa Lis"], "forbiddenAmounts": [{"value": 9, "currency": "PLN"}]}
    result = {"document": {"fileName": "a.pdf", "pages": 2, "language": "pl", "type": "umowa", "title": "U", "date": None}, "summary": "Raz. Dwa. Trzy.", "keyPoints": ["a", "b", "c"], "entities": {"organizations": [], "people": ["Ewa Lis"]}, "amounts": [{"value": 5, "currency": "PLN", "context": "s. 2: płaci »5,00 PLN« netto"}], "dates": [{"date": "2026-03-12", "context": "Termin »12.03.2026«"}], "keywords": [], "analysis": {"complete": True, "pagesWithoutText": [], "titleFallback": False}}
    digest = hashlib.sha256(json.dumps(result, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    review = {"resultSha256": digest, "dimensions": {d: {"verdict": "pass"} for d in ("summary_factual", "key_points_factual", "contexts_meaning", "language_fidelity")}}
    root = tmp_path / "live"
    for name, value in {"cases/own.json": {"id": "own", "input": {"request": request}, "expect": expect}, "cases/other.json": {"id": "other", "input": {"localRequest": "far/request.json"}, "expect": expect}, "far/request.json": request, "out/a.json": result, "out/review.json": review}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(json.dumps(value, ensure_ascii=False))
    (root / "out/bad.json").write_text("{")
    listed = [{"label": "one", "case": "own", "response": "out/a.json", "httpStatus": 200, "latencyMs": 900, "manualReview": "out/review.json"}, {"label": "two", "case": "other", "response": "out/a.json", "httpStatus": 200}, {"label": "three", "case": "own", "response": "out/bad.json", "httpStatus": 200, "latencyMs": 1}, {"label": "four", "case": "none", "response": "out/gone.json", "httpStatus": 500, "latencyMs": 1}]
    (tmp_path / "manifest.json").write_text(json.dumps(listed))
    manifest, found = cases.manifest(spark, str(tmp_path / "manifest.json")), cases.files(spark, str(root))
    reports = rescoring.rescored(manifest, found)
    rows = {r["label"]: r for r in reports.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"one": "accepted", "two": "needs_manual_review", "three": "failed", "four": "failed"}
    # a person's name that goes on over a page's end is grounded, and an unnamed event is only asked of a reviewer
    assert rows["one"]["by_category"]["grounding"] == "3/3" and "t: event" in rows["two"]["pending"] and "latency" in rows["two"]["pending"] and rows["one"]["digest"] == digest
    out = str(tmp_path / "reports")
    rescoring.write_reports(reports, out)
    rescoring.write_reports(reports.filter("label = 'one'").withColumn("status", F.lit("again")), out)
    again = {r["label"]: r["status"] for r in spark.read.json(out).select("label", "status").collect()}
    assert again == {"one": "again", "two": "needs_manual_review", "three": "failed", "four": "failed"}
    assert {r["label"]: r["score"] for r in rescoring.summary(reports).collect()}["four"] == "—"


def test_overtaken_runs(spark, tmp_path):
    at = lambda minute: f"2026-01-01 00:{minute:02d}:00"
    parts = [
        [(1, 1, "start", at(0), None), (1, 1, "result", at(1), "a"), (2, 1, "start", at(0), None)],
        [(1, 2, "start", at(2), None), (1, 1, "result", at(3), "stale"), (2, 1, "result", at(3), "b")],
        [(1, 2, "result", at(4), "c"), (3, 5, "result", at(4), "d"), (3, 4, "result", at(5), "stale")],
    ]
    shape = "owner long, run_id long, kind string, at string, payload string"
    frame = lambda rows: spark.createDataFrame(rows, shape).withColumn("at", F.to_timestamp("at"))
    for i, rows in enumerate(parts):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = runs.current_results(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted((r["owner"], r["run_id"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1, "a"), (1, 2, "c"), (2, 1, "b"), (3, 5, "d")]
    whole = frame([r for rows in parts for r in rows])
    assert sorted((r["owner"], r["run_id"], r["payload"]) for r in runs.latest_results(whole).collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 5, "d")]
    assert runs.latest_results(whole.filter("run_id = 2 AND kind = 'start'")).collect() == []


@pytest.mark.parametrize("table", ["compact", "chunk"])
def test_shapes_of_answers(spark, table):
    if table == "compact":
        value, shape, expected = {**GOOD, "mainDateId": None, "title": None, "extra": 1}, contract.COMPACT, []
    else:
        value, shape = {"amounts": [{"value": 1, "currency": "PLNX", "basis": "net", "period": "other", "status": "now", "context": " ", "page": 0, "evidence": "e" * 301}], "dates": [], "organizations": [], "people": [None], "keywords": []}, contract.CHUNK
        expected = ["amounts.0.currency: String should have at most 3 characters", "amounts.0.status: Input should be 'current', 'rejected', 'historical', 'proposed', 'estimated', 'budget', 'maximum' or 'unspecified'", "amounts.0.context: Value error, must not be blank", "amounts.0.page: Input should be greater than or equal to 1", "amounts.0.evidence: String should have at most 300 characters", "people.0: Input should be a valid string"]
    assert spark.createDataFrame([(json.dumps(value),)], "t string").select(shapes.problems(shapes.strict_json(F.col("t")), shape)).first()[0] == expected


def test_no_bundle_over_the_limits(spark):
    """A document with too many candidates or characters has no bundle, so nothing is made of its answers; one without any candidate has."""
    pages = spark.createDataFrame([(1, 1, "kwota 5,00 zł\n" * 401), (2, 1, "x" * 64_001), (3, 1, "nic"), (4, 1, "kwota 5,00 zł")], "doc_id long, page int, text string")
    papers = spark.createDataFrame([(i, "a", 1, [], []) for i in range(1, 5)], "doc_id long, file_name string, pages int, pages_without_text array<int>, ocr_pages array<int>")
    found = answers.bundles(papers, pages, candidate_contexts(pages)).select("doc_id", F.size("found").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == {3: 0, 4: 1}


def test_fields_of_an_answer_are_read_out_once(spark):
    """A field's value and kind are worked out once, however many tests it must pass; a whole answer's kind is not worked out at all."""
    frame = spark.range(1).select(F.parse_json(F.lit('{"summary":"a"}')).alias("v"))
    plan = frame.select(shapes.problems(F.col("v"), contract.COMPACT))._jdf.queryExecution().analyzed().toString()
    # the others look whether the whole has any field, so is an object
    assert [plan.count(f"$.{name},") for name in ("summary", "title", "amountIds", "mainDateId")] == [3, 3, 3, 3]
    raws = ['{"a":1}', '[{"a":1}]', '{"response":"{\\"a\\":1}"}', '{"a":1},{"a":2}', '{"a":1}]', '{"a":1} x', '{"response":5}', '{"response":"5"}', '{"response":"{"}', '"{}"', None]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", requests.answer(F.col("raw")).alias("a"))
    found = [(r[0], r[1]) for r in rows.orderBy("k").select(F.col("a.payload").cast("string"), "a.problem").collect()]
    bad, no = (None, requests.NO_JSON), (None, requests.NO_OBJECT)
    assert found == [('{"a":1}', None), no, ('{"a":1}', None), bad, bad, bad, no, no, bad, ("{}", None), bad]


def test_bundles_are_not_broadcast(spark):
    """Bundles hold the documents' texts, and grow with them, whatever their estimated size."""
    from docquarry.plans import exchange

    plan = exchange.analysed_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
