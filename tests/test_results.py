"""Sentences, names, chunks, layout and kept results on small texts with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import names, sentences
from docquarry.operators import chunks, layout, results


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, (0, 0, False)),
        (" \n ", (0, 0, False)),
        ("One. Two! Three?", (3, 3, True)),
        ("Firma Alfa sp. z o.o. Kraków zapłaci.", (1, 2, True)),
        ("J. K. Nowak signed. He left.", (2, 4, True)),
        ("See pt. 5 of it. 7 more", (1, 3, False)),
        ("He said “Go.” Then he went…", (2, 2, True)),
        ("no. small letters. follow", (1, 1, False)),
        ("Ends here... Łódź follows.", (2, 2, True)),
    ],
)
def test_sentences(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(sentences.sentence_interval(F.col("t")).alias("s")).first()
    assert tuple(row["s"]) == expected


def test_organisations(spark):
    df = spark.createDataFrame([(["Modra Sowa", "modra  sowa", "Modra Sowa S.A.", "Beta", "Beta Transport", "", None],), ([],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(names.distinct_organisations(F.col("n"))).collect()] == [["Modra Sowa S.A.", "Beta", "Beta Transport"], [], []]


def test_tags_and_messages(spark):
    df = spark.createDataFrame([("a </ Page number=1> b <DOCUMENT c",)], "t string")
    assert df.select(names.without_tags(F.col("t"))).first()[0] == "a [tag] b [tag]"
    df = spark.createDataFrame([("AiError: 5024: JSON Mode couldn't be met",), ("4006: neurons",), ("12345 failed",)], "t string")
    assert [tuple(r[0]) for r in df.select(names.provider_problem(F.col("t"))).collect()] == [("invalid_output", 5024), ("quota", 4006), ("unavailable", None)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab \n", min_size=1, max_size=60), st.integers(1, 400)), min_size=1, max_size=6), st.booleans())
def test_pieces_cover_pages(parts, fill):
    pages = [(k + 1, (t * n)[:10_600]) for k, (t, n) in enumerate(parts)]
    found, text = list(chunks._pieces(pages, fill)), dict(pages)
    size = {}
    for c, p, s, e, o in found:
        size[c] = size.get(c, 0) + len(o) + e - s
        assert text[p][:s].endswith(o) and len(o) <= chunks.OVERLAP
    assert max(size.values()) <= chunks.CHUNK and sorted(size) == list(range(1, len(size) + 1))
    assert ["".join(text[p][s:e] for _, q, s, e, _ in found if q == p) for p in text] == list(text.values())
    assert not fill or len(size) <= chunks.MOST_CHUNKS


def test_chunks(spark):
    long = "słowo " * 2_500
    df = spark.createDataFrame([(1, 2, "b" * 4_000), (1, 1, long), (1, 3, "12 34"), (2, 1, "x" * 64_001), (3, 1, None)], "doc_id long, page int, text string")
    found = chunks.chunks(df).orderBy("doc_id", "seq").collect()
    assert {r["doc_id"] for r in found} == {1} and "".join(r["new_text"] for r in found) == long + "b" * 4_000
    assert [(r["chunk"], r["page"]) for r in found] == [(1, 1), (2, 1), (2, 2)] and found[1]["overlap"] and not found[2]["overlap"]
    assert chunks.chunks(df.limit(0)).count() == 0
    # ten pages that cannot be paired are more than eight chunks unless pages are cut
    df = spark.createDataFrame([(1, k, "a b " * 1_500) for k in range(1, 11)], "doc_id long, page int, text string")
    found = chunks.chunks(df).orderBy("seq").collect()
    assert found[-1]["chunk"] <= 8 and sum(len(r["new_text"]) for r in found) == 60_000


def test_documents_that_one_chunk_holds_are_not_packed(spark, monkeypatch):
    """Their pages are the pieces, as packing would make them; the packing itself is not called for them."""
    pages = [(1, 3, "c" * 4_000), (1, 1, "ąb 😀\n\nc"), (1, 2, "12 34"), (2, 7, "d e " * 2_500), (3, 1, "  ")]
    frame = spark.createDataFrame(pages, "doc_id long, page int, text string")

    def refuse(group):
        raise ValueError("packed")

    packed = sorted((1, c, k, p, s, e, o) for k, (c, p, s, e, o) in enumerate(chunks._pieces([(p, t) for d, p, t in sorted(pages) if d == 1 and p != 2], False)))
    monkeypatch.setattr(chunks, "_chunked", refuse)
    found = sorted(tuple(r) for r in chunks.chunks(frame).collect())
    assert [r[:7] for r in found if r[0] == 1] == packed
    assert [r[7] for r in found] == ["ąb 😀\n\nc", "c" * 4_000, "d e " * 2_500]


def test_long_documents_are_chunked_too(spark):
    """Without the limit of admission a document of any length has chunks, each within its bounds, that hold all of it."""
    text = "".join(f"word{k} " + "\n" * (k % 7 == 0) for k in range(17_000))
    frame = spark.createDataFrame([(1, 1, text), (1, 2, "y" * 64_001), (2, 1, "z z " * 3_000)], "doc_id long, page int, text string")
    found = chunks.chunks(frame, most_chars=None).orderBy("doc_id", "seq").collect()
    assert len(text) > 2 * chunks.MOST_CHARS and "".join(r["new_text"] for r in found if r["doc_id"] == 1) == text + "y" * 64_001
    sizes = {}
    for r in found:
        sizes[r["doc_id"], r["chunk"]] = sizes.get((r["doc_id"], r["chunk"]), 0) + len(r["overlap"]) + len(r["new_text"])
    assert max(sizes.values()) <= chunks.CHUNK and max(c for d, c in sizes if d == 1) > chunks.MOST_CHUNKS
    assert {r["doc_id"] for r in chunks.chunks(frame).collect()} == {2}


def test_candidates_and_selections_are_not_broadcast(spark):
    """Their size is estimated by the table that they are made of, however small that is in files; what grows with the rows never goes through the driver."""
    from docquarry.plans import registry

    found = registry.queries()["rebuilt_selection_invoices"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2 and found.count() == 4_500


def test_layout(spark):
    items = [(1, 1, 0, "World", 60.0, 700.0, 40.0, 10.0), (1, 1, 1, "Hello", 10.0, 703.0, 45.0, 10.0), (1, 1, 2, "be", 10.0, 680.0, 10.0, 10.0), (1, 1, 3, "low", 21.0, 680.0, 10.0, 10.0), (1, 1, 4, "", 0.0, 900.0, 1.0, 1.0), (1, 1, 5, " \t", 0.0, 650.0, 1.0, 1.0)]
    df = spark.createDataFrame(items, "doc_id long, page int, n int, str string, x double, y double, w double, h double")
    assert [tuple(r) for r in layout.page_text(df).collect()] == [(1, 1, "Hello World\nbelow")]
    assert layout.page_text(df.limit(0)).count() == 0


def test_recognised(spark):
    pages = spark.createDataFrame([(1, 1, "text"), (1, 2, None), (1, 3, "3"), (1, 4, "4")], "doc_id long, page int, text string")
    read = spark.createDataFrame([(1, 1, "other", None), (1, 2, " a \n\n\n\nb ", None), (1, 3, "a", "edit"), (1, 4, "77", None)], "doc_id long, page int, machine string, edited string")
    assert sorted(map(tuple, layout.with_recognised(pages, read).collect())) == [(1, 1, "text", False), (1, 2, "a\n\nb", True), (1, 3, "edit", True), (1, 4, "4", False)]


def test_kept_results(spark):
    rows = [(1, k, k, "x" * 10) for k in range(6)] + [(2, 1, 1, "y" * 200), (2, 2, 0, "y")]
    df = spark.createDataFrame(rows, "owner int, id int, saved_at int, entry string")
    kept = {(r["owner"], r["id"]) for r in results.kept_results(df, 4, len(results.WRAPPER) + 32).collect()}
    assert kept == {(1, 5), (1, 4), (1, 3), (2, 2)}


def test_marks(spark):
    pages = spark.createDataFrame([(1, 1, "⟦A9⟧ 5 zł <page>"), (1, 2, None)], "doc_id long, page int, text string")
    found = spark.createDataFrame([(1, 1, 1, "amount", 5)], "doc_id long, page int, candidate_id int, kind string, start int")
    assert sorted((r["page"], r["text"]) for r in results.marked_pages(pages, found).collect()) == [(1, "[A9] ⟦A1⟧5 zł [tag]"), (2, None)]


def test_names_are_compared_with_a_list_made_once(spark):
    plan = spark.range(1).select(names.distinct_organisations(F.array(F.lit("Lis"), F.lit("Lis S.A."))).alias("x"))._jdf.queryExecution().analyzed().toString()
    # names were collapsed again for each name that they were compared with
    assert plan.count("array(Lis, Lis S.A.)") == 1
