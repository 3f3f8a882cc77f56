"""The core queries against their SQL on the smallest tables, and awkward rows of the newer operators."""

import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from docquarry.operators import contexts, requests, selection, validation
from docquarry.plans import edges, exchange, registry, reviews

SF = "/root/testdata/sf0.001"
NAMES = ["candidates_orders", "contexts_invoices", "result_rules_orders", "attested_people_customer", "full_names_supplier", "assembled_orders", "file_gates_pages", "client_gates_documents", "settings_part", "error_status_events", "usage_events", "payloads_orders", "narrative_marks_orders", "layouts_conversations", *reviews.queries(), *exchange.queries(), *edges.queries()]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    expected = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in expected.fetchall())


def context_of(spark, text):
    pages = spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 1, ""), (2, 2, "5,00")], "doc_id long, page int, text string")
    return [r["context"] for r in contexts.candidate_contexts(pages).orderBy("candidate_id").collect()]


def test_contexts(spark):
    assert context_of(spark, "nothing here") == []
    assert context_of(spark, "| 5,00 EUR | x") == ["s. 1: | »5,00 EUR« | x"]
    assert context_of(spark, "Wcześniej. Pan J. Lis odda PLN 15 do jutra. Potem nic.") == ["s. 1: Pan J. Lis odda »PLN 15« do jutra."]
    long = "słowo " * 60
    (found,) = context_of(spark, long + "15,00 EUR " + long)
    assert found.startswith("s. 1: … słowo") and found.endswith("słowo …") and "»15,00 EUR«" in found and len(found) <= 500


def test_attested_and_full_names(spark):
    names = spark.createDataFrame([(1, 0, "Ewa Lis"), (1, 1, "ewa  lis"), (1, 2, "Lis"), (1, 3, " "), (2, 0, "Ewa Lis")], "doc_id long, pos int, name string")
    pages = spark.createDataFrame([(1, 1, "była EWA\nLIS-Nowak"), (1, 2, None), (3, 1, "Ewa Lis")], "doc_id long, page int, text string")
    found = {(r["doc_id"], r["pos"]): r["attested"] for r in selection.attested(names, pages).collect()}
    assert found == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): True, (2, 0): False}
    assert [(r["doc_id"], r["pos"]) for r in selection.full_organisations(names, pages).orderBy("doc_id", "pos").collect()] == [(1, 0), (1, 2), (1, 3), (2, 0)]


def test_rules_on_nothing(spark):
    empty = spark.createDataFrame([tuple([None] * 16)], validation.SCHEMA)
    (problems,) = empty.select(validation.result_problems()).first()
    assert "document.title" in problems and "analysis" not in problems and len(problems) == 12
    assert spark.range(1).select(requests.payload(F.lit(None).cast("string")).isNull()).first()[0]


def test_keyword_caps_keep_sharp_s(spark, tmp_path):
    """The SQL compares lower-case forms: ß and SS are two words."""
    spark.createDataFrame([(1, "SS ß ss Ä ä"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(registry.oracle_sql()["keyword_caps_documents"]).fetchall())
    assert sorted(tuple(r) for r in edges.keyword_caps(spark, str(tmp_path)).collect()) == expected == [(1, 3, "SS|ß|Ä", "SS|ß|Ä"), (2, 0, "", "")]
