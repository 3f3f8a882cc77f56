"""The stages on a small table: each keeps the columns, and what one decides the next one sees."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.ORACLE_SQL is None
    columns, n = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.common.materialize(stage(spark, docs, sf), name)
        n.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert n[0] > n[1] > n[2] == n[3] and n[4] == n[5] > 0
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_the_mix_takes_each_row_as_decided(spark):
    from collections import Counter

    from docquarry.llm import mixing

    rows = [(None if k % 3 == 0 else k // 4, " ".join(["word"] * (1 + k % 17)), "abc"[k % 3 if k % 5 else 1]) for k in range(600)] + [(None, "", "a"), (7, None, "b"), (None, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided, goal = Counter(), {}
    for r in mixing.mix(docs).collect():
        decided[r["doc_id"], r["source"], r["size"]] += r["times"]
        goal[r["source"]] = r["target"]
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    found = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in taken.collect())
    assert found == +decided and any(i is None for i, _, _ in found)
    for source, target in goal.items():
        assert abs(sum(n * size for (_, s, size), n in found.items() if s == source) - target) <= 17
