import numpy as np


def brute(rows, every=20, top=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [k for k in np.lexsort((ids, -s)) if k != i][:top]
        out[int(ids[i])] = [int(ids[k]) for k in order]
    return out


def test_recall_and_order(spark):
    from docquarry.llm import nn_descent

    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected, found = brute(rows), {}
    by = dict(rows)
    for r in nn_descent.op2_nn_descent(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(np.dot(np.array(by[r["query_id"]], float), np.array(by[r["vec_id"]], float)))) < 1e-9
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9


def test_awkward_rows(spark):
    from docquarry.llm import nn_descent

    schema = "vec_id long, embedding array<float>, node string, v string, x string"
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist(), "a", "b", "c") for k in range(1, 60)] + [(k, [1.0, 2.0, 3.0, 4.0], None, None, None) for k in range(60, 120)]
    bad = [(None, [1.0] * 4), (200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan")] * 4), (280, [float("inf")] * 4), (300, [1.0, 2.0])]
    docs = spark.createDataFrame(rows + [(i, e, None, None, None) for i, e in bad] + rows[:2], schema)
    found = {}
    for r in nn_descent.nearest(docs).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    # two rows repeat an id with its vector: each is a candidate, the query's own row alone is not
    good = [(i, np.array(e, np.float32).tolist()) for i, e, *_ in rows + rows[:2]]
    expected = brute(good)
    assert found.keys() == expected.keys()
    assert np.mean([len(set(found[q]) & set(expected[q])) / 20 for q in expected]) >= 0.9
    assert found[60] == expected[60]
    assert nn_descent.nearest(spark.createDataFrame([], schema)).count() == 0


def recall_of(spark, rows):
    from docquarry.llm import nn_descent

    found = {}
    for r in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    expected = brute(rows)
    assert found.keys() == expected.keys() and all(len(v) == 20 for v in found.values())
    return np.mean([len(set(found[q]) & set(expected[q])) / 20 for q in expected])


def test_tight_groups_and_one_long_vector(spark):
    """Groups of 13 near-equal vectors, which link among themselves only, and one vector ten thousand times as long as the others."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 12))
    rows = [(k, (centres[k % 60] + 1e-3 * rng.normal(size=12)).tolist()) for k in range(780)]
    assert recall_of(spark, rows) >= 0.9
    assert recall_of(spark, [*rows, (781, (1e4 * centres[0]).tolist())]) >= 0.9


def test_rows_without_structure(spark):
    """Nothing leads from one vector to the next, and lengths differ: the search must widen until it finds enough."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 48)) * np.exp(rng.normal(size=(1500, 1)))
    assert recall_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]) >= 0.9


def test_several_shards_and_few_jobs(spark, monkeypatch):
    """Shards of 60 nodes, an own one for each query's search; rounds of the descent and of the searches are no Spark jobs of their own."""
    from docquarry.llm import nn_descent

    monkeypatch.setattr(nn_descent, "LEAST", 60, raising=False)
    x = np.random.default_rng(12).normal(size=(700, 24))
    context = spark.sparkContext
    context.setJobGroup("nearest", "nearest")
    try:
        assert recall_of(spark, [(k, v.tolist()) for k, v in enumerate(x)]) >= 0.9
        assert len(context.statusTracker().getJobIdsForGroup("nearest")) < 80
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_pools_as_large_as_a_shard_find_all():
    from docquarry.llm import nn_descent

    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 6))
    lists = nn_descent._followed(nn_descent._descended(x / np.linalg.norm(x, axis=1).max(), rng), len(x), rng)
    near = np.full((len(x), max(map(len, lists))), -1)
    for k, r in enumerate(lists):
        near[k, : len(r)] = r
    at, c, s = nn_descent._explored(x[:5], x, near, np.array([7]), np.array([0, 1, -1, 3, 4]), len(x))
    for q in range(5):
        assert sorted(c[at == q]) == list(range(90)) and np.allclose(s[at == q], -np.sort(-(x @ x[q])))
    only = nn_descent._descended(x[:1], rng)
    assert len(only) == 0 and [len(r) for r in nn_descent._followed(only, 1, rng)] == [0]
