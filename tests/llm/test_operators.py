"""The operators against brute force, on a fixture of awkward rows."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, word string"


def fixture_rows():
    rng = random.Random(7)
    words = "time data river stone light house paper green under above table mit license apache cc by the of and".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(60)
    base = prose(400)
    texts = [None, "", "   \n\t", "one", "two words", "a" * 300, "a" * 300, "ab" * 200, prose(20000), base, base, base + " tail", "head " + base]
    texts += [prose(30) + " " + shared + " " + prose(rng.randrange(5, 80)) for _ in range(12)]
    texts += ["zażółć gęślą jaźń 🙂 " * 20, "x" + "zażółć gęślą jaźń 🙂 " * 20, "line one is here.\nline one is here.\n# | | |\n" * 9, "<|endoftext|> gnu general public license"]
    rows = [(i, t, "en", ["web", "books", None, "news"][i % 4], None, "r", "n", "w") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, base, None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_repeats(rows):
    w, first = 50, {}
    order = lambda i: 1 << 63 if i is None else i
    data = [(order(r[0]), (r[1] or "").encode()) for r in rows]
    for i, t in data:
        for k in range(len(t) - w + 1):
            s = t[k : k + w]
            first[s] = min(first.get(s, 1 << 64), i)
    out = []
    for (i, t), r in zip(data, rows):
        gone = bytearray(len(t))
        for k in range(len(t) - w + 1):
            if first[t[k : k + w]] < i:
                gone[k : k + w] = b"\1" * w
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(r[0]), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("varied", [256, 1, 3])
def test_suffix_dedup(spark, docs, empty, varied, monkeypatch):
    from docquarry.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "VARIED", varied)
    found = [(str(r["row"]["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(found) == brute_repeats(fixture_rows())
    assert suffix_dedup.remove_repeats(empty).count() == 0
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_suffix_dedup_on_columns_with_odd_names(spark):
    from docquarry.llm import suffix_dedup

    t = " ".join(f"word{k}" for k in range(30))
    rows = [(1, t, "a", "x"), (2, "head " + t, "b", "y"), (None, t + " tail", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _left string")
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect() if r["doc_id"]) == [(1, t, "a", "x"), (2, "head ", "b", "y")]


def test_two_segments_with_one_print_are_seen(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from docquarry.llm import suffix_dedup as s

    # two segments of one deal, whose prints are made equal
    monkeypatch.setattr(s, "_mix", lambda h: h & np.uint64(0))
    segs = [b"\3" + b"a" * 25 + b"b" * 30, b"\3" + b"a" * 25 + b"c" * 30]
    rows = pa.RecordBatch.from_pydict({"deal": [5, 5], "seg": pa.array(segs, pa.binary()), "least": [1, 2], "most": [4, 4]})
    (out,) = s._solve(s._BASES[0])(iter([rows]))
    assert s._CLASH in np.asarray(out.column("from"))


def test_suffix_sort_finds_every_run():
    import numpy as np

    from docquarry.llm import suffix_dedup as s

    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[100:300]
    at = np.arange(len(data) - s.WIDTH)
    order = s.suffix_sort(data, s.PrefixHashes(data), at)
    strings = [data[p : p + s.WIDTH].tobytes() for p in order]
    assert strings == sorted(strings) and sorted(order.tolist()) == at.tolist()


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    from docquarry.llm import simhash

    rows = fixture_rows()
    prints = [brute_print(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for r, c in zip(rows, label):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    expected = sorted((str(r[0]), p, str(least.get(c))) for r, p, c in zip(rows, prints, label))
    found = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert found == expected
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_of_each(docs).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    from docquarry.llm import simhash

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = prose(400), prose(50), prose(60)
    rows = [(9, a), (4, a), (4, a), (None, a), (None, a + " tail"), (4, b), (7, b), (None, c), (None, c), (2, ""), (None, None), (3, " ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _kept string")
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("4", a), ("4", b), ("None", c), ("2", "")])


def test_token_counts(docs, empty):
    from docquarry.llm import token_counts

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation(), tok.no_padding()
    expected = sorted((str(r[0]), len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in fixture_rows())
    path = public_tokenizers.path("word_bpe_49k.json")
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect()) == expected
    assert token_counts.count_tokens(empty, path).count() == 0


def test_bpe(docs, empty):
    from docquarry.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    expected = []
    for r in fixture_rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((str(r[0]), ids, tok.decode(ids, skip_special_tokens=False)))
    found = [(str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in bpe.encode(docs, path).collect()]
    assert sorted(found) == sorted(expected)
    assert bpe.encode(empty, path).count() == 0


def test_mixing(docs, empty):
    from docquarry.llm import mixing

    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in out)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * total) < 1e-6 * total or all(rs[0]["target"] == 2 * rs[0]["source_size"] for rs in by.values())
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_classifier_on_held_out_rows(spark):
    from docquarry.llm import line_crf

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in line_crf.op4_line_crf(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.85 * len(rows)


def test_classifier_on_awkward_rows(spark, docs, empty):
    from docquarry.llm import line_crf

    labels = spark.createDataFrame([(9, 1), (27, 0), (None, 1), (3, None)], "doc_id long, quality int")
    chain = line_crf.train(docs, labels)
    scores = [r["score"] for r in line_crf.score(docs, chain).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert line_crf.score(empty, chain).count() == 0
    assert line_crf.keep_good(docs, line_crf.Chain()).columns == docs.columns


def test_rules_and_licenses_survive_awkward_rows(docs, empty):
    from docquarry.llm import licenses, quality_rules

    assert quality_rules.apply_quality_rules(docs).count() == docs.count() and quality_rules.apply_quality_rules(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(empty).count() == 0


def test_any_list_of_frequent_words_gives_the_same_results(spark):
    """The list only says which pre-tokens are looked up before the library's model is asked."""
    import public_tokenizers

    from docquarry.llm import bpe, token_counts

    docs = spark.createDataFrame([(1, "The the theory, of naïve things"), (2, None), (3, "Zażółć 12 gęślą jaźń " * 5)], "doc_id long, text string")
    counts = [sorted(token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), table_size=k).collect()) for k in (1, 50_000)]
    digests = [sorted(bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), size=k).collect()) for k in (1, 50_000)]
    assert counts[0] == counts[1] and digests[0] == digests[1]
