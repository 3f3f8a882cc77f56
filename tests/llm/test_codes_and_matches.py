"""Vector codes, alignment of tokenizers and decontamination against brute force, on rows of every awkward kind."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import public_tokenizers
import pytest

from docquarry.llm import decontamination, token_alignment, vector_codes
from docquarry.llm.bpe import token_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def codes_by_hand(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label)."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and abs(x) < float("inf") for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[floor(Fraction(x) * 256) for x in r[1]] for r in kept]
    size = len(whole[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e))
    for _ in range(rounds):
        found = [[best(p, v[p]) for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p] == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [[best(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(distance(v[p], books[p][f[p]]) for p in range(parts)) for v, f in zip(cut, found)]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{x:02x}" for x in f), e, by_label[r[2]], sha)) for r, f, e in zip(kept, found, errors))


@pytest.mark.parametrize("huge", [False, True])
def test_vector_codes(spark, huge):
    rnd = random.Random(1)
    rows = [(i, [round(rnd.uniform(-2, 2), 2) for _ in range(12)], rnd.choice([None, 1, 2])) for i in range(150)]
    rows += [rows[3], rows[3], (3, [0.5] * 12, 1), (None, [0.25] * 12, None), (900, None, 1), (901, [], 1), (902, [float("nan")] * 12, 1), (903, [None] + [1.0] * 11, 2), (904, [float("-inf")] * 12, 2)]
    if huge:
        rows += [(905, [3e12] + [-1e9] * 11, 4)]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, `row` int, `a.b` string").repartition(3)
    found = vector_codes.compressed(frame, parts=4, entries=8, rounds=2)
    got = sorted(str((r.vec_id, r.code, r.error if r.error is not None else "over", r.label_error, r.codebooks_sha256)) for r in found.collect())
    expected = codes_by_hand(rows, 4, 8, 2)
    if not huge:
        assert got == expected
    else:  # an error over a long has no value; codes and codebooks are exact all the same
        strip = lambda xs: sorted(re.sub(r"', .*, '", "', '", x) for x in xs)
        assert strip(got) == strip(expected)
    assert vector_codes.compressed(frame.filter("false")).collect() == []


def test_partial_distances(spark):
    """The search gives the first of the nearest entries, with many ties."""
    import numpy as np

    rnd = np.random.default_rng(2)
    vectors, book = rnd.integers(-3, 4, (400, 3)), rnd.integers(-3, 4, (20, 3))
    full = ((vectors[:, None] - book[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        found, distance = vector_codes.nearest(vectors.astype(kind), book.astype(kind))
        assert found.tolist() == full.argmin(1).tolist() and distance.tolist() == full.min(1).tolist()


def alignment_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spelled_a = token_bytes(a)
    spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    seen = []
    for doc, text in rows:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and not (b"".join(spelled_a[i] for i in x) == f" {text}".encode() == b"".join(spelled_b[i] for i in y)):
            x = y = []
        places = []
        for ids, spelled in ((x, spelled_a), (y, spelled_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spelled[i]), i))
                at += len(spelled[i])
            places.append(out)
        owners = defaultdict(list)
        for low, high, i in places[1]:
            for byte in range(low, high):
                owners[byte] = (low, i)
        links = [(i, j) for low, high, i in places[0] for _, j in dict.fromkeys(owners[byte] for byte in range(low, high))]
        groups, at = [], 0
        for cut in sorted({h for _, h, _ in places[0]} & {h for _, h, _ in places[1]}):
            groups.append("|".join(",".join(str(i) for _, h, i in side if at < h <= cut) for side in places))
            at = cut
        text = ";".join(groups)
        seen.append((doc, len(x), len(y), len(groups), links, text, hashlib.sha256(text.encode()).hexdigest() if x else ""))
    count = Counter(k for s in seen for k in set(s[4]))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return sorted(str((d, na, nb, ng, len(k), sum(count[x] == top[x[0]] for x in k), sum(count[x] for x in k), t, h)) for d, na, nb, ng, k, t, h in seen)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    bits = ["a", "Hello", " ", "  ", "\n", "\t", "\xa0", "é", "é", "日本", "😀", "'s", "'ll", "123", "<|endoftext|>", "<s>", "▁", "　", "the", "​", "﻿", "\x00", "—", " the"]
    rows = [(i % 300, None if i % 50 == 0 else "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 14)))) for i in range(700)]
    return [*rows, (None, "x the " * 900), (7, "the the"), (7, "the the"), (8, " "), (9, "")]


@pytest.mark.parametrize("options", [{}, {"most_mapped": 0}, {"kept_chunks": 20}])
def test_alignment(spark, texts, options):
    frame = spark.createDataFrame([(*t, 1, "y") for t in texts], "doc_id long, text string, keys int, `a.b` string").repartition(4)
    found = token_alignment.align(frame, A, B, **options)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256"]
    assert sorted(str(tuple(r)) for r in found.select(columns).collect()) == alignment_by_hand(texts)
    assert token_alignment.align(frame.filter("false"), A, B).collect() == []


def test_pair_counts_in_small_runs(spark, texts):
    """Partial counts that are passed on again and again, and batches of one row, give the same counts."""
    rows = token_alignment.materialize(token_alignment.aligned(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), A, B), "aligned")
    whole = {r.key: r.n for r in token_alignment.pair_counts(rows).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = token_alignment.pair_counts(rows, most_counted=10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(whole) and {r.key: r.n for r in found} == whole


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def corpus():
    rnd, some = random.Random(5), ["aa", "bb", "cc", "dd", "É", "9"]
    docs = [(rnd.choice([None, 1, 2, 3, i]), None if i % 40 == 0 else " ".join(rnd.choice(some) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 40])))) for i in range(300)]
    docs += [(5, "aa bb " * 3000)]
    items = [(rnd.choice([None, i, i % 7]), None if i % 20 == 0 else "-".join(rnd.choice(some).upper() for _ in range(rnd.choice([0, 1, 3, 5, 6, 10, 13])))) for i in range(90)]
    return docs, items + [(i, docs[i][1]) for i in range(1, 30)]


@pytest.mark.parametrize(("segment_words", "block_words"), [(400_000, 10**6), (50, 10**6), (50, 60)])
def test_contamination(spark, corpus, segment_words, block_words):
    docs, items = corpus
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[at : at + n])].add(i)
    expected = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= {str(i) for i in windows[tuple(w[at : at + n])] if i is not None}
        expected.append(str((d, len(w), len(hit), sorted(found))))
    frame = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, segment int, `a.b` string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, `doc.id` int")
    index = decontamination.build_index(frame, segment_words=segment_words)
    got = [str((r.doc_id, r.n_words, sum(e - s for s, e in r.spans), r["items"])) for r in decontamination.contamination(index, asked, block_words=block_words).collect()]
    assert sorted(got) == sorted(expected)
    assert all(r.spans == [] for r in decontamination.contamination(index, asked.filter("false")).collect())
    assert decontamination.contamination(decontamination.build_index(frame.filter("false")), asked).collect() == []


def test_exact_and_near(spark, corpus):
    docs, items = [d for d in corpus[0] if len(d[1] or "") < 1000], list({i for i in corpus[1] if i[0] is not None and 0 < len(words(i[1])) < 6})
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), segment_words=60)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(str((d, str(i), at)) for d, t in docs for i, x in items for at in range(len(words(t))) if words(t)[at : at + len(words(x))] == words(x))
    assert sorted(str(tuple(r)) for r in decontamination.exact_matches(index, asked).collect()) == expected

    def shortest(w, wanted, most=5):
        spans = [(n, at) for n in range(1, most + 1) for at in range(len(w) - n + 1) if wanted <= set(w[at : at + n])]
        return min(spans, default=None)

    expected = sorted(str((d, str(i), s[1], s[0])) for d, t in docs for i, x in items if (s := shortest(words(t), set(words(x)))))
    assert sorted(str(tuple(r)) for r in decontamination.near_matches(index, asked, 5).collect()) == expected
