import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import docs, empty, fixture_rows  # noqa: F401

from docquarry.llm import mixing_lm as m
from docquarry.llm.suffix_dedup import _BASES

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]


def test_unigram_scores_and_model(docs, empty):  # noqa: F811
    rows = fixture_rows()
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 4)) for r in rows)
    found = m.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["score"] <= 0 for r in found)
    assert m.score(empty).count() == 0


def test_rare_words_meet_their_counts(docs, monkeypatch):  # noqa: F811
    whole = {(str(r["doc_id"]), r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in m.score(docs).collect()}
    monkeypatch.setattr(m, "FREQUENT", 2)
    assert {(str(r["doc_id"]), r["n_tokens"]): (r["n_known"], round(r["base_score"], 6)) for r in m.score(docs).collect()} == whole


def test_model_beats_word_counts_on_held_out_rows(spark):
    rows = [r for r in m.op6_lm_mixing(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def mix64(h):
    h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M64
    return h ^ h >> 31


def poly(b):
    return sum((x + 1) * pow(_BASES[0], k, 1 << 64) for k, x in enumerate(b)) & M64


def brute_bits(model, raw):
    """Bit by bit, in plain numbers; of a text of one piece."""
    text = m.token_text(raw)
    centre = [1 / (1 + math.exp(-(-m.WIDEST + k * 2 * m.WIDEST / (m.BUCKETS - 1)))) for k in range(m.BUCKETS)]
    refined = [(model.state.ones[k] + m.HOLD * centre[k]) / (model.state.seen[k] + m.HOLD) for k in range(m.BUCKETS)]
    weights, waiting, total, count = model.state.weights.astype(float).copy(), [], 0.0, 0
    starts, sizes = m.slot_starts(model.bits), m.slot_bits(model.bits)
    for i, byte in enumerate(text):
        words = [*text[:i].replace(b"\n", b" ").split(b" ")]
        prefix, before, second = words[-1], words[-2] + b" " if len(words) > 1 else None, words[-3] + b" " if len(words) > 2 else None
        contexts = []
        for k in (2, 4, 6):
            h = 0
            for j in range(1, k + 1):
                h = (h * 257 + (text[i - j] + 1 if i >= j else 0)) & M64
            contexts.append(h)
        m0, m1, m2 = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
        contexts.append((poly(prefix) + (poly(before) * m0 if before else 0) + (poly(second) * m1 if second else 0)) & M64)
        contexts = [mix64((x + (k + 1) * m2) & M64) >> 32 for k, x in enumerate(contexts)]
        pair = (text[i - 1] if i else 10) << 8 | byte
        for s in range(model.code.start[pair], model.code.start[pair + 1]):
            x = []
            for k, c in enumerate(contexts):
                h = (c + int(model.code.node[s]) * 0x9E3779B1) * 0x85EBCA6B & M32
                h = (h ^ h >> 15) * 0xC2B2AE35 & M32
                x.append(model.odds[starts[k] + (h >> 32 - sizes[k])] * m.UNIT)
            gate = 2 if x[3] else 1 if x[2] else 0
            z = min(max(sum(w * v for w, v in zip(weights[gate], x)), -m.WIDEST), m.WIDEST)
            p, bit = 1 / (1 + math.exp(-z)), int(model.code.bit[s])
            final = (p + refined[round((z + m.WIDEST) * (m.BUCKETS - 1) / (2 * m.WIDEST))]) / 2
            total -= math.log2(final if bit else 1 - final)
            waiting.append((gate, bit - p, x))
            count += 1
            if count % m.STEP == 0:
                for g, miss, v in waiting:
                    weights[g] += m.RATE * miss * np.array(v)
                waiting = []
    return total


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    odds = rng.integers(-60, 60, m.slot_starts(13)[-1]).astype(np.int8) * (rng.random(m.slot_starts(13)[-1]) < 0.6)
    seen = rng.integers(0, 900, m.BUCKETS).astype(float)
    return m.Model(m.Code.of(rng.integers(0, 50, (256, 256))), 13, odds.astype(np.int8), m.State(rng.normal(0.3, 0.1, (m.GATES, m.PREDICTORS)).astype(np.float32), np.floor(seen / 3), seen))


def test_cost_against_brute_force(model):
    for raw in [b"", b"One  text", "zażółć gęślą jaźń ".encode() * 30, b"the quick brown fox " * 40 + b"ends", bytes(range(256)) * 2]:
        assert abs(model.cost([raw])[0] - brute_bits(model, raw)) < 1e-3 * (1 + brute_bits(model, raw))


def test_bits_of_a_text_do_not_depend_on_its_batch(model):
    texts = [b"", b"one text", b"x" * 30000, b"another", b"word " * 9000, b"last one here"]
    assert np.allclose(model.cost(texts), [model.cost([t])[0] for t in texts], rtol=1e-5)


def test_every_training_row_is_counted(spark):
    texts = [f"text number {k} of many" for k in range(3000)] + ["copies of one text"] * 700 + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("CAST(coalesce(t, '') AS BINARY) AS raw").repartition(7)
    counts = {bytes(r["token"]): r["c"] for r in m.word_counts(rows).collect()}
    assert counts == Counter(w.encode() for t in texts for w in tokens(t))
    pairs = Counter()
    for word, c in counts.items():
        for a, b in zip(b" " + word, word + b" "):
            pairs[a, b] += c
    found = m.pair_counts(spark.createDataFrame([*counts.items()], "token binary, c long"))
    assert {(int(a), int(b)): int(found[a, b]) for a, b in zip(*np.nonzero(found))} == dict(pairs)
    code = m.Code.of(found)
    model = m.train(rows, code, 1 << 20)
    # the first bit of all texts, after nothing at all, in the slot of the six bytes before
    first = Counter()
    for t in texts:
        start = code.start[10 << 8 | m.token_text((t or "").encode())[0]]
        first[int(code.node[start]), int(code.bit[start])] += 1
    (node,) = {n for n, _ in first}
    block = [(0, m.token_text(b"text"), 0)]
    slot = m.flattened(block, code, model.bits)[1][2][0]
    expected = np.clip(math.log((first[node, 1] + m.PRIOR) / (first[node, 0] + m.PRIOR)) / m.UNIT, -m.BOUND, m.BOUND)
    assert abs(model.odds[slot] - expected) <= 1
    assert model.state.seen.sum() == sum(len(m.flattened([(0, m.token_text((t or "").encode()), 0)], code, model.bits)[0]) for t in texts)


def test_scores_do_not_depend_on_how_rows_lie(spark, monkeypatch):
    """One partition or eight, in any order, with other columns or without, through one learner or several: equal rows, equal scores."""
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "żółć"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 60)))), "x" * 900) for k in range(200)] + [(k, "one passage that many rows copy", "y") for k in range(200, 260)] + [(None, None, None)]
    shape = "doc_id long, text string, more string"
    scores = lambda frame: sorted((str(r["doc_id"]), r["score"]) for r in m.score(frame).collect())
    for size in (m.LEARNER_BYTES, 4_000):
        monkeypatch.setattr(m, "LEARNER_BYTES", size)
        one = scores(spark.createDataFrame(rows, shape).coalesce(1))
        assert scores(spark.createDataFrame(rows[::-1], shape).repartition(8)) == one
        assert scores(spark.createDataFrame(rows, shape).select("doc_id", "text").repartition(3)) == one


def test_a_learner_counts_copies():
    """A text with copies is counted as that many texts are, and one step of the mixer is Newton's for the block."""
    code = m.Code.of(np.ones((256, 256), np.int64))
    once, often = m.Learner(code, 13), m.Learner(code, 13)
    texts = [b"some text here", b"another one"]
    once.learn(texts)
    often.learn(texts, [1, 5])
    alone = m.Learner(code, 13)
    alone.learn(texts[1:])
    assert (often.counts == once.counts + 4 * alone.counts).all() and often.state.seen.sum() == once.state.seen.sum() + 4 * alone.state.seen.sum()
    rng = np.random.default_rng(3)
    own = m.Learner(code, 13)
    inputs, bit = rng.normal(0, 1, (m.PREDICTORS, 400)).astype(np.float32), rng.integers(0, 2, 400).astype(np.uint8)
    gate = m.gates_of(inputs)
    before = own.state.weights.copy()
    own.mix(bit, inputs)
    for g in np.unique(gate):
        x, y = inputs[:, gate == g].astype(float), bit[gate == g]
        p = 1 / (1 + np.exp(-np.clip(before[g] @ x, -m.WIDEST, m.WIDEST)))
        gradient, curve = sum((b - q) * c for b, q, c in zip(y, p, x.T)), sum(q * (1 - q) * np.outer(c, c) for q, c in zip(p, x.T))
        assert np.allclose(own.state.weights[g], np.clip(before[g] + np.linalg.solve(curve + np.eye(m.PREDICTORS), gradient), -4, 4), atol=1e-3)
