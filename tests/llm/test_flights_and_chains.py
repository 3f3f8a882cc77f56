"""The cube method and the line classifier against brute force."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import line_crf, mixing


def targets_by_hand(sizes):
    """sizes: by source, in code-point order, null last."""
    total, weights = sum(sizes), [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    stopped = set()
    while True:
        left = 1.5 * total - sum(2 * sizes[i] for i in stopped)
        free = [i for i in range(len(sizes)) if i not in stopped]
        level = left / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if weights[i] * level > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in stopped else weights[i] * level for i in range(len(sizes))]
        stopped |= over


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "w " * int(rng.integers(1, 400)), str(rng.choice(["a", "b", "é", "B"], p=[0.6, 0.2, 0.1, 0.1]))) for k in range(1500)]
    rows += [(9000 + k, "w " * int(rng.integers(1, 50)), None) for k in range(40)] + [(7, "same words", "a")] * 20 + [(None, "no id at all", "b"), (9999, None, "c"), (9998, "", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block", [mixing.BLOCK, 64])
def test_mix_against_targets(docs, monkeypatch, block):
    """Targets by hand; words taken within a thousandth of them; nobody is taken more than twice; the order of rows and blocks make no difference."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = mixing.mix(docs).collect()
    sources = sorted({r["source"] for r in rows} - {None}) + [None]
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in sources]
    for s, size, target in zip(sources, sizes, targets_by_hand(sizes)):
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 * (1 + target) for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(1.0, 0.001 * target)
        rate = target / size if size else 0
        assert all(r["times"] in (int(rate), int(rate) + 1) or not r["size"] for r in own) and all(r["times"] == 0 for r in own if not r["size"])
    again = mixing.mix(docs.orderBy(F.desc("doc_id")).repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_flight_keeps_both_totals_and_the_probabilities():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 60, 40).astype(float), rng.uniform(0.05, 0.95, 40)
    total = np.zeros(40)
    for _ in range(3000):
        q = mixing.flight(p, size, rng.random(40))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-5
        total += q
    assert np.abs(total / 3000 - p).max() < 0.05


def test_landing_against_all_choices():
    """No single exchange of a taken for a free document would come nearer."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(2, 14))
        size, p = rng.integers(1, 30, n).astype(float), np.where(np.arange(n) < 2, 0.5, rng.integers(0, 2, n)).astype(float)
        target = float(rng.integers(0, int(size.sum()) + 1))
        out = mixing.landing(p, size, rng.random(n), target - size[p == 1.0].sum())
        gap = target - size[out == 1].sum()
        assert set(out) <= {0.0, 1.0}
        swaps = [abs(gap - size[j] + size[i]) for i in np.flatnonzero(out == 1) for j in np.flatnonzero(out == 0)]
        assert min(swaps, default=abs(gap)) >= abs(gap) or gap == 0


def chain(rng):
    out = line_crf.Chain()
    out.bins, out.moves = rng.normal(0, 0.7, out.bins.shape), rng.normal(0, 0.7, (2, 2))
    return out


def by_enumeration(own, odds):
    """Marginals of good, expected transitions and the log of the sum, over all labellings of a chain."""
    n = len(odds)
    weights = {y: np.exp(sum(o * v for o, v in zip(odds, y)) + sum(own.moves[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=n)}
    z = sum(weights.values())
    good = [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
    pairs = np.zeros((2, 2))
    for y, w in weights.items():
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w / z
    return np.array(good), pairs, np.log(z)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    own = chain(rng)
    counts = np.array([3, 1, 6, 2, 5])
    odds, starts = rng.normal(0, 1.5, counts.sum()), np.cumsum(counts) - counts
    good, pairs = own.marginals(odds, starts, counts)
    for k, (s, n) in enumerate(zip(starts, counts)):
        expected, moved, _ = by_enumeration(own, odds[s : s + n])
        assert np.allclose(good[s : s + n], expected, atol=1e-6) and np.allclose(pairs[k], moved, atol=1e-6)


def test_one_step_follows_the_gradient(monkeypatch):
    """Adam's first step goes against the sign of the log-likelihood's differences, weight by weight."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(line_crf, "DECAY", 0.0)
    documents = [np.stack([line_crf._OFFSETS[k] + rng.integers(0, 3, n) for k in range(len(line_crf.FEATURES))], 1) for n in (3, 1, 4)]
    labels, start = np.array([1, 0, 1]), chain(rng)

    def loss(own):
        total = 0.0
        for bins, y in zip(documents, labels):
            n = len(bins)
            first, last = np.arange(n) == 0, np.arange(n) == n - 1
            odds = own.odds(bins, first, last)
            _, _, z = by_enumeration(own, odds)
            total -= (y * odds.sum() + (n - 1) * own.moves[y, y] - z) / n / len(documents)
        return total

    moved = line_crf.Chain()
    moved.bins, moved.moves = start.bins.copy(), start.moves.copy()
    moved.fit(documents, labels, steps=1)
    used = {(k, int(b)) for k in range(3) for d in documents for b in d.ravel()}
    for name, at in [("bins", i) for i in sorted(used)[::7]] + [("moves", (a, b)) for a in (0, 1) for b in (0, 1)]:
        up, down = line_crf.Chain(), line_crf.Chain()
        for own, step in ((up, 1e-5), (down, -1e-5)):
            own.bins, own.moves = start.bins.copy(), start.moves.copy()
            getattr(own, name)[at] += step
        slope = (loss(up) - loss(down)) / 2e-5
        step = getattr(moved, name)[at] - getattr(start, name)[at]
        assert abs(slope) < 1e-6 or np.sign(step) == -np.sign(slope)


def test_score_is_the_length_weighted_mean():
    own = chain(np.random.default_rng(4))
    texts = [b"one line", b"first line here\n\nthird one, longer than the others\nx", None, b"", "zażółć\n".encode() * 3]
    for text, score in zip(texts, own.score(texts)):
        rows, lengths = line_crf.line_values(text)
        bins, n = line_crf.bins_of(rows), len(rows)
        good, _, _ = by_enumeration(own, own.odds(bins, np.arange(n) == 0, np.arange(n) == n - 1))
        assert abs(score - np.average(good, weights=lengths)) < 1e-6
