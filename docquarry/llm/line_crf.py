"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Method. Every line with a word has a few numeric features, each cut into bins. A line's score is the sum of one
weight per bin of its own features, of its predecessor's and of its successor's; neighbouring labels add a
transition weight. Forward-backward gives each line's marginal probability of being good, and a document's score is
their mean weighted by line length. Lines inherit their document's label in training, which maximises the
conditional likelihood by gradient steps, every document weighing the same.

Only text goes into a score. The model is fitted on at most TRAIN_ROWS labelled rows outside the held-out fold
(smallest hashes of the id first); it has a few hundred weights and travels in the task's closure. Scoring is one
scan without an exchange.

Defined results. Null, empty and blank texts are one empty line, and are scored as such. Repeated rows give
repeated results. A null doc_id is in the fold that is not held out. Without labelled rows every score is 0.5. An
empty table gives an empty result. Other columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_bucket, table

FOLDS, HELD_OUT = 3, 1
TRAIN_ROWS = 6_000
STEPS, RATE, DECAY = 250, 0.1, 1e-4
#: Lines whose features are held together while scoring.
CHUNK = 50_000

_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>{}[]\\^~_=+@/", bytes(range(65, 91)), b"0123456789", b"!?;:\"'()-"
_TERMINAL = (b".", b"!", b"?", b":", b";")
#: Features of a line and the upper ends of their bins.
FEATURES: list[tuple[str, list[float]]] = [
    ("words", [0.5, 1.5, 3.5, 7.5, 15.5, 31.5, 63.5, 127.5]),
    ("symbols", [0.0005, 0.01, 0.03, 0.08, 0.15, 0.3]),
    ("upper", [0.0005, 0.02, 0.05, 0.1, 0.3, 0.6]),
    ("digits", [0.0005, 0.01, 0.05, 0.15, 0.4]),
    ("marks", [0.0005, 0.01, 0.03, 0.08, 0.15]),
    ("commas_points", [0.0005, 0.01, 0.02, 0.04, 0.08]),
    ("distinct", [0.2, 0.4, 0.6, 0.75, 0.85, 0.95, 0.9999]),
    ("adjacent", [0.0005, 0.02, 0.1, 0.3, 0.6]),
    ("word_length", [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0, 12.0, 20.0]),
    ("ends", [0.5]),
    ("seen_before", [0.5]),
    ("lone_symbols", [0.0005, 0.05, 0.2, 0.4]),
]
_WIDTHS = [len(edges) + 1 for _, edges in FEATURES]
_OFFSETS = np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])
N_BINS = int(sum(_WIDTHS))


def line_values(text: bytes | None) -> tuple[list[tuple], list[int]]:
    """The features and the lengths in bytes of the lines of a text."""
    rows, lengths, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = sum(map(len, words))
        rows.append(
            (
                k,
                (n - len(line.translate(None, _SYMBOLS))) / n,
                (n - len(line.translate(None, _UPPER))) / n,
                (n - len(line.translate(None, _DIGITS))) / n,
                (n - len(line.translate(None, _MARKS))) / n,
                (line.count(b",") + line.count(b".")) / n,
                len(set(words)) / k,
                sum(map(eq, words, words[1:])) / k,
                letters / k,
                line.rstrip().endswith(_TERMINAL),
                line in seen,
                words.count(b"|") / k,
            )
        )
        lengths.append(n)
        seen.add(line)
    return (rows, lengths) if rows else ([(0,) * len(FEATURES)], [1])


def bins_of(rows: list[tuple]) -> np.ndarray:
    """Bin numbers, lines by features; each feature has numbers of its own."""
    values = np.array(rows, np.float64).reshape(-1, len(FEATURES))
    return np.stack([np.searchsorted(edges, values[:, k]) + _OFFSETS[k] for k, (_, edges) in enumerate(FEATURES)], axis=1)


class Chain:
    """Weights (here, of the line before, of the line after) by bin, and transitions between bad (0) and good (1)."""

    def __init__(self) -> None:
        self.bins, self.moves = np.zeros((3, N_BINS)), np.zeros((2, 2))

    def odds(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Score of good against bad for every line of concatenated documents."""
        own, before, after = (self.bins[k][bins].sum(axis=1) for k in range(3))
        out = own.copy()
        out[1:] += np.where(first[1:], 0.0, before[:-1])
        out[:-1] += np.where(last[:-1], 0.0, after[1:])
        return out

    def marginals(self, odds: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for every line, and each document's expected transitions (documents, 2, 2).

        Documents go along together, longest first, so that step t works on those that have a line t.
        """
        order = np.argsort(-counts, kind="stable")
        at, n = starts[order], counts[order]
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), side="left")  # documents with more than t lines
        forward, backward = np.zeros((len(odds), 2)), np.zeros((len(odds), 2))
        move = np.exp(self.moves - self.moves.max())
        with np.errstate(over="ignore"):
            node = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=1) + 1e-12
        for t in range(longest):
            i = at[: live[t]] + t
            a = node[i] if t == 0 else (forward[i - 1] @ move) * node[i]
            forward[i] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((len(n), 2, 2))
        for t in range(longest - 1, -1, -1):
            i = at[: live[t]] + t
            more = live[t + 1] if t + 1 < longest else 0
            b = np.ones((len(i), 2))
            if more:
                follow = node[i[:more] + 1] * backward[i[:more] + 1]
                b[:more] = follow @ move.T
                both = forward[i[:more]][:, :, None] * move[None] * follow[:, None, :]
                pairs[:more] += both / both.sum(axis=(1, 2), keepdims=True)
            backward[i] = b / b.sum(axis=1, keepdims=True)
        good = forward * backward
        back = np.empty_like(pairs)
        back[order] = pairs
        return good[:, 1] / good.sum(axis=1), back

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Chain:
        """Adam on the negative conditional log-likelihood; documents: bins of their lines."""
        if not documents:
            return self
        counts = np.array([len(d) for d in documents])
        starts = np.cumsum(counts) - counts
        bins = np.concatenate(documents)
        first, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
        first[starts], last[starts + counts - 1] = True, True
        y, weight = np.repeat(labels, counts), np.repeat(1 / counts, counts) / len(counts)
        params = [self.bins, self.moves]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            p, pairs = self.marginals(self.odds(bins, first, last), starts, counts)
            error = (p - y) * weight
            before = np.where(last[:-1], 0.0, error[1:])
            after = np.where(first[1:], 0.0, error[:-1])
            grads = [np.zeros_like(q) for q in params]
            for k in range(len(FEATURES)):
                grads[0][0] += np.bincount(bins[:, k], error, N_BINS)
                grads[0][1] += np.bincount(bins[:-1, k], before, N_BINS)
                grads[0][2] += np.bincount(bins[1:, k], after, N_BINS)
            share = 1 / counts / len(counts)
            grads[1] += (pairs * share[:, None, None]).sum(axis=0)
            for k in (0, 1):
                grads[1][k, k] -= ((counts - 1) * share)[labels == k].sum()
            for q, g, m, s in zip(params, grads, mean, square):
                g += DECAY * q
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Length-weighted mean of the good marginals of each text."""
        out, rows, lengths, counts = [], [], [], []

        def flush() -> None:
            if not counts:
                return
            n = np.array(counts)
            starts = np.cumsum(n) - n
            first, last = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            first[starts], last[starts + n - 1] = True, True
            p, _ = self.marginals(self.odds(bins_of(rows), first, last), starts, n)
            w = np.array(lengths, float)
            out.append(np.add.reduceat(p * w, starts) / np.add.reduceat(w, starts))
            rows.clear(), lengths.clear(), counts.clear()

        for text in texts:
            r, size = line_values(text)
            rows += r
            lengths += size
            counts.append(len(r))
            if len(rows) >= CHUNK:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Chain:
    """A chain fitted on at most `rows` labelled rows whose fold is not held out."""
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)").filter(id_bucket(F.col("_id"), FOLDS) != HELD_OUT)
    picked = usable.distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bins_of(line_values(t.as_py())[0]).astype(np.uint8).tobytes() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "bins"])

    # at most `rows` rows are broadcast, so the texts stay where they are
    joined = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("long"), "_label", "_text")
    # of rows that repeat an id the smallest text teaches, so at most `rows` come back
    one = joined.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    found = sorted((r["id"], r["label"], bytes(r["bins"])) for r in one.mapInArrow(features, "id long, label int, bins binary").collect())
    return Chain().fit([np.frombuffer(b, np.uint8).reshape(-1, len(FEATURES)).astype(np.int64) for _, _, b in found], np.array([y for _, y, _ in found], int))


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chain.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least 0.5."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = chain.score([t.as_py() for t in batch.column(1).cast(pa.binary())]) >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good))], names=["row"])

    kept = rows.mapInArrow(run, StructType([rows.schema["row"]]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
