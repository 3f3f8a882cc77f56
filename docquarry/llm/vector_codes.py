"""Vector code compression: product codes, found by partial-distance search.

Method. Components become integers floor(256 x); a vector is cut into 16 equal parts, and each part position has a codebook of at
most 64 entries. A round assigns every part to its nearest entry and moves the entries. The search of a block of vectors runs
through a part's dimensions in descending variance of the codebook: distances add up dimension by dimension as integers, the most
promising entry of each vector is completed first, and a mask drops every entry whose distance so far strictly exceeds the best
complete distance. What is left at the end holds the nearest entry, and ties go to the lower index.

Scale. A round is one scan: a task sends one row for each part, entry and position (at most 64 x width rows, whatever it read), and
sums fold on the map side. The driver holds the codebooks alone: 64 x width integers. Codes are written once to the shared folder,
because the sums by label need them all; the table of labels meets the codes in a join that Spark broadcasts only below its own limit.

Defined results. Vectors that are null, empty, or hold null or non-finite components are dropped; so are vectors of another
width than the first kept one's, or of one that 16 does not divide. Rows of a repeated id all count; where ids are equal the smaller vector
is first, and null ids come last. Fewer than 64 vectors give so many entries. Components of any size are exact: where int64 could
overflow, Python's integers are used; an error or sum beyond a long is null. An empty table gives an empty result. Other columns are
ignored, whatever their names. Vectors of any width work, one block of rows at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched together: bounds a worker's memory.
BLOCK = 4_096
#: A search goes on over single pairs once fewer than one in so many are left.
SPARSE = 24
_LONG = 2**63


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], and the width of the vectors that they are for."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, exactly: as int64 where every distance and sum of a block fits, else as Python's integers."""
    rows = rows.astype(np.float64)
    scaled = np.floor(rows * SCALE) if np.abs(rows).max(initial=0) < 2.0**900 else None
    if scaled is not None and np.abs(scaled).max(initial=0) < 2.0**24:
        return scaled.astype(np.int64)
    exact = [[(lambda n, d: n * SCALE // d)(*float(x).as_integer_ratio()) for x in row] for row in rows]
    out = np.empty(rows.shape, object)
    for i, row in enumerate(exact):
        out[i] = row
    return out


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's nearest entry, and its squared distance; one part position. Vectors and book hold integers."""
    n, width = vectors.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread = [(len(book) * sum(x * x for x in c) - sum(c) ** 2) for c in book.T.tolist()]
    order = sorted(range(width), key=lambda j: (-spread[j], j))
    if object not in (vectors.dtype, book.dtype) and width * (2 * int(max(abs(vectors).max(), abs(book).max()))) ** 2 < 2**31:
        vectors, book = vectors.astype(np.int32), book.astype(np.int32)
    rows, best = np.arange(n), None
    so_far = np.zeros((n, len(book)), np.result_type(vectors, book))
    alive = np.ones(so_far.shape, bool)
    for k, j in enumerate(order, 1):
        step = vectors[:, j, None] - book[None, :, j]
        np.add(so_far, step * step, out=so_far, where=alive)
        if k == width:
            # what was dropped stands above the best, so the first of the smallest is a complete one
            found = so_far.argmin(axis=1)
            return found, so_far[rows, found].astype(np.int64 if so_far.dtype != object else object)
        # the entry that is ahead is completed first; what lies above the best complete distance is dropped
        ahead = so_far.argmin(axis=1)
        full = so_far[rows, ahead]
        for later in order[k:]:
            full = full + (vectors[:, later] - book[ahead, later]) ** 2
        best = full if best is None else np.minimum(best, full)
        alive &= so_far <= best[:, None]
        if np.count_nonzero(alive) * SPARSE < alive.size:
            return _few_left(vectors, book, order[k:], so_far, alive, best)
    raise AssertionError("a part has at least one dimension")


def _few_left(vectors: np.ndarray, book: np.ndarray, order: list[int], dense: np.ndarray, alive: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rest of nearest() over the pairs that are left, sorted by vector, then entry."""
    rows = np.arange(len(vectors))
    row, entry = np.nonzero(alive)
    so_far = dense[row, entry]
    for j in order:
        so_far = so_far + (vectors[row, j] - book[entry, j]) ** 2
        keep = so_far <= best[row]
        row, entry, so_far = row[keep], entry[keep], so_far[keep]
    best = np.minimum.reduceat(so_far, np.searchsorted(row, rows))
    hit = np.flatnonzero(so_far == best[row])
    return entry[hit[np.searchsorted(row[hit], rows)]], best.astype(np.int64 if best.dtype != object else object)


def assign(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part of every vector, and its squared distance: two arrays of shape (vectors, parts)."""
    parts, _, size = books.entries.shape
    found = [nearest(vectors[:, p * size : (p + 1) * size], books.entries[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(at, BLOCK)
        lists = rows.column(rows.num_columns - 1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, integers(flat.reshape(rows.num_rows, -1))


def _long_sum(column: str) -> Column:
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(total.between(-_LONG, _LONG - 1), total).cast("long")


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, DataFrame]:
    """The codebooks, and the rows (all columns as one struct `row`, and `v`) that they are for; no codebooks without a row."""
    held = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row")).select("row", F.col(f"row.`{vector}`").cast("array<double>").alias("v"))
    held = held.filter(usable(F.col("v")))
    of = F.col(f"row.`{vec_id}`")
    smallest = lambda rows, n: rows.orderBy(of.asc_nulls_last(), "v").limit(n).select("v").collect()
    first = smallest(held, 1)
    if not first or len(first[0]["v"]) % parts:
        return None, held.filter("false")
    width = len(first[0]["v"])
    kept = held.filter(F.size("v") == width)
    start = integers(np.array([r["v"] for r in smallest(kept, entries)]))
    size = width // parts
    books = Codebooks(np.stack([start[:, p * size : (p + 1) * size] for p in range(parts)]))
    for _ in range(rounds):
        books = _moved(kept, books)
    return books, kept


def _digits(x: int) -> list[int]:
    """An integer in base 2**32, lowest digit first, each with its sign: digits of many tasks add up within a long."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & 0xFFFFFFFF))
        x >>= 32
    return out


def _moved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: the floored means of the parts that are nearest to each entry; entries without a part stay."""
    parts, entries, size = books.entries.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), object)
        for batch in batches:
            for _, rows in _blocks(batch):
                codes, _ = assign(rows, own)
                for p in range(parts):
                    part = rows[:, p * size : (p + 1) * size]
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(part[order], starts, axis=0).astype(object)
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        slots = (p * entries + e).repeat(size) * size + np.tile(np.arange(size), len(p))
        digits = [(slot, k, digit, n if k == 0 else 0) for slot, x, n in zip(slots.tolist(), total[p, e].reshape(-1).tolist(), count[p, e].repeat(size).tolist()) for k, digit in enumerate(_digits(x))]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in digits], pa.int64()) for i in range(4)], names=["slot", "place", "digit", "n"])

    sums = kept.select("v").mapInArrow(run, "slot long, place long, digit long, n long").groupBy("slot", "place").agg(F.sum("digit").alias("digit"), F.sum("n").alias("n"))
    total, count = Counter(), Counter()
    for r in sums.collect():  # a few rows for each component of the codebooks
        total[r["slot"]] += r["digit"] << (32 * r["place"])
        count[r["slot"]] += r["n"]
    sent.unpersist()
    out = books.entries.astype(object).reshape(-1)
    for slot, n in count.items():
        out[slot] = total[slot] // n
    moved = out.reshape(parts, entries, size)
    return Codebooks(moved.astype(np.int64) if np.abs(moved).max(initial=0) < 2**24 else moved)


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(row, code, error) of train()'s rows: two hex digits for each part, and the squared distance that the code leaves."""
    sent = kept.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _blocks(batch):
                codes, errors = assign(vectors, sent.value)
                text = ["".join(row) for row in digits[codes]]
                whole = [int(x) for x in errors.sum(axis=1)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(text, pa.string()), pa.array([x if x < _LONG else None for x in whole], pa.int64())], names=[*rows.schema.names[:-1], "code", "error"])

    names = kept.schema["row"].dataType.simpleString()
    return kept.mapInArrow(run, f"row {names}, code string, error long")


def decode(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """The integer vectors that codes (vectors, parts) stand for."""
    return np.concatenate([books.entries[p][codes[:, p]] for p in range(books.entries.shape[0])], axis=1)


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **options: int) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row."""
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("embedding"))
    books, kept = train(named, "vec_id", "embedding", **options)
    if books is None:
        return kept.select("row.vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    slim = kept.select(F.struct("row.vec_id", "row.label").alias("row"), "v")
    coded = materialize(encode(slim, books).select("row.vec_id", "row.label", "code", "error"), "codes")
    sums = materialize(coded.groupBy(F.col("label").alias("_label")).agg(_long_sum("error").alias("label_error")), "label-errors")
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS w FROM kept, (SELECT unnest(range({PARTS})) AS p)
),
b0 AS (SELECT p, r AS e, w FROM parts WHERE r < {ENTRIES}),
"""


def _round(k: int) -> str:
    distance = "list_sum(list_transform(range(1, len(a.w) + 1), lambda i: (a.w[i] - b.w[i]) * (a.w[i] - b.w[i])))"
    return f"""
d{k} AS (SELECT a.p, a.r, b.e, CAST({distance} AS BIGINT) AS d FROM parts a JOIN b{k} b USING (p)),
a{k} AS (SELECT p, r, e, d FROM (SELECT *, row_number() OVER (PARTITION BY p, r ORDER BY d, e) AS k FROM d{k}) WHERE k = 1),
"""


def _move(k: int) -> str:
    return f"""
m{k} AS (
  SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM a{k} a JOIN parts USING (p, r)) GROUP BY p, e, i
),
b{k + 1} AS (
  SELECT b.p, b.e, coalesce(g.w, b.w) AS w FROM b{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m{k} GROUP BY p, e) g USING (p, e)
),
"""


SQL += "".join(_round(k) + _move(k) for k in range(ROUNDS)) + _round(ROUNDS)
SQL += f"""
sha AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""
