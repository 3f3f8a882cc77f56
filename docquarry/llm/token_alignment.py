"""Alignment of two tokenizers: which of their tokens share bytes of a text, and how often over all documents.

Method. A text is cut where both tokenizers surely cut: before a space behind a character that is no white space. Tokens of such a
chunk depend on the chunk alone, so each different chunk of a task is encoded once, and its bytes are compared with what the tokens
spell. Both token rows of many chunks are aligned together: tokens that overlap are links, and places where tokens of both end
bound groups. A linked pair of ids is packed into one int64 key, the first id above, and a document keeps its distinct keys with
their numbers of links.

Counts. Each partition counts its documents' keys by np.unique, so a hot pair is one row a partition; the partial counts go
through a range-partitioned sort, and runs of a key are summed within their shard, where they meet. The sorted shards are files that
every executor fetches once, unpacks once and maps into memory; its workers share the pages, and look keys up by searchsorted.
No text is encoded twice, and nothing but the best count of each first id (at most the vocabulary) passes through the driver.
The shards have at most one key for each pair of ids of the two vocabularies, whatever the corpus; above MOST_MAPPED keys
they are not sent, and documents' keys meet their counts in a join instead.

Defined results. A text that is null, empty, or not spelled exactly by both tokenizers has no tokens: zeros, an empty digest.
Repeated rows and ids are rows like any other; a null doc_id stays null; an empty table gives an empty result; other columns are ignored,
whatever their names. Very long texts are cut like others; a text without a place to cut is one chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_bytes
from .common import materialize, send_parts, table
from .pretokens import load_tokenizer

#: Chunks that a worker keeps, and characters of text that it works on together: bounds of its memory.
KEPT_CHUNKS, CHARS = 200_000, 1_000_000
#: New chunks that are encoded as one text, and aligned at once.
JOINED, AT_ONCE = 128, 20_000
#: Distinct keys that a partition counts before it passes them on.
MOST_COUNTED = 4_000_000
#: Keys up to which executors map the counts (16 bytes each).
MOST_MAPPED = 200_000_000

#: White space and what might pass for it: no chunk begins behind one of these.
_BLANK = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯▁　﻿"
_CHUNK = re.compile(rf" [^ ]*(?:(?<=[{_BLANK}]) [^ ]*)*")
_OPEN = re.compile(rf"[{_BLANK}]\Z")
_MASK = (1 << 32) - 1


def chunks(text: str) -> list[str]:
    """The parts of a space and a text that both tokenizers take independently."""
    return _CHUNK.findall(f" {text}")


class Pair:
    """Both tokenizers in one worker, with the bytes that each id spells."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece

        self.a = load_tokenizer(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.a_bytes = token_bytes(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_text, self.b_text = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: Whether a piece goes on behind a word's end, so that texts must not be cut.
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        #: A space that ends a text: alone, the second tokenizer would take it for nothing.
        self.last_space = self.b.encode("a ")[len(self.b.encode("a")) :]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by both tokenizers, one text behind the other."""
        b = [self.last_space if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1))]
        flat = lambda rows: np.fromiter(chain.from_iterable(rows), np.int64)
        return flat(e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)), flat(b)


def _split(ends: np.ndarray, bounds: np.ndarray) -> np.ndarray | None:
    """Number of tokens of each chunk, of tokens and chunks that end at these bytes; None where they do not fit together."""
    last = np.searchsorted(ends, bounds, side="right")
    closed = last > 0
    fits = (len(ends) == 0 or ends[-1] == bounds[-1]) and closed.all() and (ends[last - 1] == bounds).all()
    return np.diff(last, prepend=0) if fits else None


class Aligned:
    """Chunks side by side: numbers of tokens, groups and links, each chunk's groups as text, and its links' keys."""

    def __init__(self, pair: Pair, parts: list[str]) -> None:
        # chunks that end in white space would run into the next one
        joined = ["".join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)] if not any(map(_OPEN.search, parts)) else parts
        flat_a, flat_b = pair.encode(joined)
        bounds = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
        end_a, end_b = np.cumsum(pair.a_len[flat_a]), np.cumsum(pair.b_len[flat_b])
        n_a, n_b = _split(end_a, bounds), _split(end_b, bounds)
        whole = "".join(parts).encode()
        spelled = n_a is not None and n_b is not None and whole == b"".join(map(pair.a_bytes.__getitem__, flat_a.tolist())) == b"".join(map(pair.b_bytes.__getitem__, flat_b.tolist()))
        self.valid = np.ones(len(parts), bool)
        if not spelled and len(parts) > 1:
            self._join([Aligned(pair, parts[: len(parts) // 2]), Aligned(pair, parts[len(parts) // 2 :])])
            return
        if not spelled:
            self.valid[0] = False
            flat_a = flat_b = end_a = end_b = np.zeros(0, np.int64)
            n_a = n_b = np.zeros(1, np.int64)
        self.n_a, self.n_b = n_a, n_b
        start_a = end_a - pair.a_len[flat_a]
        # tokens of b that overlap a token of a: from the first that ends behind its start to the first that reaches its end
        low = np.searchsorted(end_b, start_a, side="right")
        high = np.searchsorted(end_b, end_a, side="left")
        links = high - low + 1
        row = np.repeat(np.arange(len(flat_a)), links)
        self.keys = flat_a[row] << 32 | flat_b[_spans(low, links)]
        per_chunk = lambda values, counts: np.add.reduceat(np.append(values, 0), np.minimum(np.cumsum(counts) - counts, len(values))) * (counts > 0)
        self.n_links = per_chunk(links, self.n_a)
        closes = end_b[high] == end_a
        self.n_groups = per_chunk(closes.astype(np.int64), self.n_a)
        self.texts = self._texts(pair, flat_a, flat_b, closes, high)

    def _join(self, halves: list[Aligned]) -> None:
        for name in ("valid", "n_a", "n_b", "n_links", "n_groups", "keys"):
            setattr(self, name, np.concatenate([getattr(h, name) for h in halves]))
        self.texts = [t for h in halves for t in h.texts]

    def _texts(self, pair: Pair, flat_a: np.ndarray, flat_b: np.ndarray, closes: np.ndarray, high: np.ndarray) -> list[str]:
        """Groups of each chunk, as `a1,a2|b1;...`."""
        a, b = list(map(pair.a_text.__getitem__, flat_a.tolist())), list(map(pair.b_text.__getitem__, flat_b.tolist()))
        stops = np.flatnonzero(closes)
        groups, at_a, at_b = [], 0, 0
        for to_a, to_b in zip((stops + 1).tolist(), (high[stops] + 1).tolist()):
            groups.append(f"{a[at_a]}|{b[at_b]}" if to_a - at_a == 1 == to_b - at_b else f"{','.join(a[at_a:to_a])}|{','.join(b[at_b:to_b])}")
            at_a, at_b = to_a, to_b
        out, at = [], 0
        for n in self.n_groups.tolist():
            out.append(";".join(groups[at : at + n]))
            at += n
        return out


class _Kept:
    """The chunks that a worker has aligned, by number. When full, it keeps those that came again."""

    def __init__(self, pair: Pair, most: int) -> None:
        self.pair, self.most = pair, most
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.texts: list[str] = []
        self.table = np.zeros((0, 6), np.int64)  # valid, n_a, n_b, n_groups, n_links, start of the keys
        self.keys = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def shrink(self) -> None:
        again = np.flatnonzero(self.times > 1)
        if len(again) > self.most * 3 // 4:
            again = again[np.argsort(-self.times[again], kind="stable")[: self.most * 3 // 4]]
            again.sort()
        chunk = list(self.number)
        self.number = defaultdict(count(len(again)).__next__, {chunk[i]: k for k, i in enumerate(again.tolist())})
        self.texts = [self.texts[i] for i in again.tolist()]
        table = self.table[again]
        self.keys = self.keys[_spans(table[:, 5], table[:, 4])]
        table[:, 5] = np.cumsum(table[:, 4]) - table[:, 4]
        self.table, self.times = table, np.zeros(len(again), np.int64)

    def numbers(self, cut: list[list[str]]) -> list[np.ndarray]:
        if len(self.number) > self.most:
            self.shrink()
        known = len(self.number)
        out = [np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts)) for parts in cut]
        fresh = list(islice(self.number, known, None))
        tables, keys, size = [self.table], [self.keys], len(self.keys)
        for at in range(0, len(fresh), AT_ONCE):
            some = fresh[at : at + AT_ONCE]
            # those that end in white space go apart, each as a text of its own
            closed = np.array([_OPEN.search(c) is None for c in some], bool)
            order = np.argsort(~closed, kind="stable")
            ordered, n = [some[i] for i in order.tolist()], int(closed.sum())
            new = Aligned(self.pair, ordered[:n]) if n else None
            rest = Aligned(self.pair, ordered[n:]) if n < len(ordered) else None
            both = [x for x in (new, rest) if x is not None]
            part = np.concatenate([np.stack([x.valid, x.n_a, x.n_b, x.n_groups, x.n_links, np.cumsum(x.n_links) - x.n_links], 1) for x in both])
            part[n:, 5] += len(new.keys) if new is not None else 0
            part[:, 5] += size
            keys += [x.keys for x in both]
            size += sum(len(x.keys) for x in both)
            back = np.argsort(order, kind="stable")
            texts = [t for x in both for t in x.texts]
            tables.append(part[back])
            self.texts += [texts[i] for i in back.tolist()]
        self.table, self.keys = np.concatenate(tables), np.concatenate(keys)
        self.times = np.concatenate([self.times, np.zeros(len(fresh), np.int64)])
        if out:
            self.times += np.bincount(np.concatenate(out), minlength=len(self.times))
        return out


@cache
def _kept(first: str, second: str, most: int) -> _Kept:
    """One for all tasks of a worker."""
    return _Kept(Pair(first, second), most)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs, one run behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _distinct(doc: np.ndarray, number: np.ndarray, kept: _Kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences (document, chunk): document, key and number of links, once for each document and key."""
    pairs, times = np.unique(doc << 32 | number, return_counts=True)
    doc, number = pairs >> 32, pairs & _MASK
    n = kept.table[number, 4]
    values, where = np.unique(kept.keys[_spans(kept.table[number, 5], n)], return_inverse=True)
    both, where = np.unique(np.repeat(doc, n) << 32 | where, return_inverse=True)
    weight = np.bincount(where, weights=np.repeat(times, n), minlength=len(both)).astype(np.int64)
    return both >> 32, values[both & _MASK], weight


_FIELDS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, keys binary, times binary"


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def aligned(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = True, kept_chunks: int = KEPT_CHUNKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, keys, times) of every row of docs.

    keys: the distinct linked pairs in ascending order, packed as int64; times: the number of links of each, as int32. groups, which
    are as long as the text, are null unless asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(first, second, kept_chunks)
        for batch in batches:
            for low, high in _runs(batch.column(1), CHARS):
                yield _rows(kept, batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).to_pylist(), with_groups)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _SCHEMA)


def _rows(kept: _Kept, ids: pa.Array, texts: list[str | None], with_groups: bool) -> pa.RecordBatch:
    cut = [[] if not t else [f" {t}"] if kept.pair.whole else chunks(t) for t in texts]
    numbers = kept.numbers(cut)
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    # texts with a chunk that is not spelled by both have no tokens at all
    good = np.array([bool(len(n)) and bool(kept.table[n, 0].all()) for n in numbers], bool)
    numbers = [n if ok else n[:0] for n, ok in zip(numbers, good)]
    sizes *= good
    number, doc = np.concatenate([np.zeros(0, np.int64), *numbers]), np.repeat(np.arange(len(texts)), sizes)
    sums = np.zeros((len(texts), 4), np.int64)
    if len(number):
        has = np.flatnonzero(sizes)
        sums[has] = np.add.reduceat(kept.table[number, 1:5], (np.cumsum(sizes) - sizes)[has], axis=0)
    owner, key, times = _distinct(doc, number, kept)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    groups = [";".join([kept.texts[i] for i in n.tolist()]) if ok else "" for n, ok in zip(numbers, good)]
    digests = [hashlib.sha256(g.encode()).hexdigest() if ok else "" for g, ok in zip(groups, good)]
    blob = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())
    shown = groups if with_groups else [None] * len(texts)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(shown, pa.string()), blob(key), blob(times.astype(np.int32))], names=["doc_id", *_FIELDS, "groups_sha256", "groups", "keys", "times"])


def pair_counts(rows: DataFrame, most_counted: int = MOST_COUNTED) -> DataFrame:
    """(key, n) over aligned() rows: in how many rows each pair is linked, sorted within range-partitioned shards, each key once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            fresh, count = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            both, where = np.unique(np.concatenate([key, fresh]), return_inverse=True)
            return both, np.bincount(where, weights=np.concatenate([n, count]), minlength=len(both)).astype(np.int64)

        for batch in batches:
            for blob in batch.column(0):
                waiting.append(np.frombuffer(blob.as_buffer() or b"", np.int64))
                size += len(waiting[-1])
                if size > most_counted:
                    (key, n), waiting, size = folded(), [], 0
                    if len(key) > most_counted:
                        yield _counts(key, n)
                        key = n = np.zeros(0, np.int64)
        yield _counts(*folded())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[starts], np.add.reduceat(n, starts)
            if last_key is not None:  # the run that may go on from the batch before
                if key[0] == last_key:
                    n[0] += last_n
                else:
                    yield _counts(np.array([last_key]), np.array([last_n]))
            last_key, last_n = int(key[-1]), int(n[-1])
            yield _counts(key[:-1], n[:-1])
        if last_key is not None:
            yield _counts(np.array([last_key]), np.array([last_n]))

    found = rows.select("keys").mapInArrow(partial, "key long, n long")
    return found.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(summed, "key long, n long")


def _counts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


@cache
def _mapped(names: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The shards of fetched files: their first keys, and keys and counts as mapped arrays. An executor's first worker that comes unpacks them."""
    import fcntl

    done = f"{SparkFiles.get(names[0])}.shards"
    with open(f"{done}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.isdir(done):
            making = f"{done}-{os.getpid()}"
            os.makedirs(making)
            for name in names:
                first = None
                with open(f"{making}/key", "wb") as keys, open(f"{making}/n", "wb") as counts:
                    for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(columns=["key", "n"]):
                        key = batch.column(0).to_numpy(zero_copy_only=False)
                        first = int(key[0]) if first is None and len(key) else first
                        keys.write(key.tobytes())
                        counts.write(batch.column(1).to_numpy(zero_copy_only=False).tobytes())
                if first is not None:
                    for what in ("key", "n"):
                        os.rename(f"{making}/{what}", f"{making}/{first:020d}.{what}")
            os.rename(making, done)
    firsts = sorted(f.removesuffix(".key") for f in os.listdir(done) if f.endswith(".key"))
    shards = [tuple(np.memmap(f"{done}/{x}.{what}", np.int64, "r") for what in ("key", "n")) for x in firsts]
    return np.array([int(x) for x in firsts], np.int64), shards


def look_up(keys: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Counts of keys that all are in the shards."""
    firsts, shards = _mapped(names)
    shard = np.searchsorted(firsts, keys, side="right") - 1
    out = np.zeros(len(keys), np.int64)
    for s in np.unique(shard).tolist():
        at = np.flatnonzero(shard == s)
        own, n = shards[s]
        out[at] = n[np.searchsorted(own, keys[at])]
    return out


def scored(rows: DataFrame, counts: DataFrame, most_mapped: int = MOST_MAPPED) -> DataFrame:
    """aligned() rows without keys, with n_best and count_sum; rows and counts are written tables."""
    spark, shown = rows.sparkSession, [c for c in rows.columns if c not in ("keys", "times")]
    best = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("keys"))
    if counts.count() > most_mapped:
        return _scored_by_join(rows, counts, best, shown)
    top = np.zeros(1 << 16, np.int64)
    for r in best.collect():  # at most one row for each id of the first vocabulary
        if r["a"] >= len(top):
            top = np.append(top, np.zeros(r["a"] + 1, np.int64))
        top[r["a"]] = r["n"]
    sent = spark.sparkContext.broadcast(top)
    names = send_parts(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            keys = [np.frombuffer(b.as_buffer() or b"", np.int64) for b in batch.column(batch.num_columns - 2)]
            times = [np.frombuffer(b.as_buffer() or b"", np.int32) for b in batch.column(batch.num_columns - 1)]
            key, weight = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *times]).astype(np.int64)
            if len(key):
                different, where = np.unique(key, return_inverse=True)
                count = look_up(different, names)
                is_best = count == sent.value[different >> 32]
                sizes = np.fromiter(map(len, keys), np.int64, len(keys))
                has = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[has]
                n_best[has] = np.add.reduceat(weight * is_best[where], starts)
                total[has] = np.add.reduceat(weight * count[where], starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_best), pa.array(total)], names=[*shown, "n_best", "count_sum"])

    declared = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in shown)
    return rows.select(*shown, "keys", "times").mapInArrow(run, f"{declared}, n_best long, count_sum long")


def _scored_by_join(rows: DataFrame, counts: DataFrame, best: DataFrame, shown: list[str]) -> DataFrame:
    """The same for counts too many to map: documents' keys meet them in a join on the key."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(b.as_buffer() or b"", np.int64) for b in batch.column(1)]
            times = [np.frombuffer(b.as_buffer() or b"", np.int32) for b in batch.column(2)]
            for row, key, n in zip(batch.column(0).to_pylist(), keys, times):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key), pa.array(n.astype(np.int64))], names=["row", "key", "times"])

    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    each = numbered.select("row", "keys", "times").mapInArrow(exploded, "row long, key long, times long")
    judged = counts.join(best.select("a", F.col("n").alias("top")), F.shiftright("key", 32) == F.col("a")).select("key", "n", (F.col("n") == F.col("top")).alias("is_best"))
    sums = each.join(judged, "key").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = numbered.join(sums, "row", "left")
    return out.select(*shown, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = True, most_mapped: int = MOST_MAPPED, **options: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum) of every row of docs."""
    rows = materialize(aligned(docs, first, second, doc_id, text, with_groups, **options), "aligned")
    counts = materialize(pair_counts(rows), "pair-counts")
    return scored(rows, counts, most_mapped)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return found.drop("groups")
