"""Benchmark decontamination with a distributed positional inverted index.

Index. Documents are dealt to segments of about SEGMENT_WORDS words, whole and in the order in which tasks read them. A segment is one
row of a written table: its documents, its terms, and for each term the ascending positions at which it stands. Documents follow
each other with one place left free, so no run of words goes over a document's end. Building is one scan; nothing is shuffled.

Search. Phrases meet every segment, in blocks: the words of a block, at most BLOCK_WORDS, are broadcast, and a larger set of phrases
takes several blocks, whose matches meet by document. In a segment, a phrase whose terms are not all there is out. Of the others, the rarest
term's positions, less its place in the phrase, are the first candidates; the next rarer term's list, less its own place, is
intersected with them, and so on, for many phrases at once. What is left are exact phrase matches. For proximity matches
the rarest term's positions are kept where every other word has a position near enough, and the shortest span is found there.

Defined results. Null and texts without a word have no words: zeros. Repeated rows are rows of their own; null and repeated doc_ids stay as
they are. Items that are equal in id and text count once, items of equal id count as one; an item without an id marks words
but is not listed. Empty tables give empty results, or clean documents. Other columns are ignored, whatever their names. A very long text
is a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, SEGMENT_WORDS, BLOCK_WORDS = 10, 400_000, 2_000_000
#: Candidate places that are intersected together: bounds a worker's memory.
CANDIDATES = 2_000_000

#: Bytes of words stay, A-Z lower-cased; all others become a space. Bytes of characters beyond ASCII are parts of words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_INDEX = "segment long, doc_ids array<long>, n_words binary, terms binary, counts binary, postings binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _ints(blob: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(blob.as_buffer() or b"", kind)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of runs, one run behind the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _segment(number: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    """One segment's row. A term's list is its run of positions, written as differences."""
    vocabulary: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, texts), np.int32, len(texts))
    term = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for words in texts for w in words), np.int32, int(lengths.sum()))
    position = _spans(np.cumsum(lengths + 1) - (lengths + 1), lengths).astype(np.int32)
    order = np.argsort(term, kind="stable")
    postings, counts = position[order], np.bincount(term, minlength=len(vocabulary)).astype(np.int32)
    row = {"segment": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64()))}
    blobs = {"n_words": lengths, "terms": None, "counts": counts, "postings": np.diff(postings, prepend=np.int32(0))}
    row |= {k: pa.array([b" ".join(vocabulary) if v is None else v.tobytes()], pa.binary()) for k, v in blobs.items()}
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of every row of docs, as a written table of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                words = words_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                if ids and size + len(words) > segment_words:
                    yield _segment(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i.as_py())
                texts.append(words)
                size += len(words)
        if ids:
            yield _segment(number, ids, texts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, _INDEX), "positions")


@dataclass
class Phrases:
    """Different phrases, one behind the other: terms by number, each phrase's bounds, and the items that each belongs to."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    item_bounds: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes]], width: int | None = None) -> Phrases:
        """Whole items, or their windows of `width` words; an item of fewer words is one window."""
        vocabulary: dict[bytes, int] = {}
        numbers: dict[str | None, int] = {}
        owners: dict[tuple[int, ...], dict[int, None]] = {}
        for name, text in items:
            ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text))
            n = len(ids) if width is None else min(width, len(ids))
            own = numbers.setdefault(name, len(numbers))
            for at in range(len(ids) - n + 1 if n else 0):
                owners.setdefault(ids[at : at + n], {})[own] = None
        bounds = lambda parts: np.cumsum([0, *map(len, parts)])
        flat = lambda parts: np.fromiter((x for p in parts for x in p), np.int64)
        return cls(vocabulary, flat(owners), bounds(owners), flat(owners.values()), bounds(owners.values()), list(numbers))


class Postings:
    """A segment's lists of the terms of some phrases, as ascending keys (term, position)."""

    def __init__(self, row: dict[str, pa.Scalar], vocabulary: dict[bytes, int]) -> None:
        self.ids = row["doc_ids"].as_py()
        self.n_words = _ints(row["n_words"]).astype(np.int64)
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.size = int((self.n_words + 1).sum())
        terms = (row["terms"].as_py() or b"").split(b" ") if len(row["counts"].as_buffer() or b"") else []
        asked = np.fromiter((vocabulary.get(t, -1) for t in terms), np.int64, len(terms))
        counts = _ints(row["counts"]).astype(np.int64)
        starts = np.cumsum(counts) - counts
        there = np.flatnonzero(asked >= 0)
        there = there[np.argsort(asked[there])]
        positions = np.cumsum(_ints(row["postings"]), dtype=np.int64)[_spans(starts[there], counts[there])]
        self.keys = np.repeat(asked[there], counts[there]) << 32 | positions
        self.counts = np.zeros(len(vocabulary), np.int64)
        self.counts[asked[there]] = counts[there]
        self.starts = np.zeros(len(vocabulary), np.int64)
        self.starts[asked[there]] = np.cumsum(counts[there]) - counts[there]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term << 32 | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def ranked(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases whose terms all are here, with each one's terms and places, rarest first, and where these begin."""
        sizes = np.diff(phrases.bounds)
        if not len(sizes) or not len(self.keys):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        least = np.minimum.reduceat(self.counts[phrases.terms], phrases.bounds[:-1])
        alive = np.flatnonzero(least > 0)
        flat = _spans(phrases.bounds[alive], sizes[alive])
        owner, term = np.repeat(np.arange(len(alive)), sizes[alive]), phrases.terms[flat]
        place = flat - np.repeat(phrases.bounds[alive], sizes[alive])
        order = np.lexsort((place, self.counts[term], owner))
        return alive, term[order], place[order], np.cumsum(sizes[alive]) - sizes[alive]

    def matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first position of every exact match."""
        alive, term, place, begin = self.ranked(phrases)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        n = self.counts[term[begin]] if len(alive) else np.zeros(0, np.int64)
        size = np.diff(phrases.bounds)[alive]
        total = np.cumsum(n)
        low = 0
        while low < len(alive):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CANDIDATES, side="right")))
            who = np.repeat(np.arange(low, high), n[low:high])
            rarest = begin[low:high]
            start = (self.keys[_spans(self.starts[term[rarest]], n[low:high])] & 0xFFFFFFFF) - np.repeat(place[rarest], n[low:high])
            keep, k = start >= 0, 0
            while True:
                who, start = who[keep], start[keep]
                k += 1
                more = np.flatnonzero(size[who] > k)
                if not len(more):
                    break
                at = begin[who[more]] + k
                keep = np.ones(len(who), bool)
                keep[more] = self.has(term[at], start[more] + place[at])
            out.append((alive[who], start))
            low = high
        return tuple(np.concatenate(x) for x in zip(*out))

    def near(self, phrases: Phrases, within: int) -> Iterator[tuple[int, int, int, int]]:
        """(phrase, document, first position, words) of the shortest span of at most `within` words with all of a phrase's words, once for
        each document; ties go to the first. The order of the words is free, and a repeated word counts once."""
        alive, term, _, begin = self.ranked(phrases)
        ends = np.append(begin[1:], len(term))
        for p, low, high in zip(alive.tolist(), begin.tolist(), ends.tolist()):
            terms = list(dict.fromkeys(term[low:high].tolist()))
            lists = [self.keys[(s := self.starts[t]) : s + self.counts[t]] & 0xFFFFFFFF for t in terms]
            anchor = lists[0]
            for other in lists[1:]:
                at = np.searchsorted(other, anchor - within + 1)
                anchor = anchor[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] < anchor + within)]
            best: dict[int, tuple[int, int]] = {}
            for a, d in zip(anchor.tolist(), self.document(anchor).tolist()):
                floor, ceiling = int(self.first[d]), int(self.first[d] + self.n_words[d])
                close = [x[np.searchsorted(x, max(floor, a - within + 1)) : np.searchsorted(x, min(ceiling, a + within))].tolist() for x in lists]
                span = _shortest(close, a)
                if span and span[0] <= within:
                    best[d] = min(best.get(d, span), span)
            for d, (size, start) in best.items():
                yield p, d, start - int(self.first[d]), size


def _shortest(lists: list[list[int]], anchor: int) -> tuple[int, int] | None:
    """(words, first position) of the shortest span with one position of each list and the anchor, which stands for the first list."""
    if not all(lists):
        return None
    found = None
    for start in sorted({anchor, *(p for x in lists[1:] for p in x if p <= anchor)}):
        reach = [next((p for p in x if p >= start), None) for x in lists[1:]]
        if None not in reach:
            span = (max([anchor, *reach]) - start + 1, start)
            found = min(found or span, span)
    return found


def _asked(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about block_words words, dealt by a hash of each."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    for k in range(n):
        yield [(r["item"], r["text"].encode()) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def _mapped(index: DataFrame, phrases: Phrases, schema: str, rows_of) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                yield rows_of(row["segment"].as_py(), Postings(row, sent.value.vocabulary), sent.value)

    return index.mapInArrow(run, schema)


_HITS = "segment long, doc int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _hits(segment: int, postings: Postings, phrases: Phrases) -> pa.RecordBatch:
    """A row for each document of a segment: runs of hit words, and the items that hit, as sorted strings."""
    phrase, start = postings.matches(phrases)
    change = np.zeros(postings.size + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + np.diff(phrases.bounds)[phrase], -1)
    hit = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
    begins, stops = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
    owner = postings.document(begins)
    n = len(postings.ids)
    base = postings.first[owner]
    span_at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(span_at), pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], names=["start", "end"]))
    pairs = np.unique(postings.document(start) * max(len(phrases.bounds), 1) + phrase)
    doc, phrase = pairs // max(len(phrases.bounds), 1), pairs % max(len(phrases.bounds), 1)
    sizes = np.diff(phrases.item_bounds)[phrase]
    pairs = np.unique(np.repeat(doc, sizes) << 32 | phrases.items[_spans(phrases.item_bounds[phrase], sizes)])
    names: list[list[str]] = [[] for _ in range(n)]
    for d, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
        if phrases.names[i] is not None:
            names[d].append(phrases.names[i])
    columns = [pa.array(np.full(n, segment)), pa.array(np.arange(n, dtype=np.int32)), pa.array(postings.ids, pa.int64()), pa.array(postings.n_words), spans, pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "doc", "doc_id", "n_words", "spans", "items"])


def _union(spans: Column) -> Column:
    """Sorted runs of sorted spans that overlap or touch."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]), longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def contamination(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: the runs of its words inside of an occurrence of a window, as word numbers from 0,
    and the items with such a window, sorted as strings."""
    found = [_mapped(index, Phrases.of(block, width), _HITS, _hits) for block in _asked(items, item_id, text, block_words)]
    if len(found) == 1:
        return found[0].select("doc_id", "n_words", "spans", "items")
    hits = found[0].select("segment", "doc", "spans", "items").filter(F.size("spans") > 0)
    for more in found[1:]:
        hits = hits.unionByName(more.select("segment", "doc", "spans", "items").filter(F.size("spans") > 0))
    merged = hits.groupBy("segment", "doc").agg(_union(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = _mapped(index, Phrases.of([]), _HITS, _hits).drop("spans", "items").join(merged, ["segment", "doc"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(merged.dtypes)[c]))
    return every.select("doc_id", "n_words", empty("spans").alias("spans"), empty("items").alias("items"))


def exact_matches(index: DataFrame, phrases: DataFrame, phrase_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, phrase, start): every place where a whole phrase stands, as a word number from 0."""

    def rows_of(segment: int, postings: Postings, asked: Phrases) -> pa.RecordBatch:
        phrase, start = postings.matches(asked)
        doc = postings.document(start)
        sizes = np.diff(asked.item_bounds)[phrase]
        owners = asked.items[_spans(asked.item_bounds[phrase], sizes)].tolist()
        doc, start = np.repeat(doc, sizes), np.repeat(start - postings.first[doc], sizes)
        return pa.RecordBatch.from_arrays([pa.array([postings.ids[d] for d in doc.tolist()], pa.int64()), pa.array([asked.names[i] for i in owners], pa.string()), pa.array(start, pa.int64())], names=["doc_id", "phrase", "start"])

    return _all_blocks(index, phrases, phrase_id, text, block_words, "doc_id long, phrase string, start long", rows_of)


def near_matches(index: DataFrame, phrases: DataFrame, within: int, phrase_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, phrase, start, words): for each document and phrase the shortest span of at most `within` words with all of its words."""

    def rows_of(segment: int, postings: Postings, asked: Phrases) -> pa.RecordBatch:
        rows = [(postings.ids[d], asked.names[i], start, size) for p, d, start, size in postings.near(asked, within) for i in asked.items[asked.item_bounds[p] : asked.item_bounds[p + 1]].tolist()]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "phrase", "start", "words"])

    return _all_blocks(index, phrases, phrase_id, text, block_words, "doc_id long, phrase string, start long, words long", rows_of)


def _all_blocks(index: DataFrame, phrases: DataFrame, phrase_id: str, text: str, block_words: int, schema: str, rows_of) -> DataFrame:
    parts = [_mapped(index, Phrases.of(block), schema, rows_of) for block in _asked(phrases, phrase_id, text, block_words)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    out = found.withColumn("n_hit", n_hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT r, i, p.n, item FROM places p JOIN windows w ON p.phrase = w.phrase AND p.n = w.n),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
