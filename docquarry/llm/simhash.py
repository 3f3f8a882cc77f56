"""SimHash near-duplicates: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprint: words of the lower-cased (A-Z) text, 3-word shingles with repeats, XXH64 with seed 42; a bit is 1 if
it is set in over half of the hashes. Two fingerprints are linked if at most RADIUS bits differ.

Method. Copies are first folded: only distinct fingerprints are compared. A tile holds fingerprints that agree in
one of RADIUS + 1 blocks of bits (two fingerprints within the radius agree in at least one) and whose population
count is in one class of RADIUS + 1 counts; a tile meets only itself and the tile one class below, because counts
further apart differ by more than the radius. Inside, numpy takes the exclusive-or of all pairs and counts bits.
Links found in a tile are reduced to a spanning forest before they leave it, so a group of near copies gives as
many edges as members. Components follow by star contraction.

Scale. Rows that are shuffled are 8-byte fingerprints, 2 * (RADIUS + 1) for each distinct one. `blocks` may be
raised (any blocks - RADIUS of them then agree) to make tiles finer on larger corpora; results are the same. A hot
tile is bounded by the distinct fingerprints in it, not by documents.

Defined results. Null, empty and blank texts have fingerprint zero and are linked like any other. Fewer than three
words are one shingle. Repeated rows give repeated results. A null doc_id takes part; a component whose ids are all
null has a null id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import connected_components

RADIUS = 3
SEED = 42
BLOCKS = RADIUS + 1
#: Tiles up to this size are compared together, by lag; larger ones by blocks of rows.
SMALL_TILE = 48
_ROWS, _COLS = 512, 8192
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = 256 * np.arange(8)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text in UTF-8, as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: both touch ASCII only, as the contract says
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])], dtype="<u8")
    # bits are counted through the 256 values of each byte lane
    lanes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (lanes @ _BITS).ravel() > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id, fp) for every row, and its key (a long) if one is named; fp is the fingerprint's 64 bits as a signed integer."""
    more = [F.col(key).alias("key")] if key else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(_fingerprints, "doc_id long, fp long" + ", key long" * bool(key))


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges, in place, the groups of positions i[k] and j[k]; a label is the smallest position of its group."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _tile_links(fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one large tile: own rows against own rows and guests."""
    labels = np.arange(len(fps))
    mine = np.flatnonzero(own)
    for r in range(0, len(mine), _ROWS):
        rows = mine[r : r + _ROWS]
        for c in range(0, len(fps), _COLS):
            near = np.bitwise_count(fps[rows][:, None] ^ fps[None, c : c + _COLS]) <= RADIUS
            i, j = np.nonzero(near)
            _join_labels(labels, rows[i], j + c)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _tail(tiles: np.ndarray) -> int:
    """How many rows at the end belong to the last tile."""
    other = np.flatnonzero(tiles != tiles[-1])
    return len(tiles) - (int(other[-1]) + 1 if len(other) else 0)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by tile (k0, k1) in, links out. A tile that a batch's end cuts is carried on."""

    def solve(tiles: np.ndarray, fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]])
        sizes = np.diff(np.r_[starts, len(tiles)])
        left, right = [], []
        small = np.repeat(sizes <= SMALL_TILE, sizes)
        t, f, o = tiles[small], fps[small], own[small]
        for lag in range(1, int(sizes[sizes <= SMALL_TILE].max(initial=0))):
            same = np.flatnonzero(t[lag:] == t[:-lag])
            if not len(same):
                break
            near = same[(np.bitwise_count(f[same] ^ f[same + lag]) <= RADIUS) & (o[same] | o[same + lag])]
            left.append(f[near])
            right.append(f[near + lag])
        for s, n in zip(starts[sizes > SMALL_TILE], sizes[sizes > SMALL_TILE]):
            a, b = _tile_links(fps[s : s + n], own[s : s + n])
            left.append(a)
            right.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)).astype(bool)]
        if not len(new[0]):
            continue
        if held and held[-1][0][-1] == new[0][-1]:
            held.append(new)  # one tile goes on through the whole batch
            continue
        tiles, fps, own = (np.concatenate([h[k] for h in held] + [new[k]]) for k in range(3))
        cut = len(tiles) - _tail(new[0])
        if cut > 0:
            yield solve(tiles[:cut], fps[:cut], own[:cut])
        held = [[tiles[cut:], fps[cut:], own[cut:]]]
    if held:
        yield solve(*(np.concatenate([h[k] for h in held]) for k in range(3)))


def tile_rows(classes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(tile, fp, own): each fingerprint in its tiles, as owner in its class of population counts and as guest one class above."""
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * b) for b in kept) for kept in combinations(range(blocks), blocks - RADIUS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for n, m in enumerate(masks)])
    each = classes.select("fp", F.explode(keys).alias("key"), (F.bit_count("fp") / (RADIUS + 1)).cast("int").alias("class"))
    each = each.select("fp", "key", F.explode(F.array(F.struct(F.col("class").alias("c"), F.lit(True).alias("own")), F.struct((F.col("class") + 1).alias("c"), F.lit(False).alias("own")))).alias("at"))
    return each.select(F.xxhash64("key.n", "key.v", "at.c").alias("tile"), "fp", F.col("at.own").alias("own"))


def near_links(classes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect the same groups as all links do.

    Tiles are named by a 64-bit hash; two tiles that share a name only make one larger tile, whose pairs are
    compared exactly all the same.
    """
    rows = tile_rows(classes, blocks).repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(_links, "a long, b long")


def groups(prints: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of (doc_id, fp): root names its group, component_id is the group's smallest id."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = near_links(classes.select("fp"), blocks)
    roots = connected_components(links, "a", "b")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest id that links can reach."""
    prints = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    return prints.join(groups(prints, blocks), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group: the one with the smallest id, a row without an id only where no other is there.

    Of rows that repeat this id, the first one read stays. Every column of docs is kept, whatever its name.
    """
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")
    prints = materialize(fingerprints(keyed, "row.doc_id", "row.text", "key"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = prints.join(groups(prints), "fp").groupBy("root").agg(first).select(F.col("first.key").alias("key"))
    return keyed.join(kept, "key", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
