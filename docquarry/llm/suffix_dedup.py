"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in a smaller document.

Method. Rows with equal texts are folded first: a text is worked on once, under the smallest id that has it. A
string of WIDTH bytes is named by the smallest hash among its GRAM-byte pieces (leftmost on ties), so equal strings
have equal names wherever they stand. Strings that follow each other under one name form a segment; distinct
segments are shuffled by name. A task holds whole name groups, block by block, and suffix-sorts all strings in
them: prefix polynomial hashes give the hash of any substring, a binary search over lengths finds the common
extension of two suffixes, and a merge sort compares suffixes that way, so a comparison costs a logarithm of
WIDTH. Neighbours whose common extension reaches WIDTH are equal; their bytes are compared as well, and a block
with a collision is sorted again by its bytes. Each run of equal strings gives its smallest document to its
segments, segments give it to their places, and places to ranges of bytes of each text.

No result hangs on a hash alone: segments fold only where their bytes are equal, and if two different ones ever had one name
and one print (by which places find their segments), the sort sees them side by side and all is done again with other hashes.

Scale. First only names travel, packed into four bytes each and dealt to shards whose number follows the input. Bytes are
shuffled for names that stand in two texts or more. A name that goes on in very many ways (see VARIED) would make a
group that grows with the input: its segments are cut into single strings, which are dealt by name and print, and equal
ones of which fold before the shuffle. So every group is bounded, and rows stay below the number of bytes of the input. Tasks learn
which names are wanted and which are hot from filters of FILTER_MOST bits at most; what a full filter lets through too much
costs bytes shuffled, never results. Places meet their segments by a join that adaptive execution can split, so a
passage that a third of the corpus holds is split over tasks.

Defined results. Null is the empty text. A null id counts as larger than every id. Rows with equal ids never match
one another; an id's rows with different texts are treated each on its own. Texts shorter than WIDTH lose nothing; very long
ones are cut in pieces that overlap, block by block. An empty table gives an empty result. Any other columns are carried
whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import discard, input_bytes, materialize, table

WIDTH = 50
GRAM = 20
SPAN = WIDTH - GRAM + 1
#: A name is hot, and dealt string by string, if its segments' prints take so many of the 256 values of a byte: about 1,500 different segments.
VARIED = 256
#: Bytes of text that are cut together, and of segments that are sorted together.
BLOCK_BYTES = 1 << 19
#: Names or segments that a task gathers before it sends them, bytes of input for each shard of names, and bits of a filter.
SENT, SHARD_BYTES, FILTER_LEAST, FILTER_MOST = 1 << 19, 1 << 24, 1 << 20, 1 << 28
SALTS = 32
_NONE = (1 << 63) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have, step = 1, 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _both_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, size), _powers(pow(base, -1, 1 << 64), size)


class PrefixHashes:
    """Polynomial hashes, modulo 2**64, of any substring of a buffer in constant time."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]) -> None:
        n = len(data) + 1
        there, back = _both_powers(base, 1 << max(16, (n - 1).bit_length()))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * there[: n - 1], out=self.sums[1:])
        self.back = back[:n]

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Length, up to width, of the longest common prefix of suffixes a[k] and b[k], by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), width, np.int64)
    for _ in range(width.bit_length()):
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(data: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
    n = common_extension(hashes, a, b)
    end = n >= WIDTH
    n = np.minimum(n, WIDTH - 1)
    return np.where(end, or_equal, data[a + n] < data[b + n])


def suffix_sort(data: np.ndarray, hashes: PrefixHashes, at: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Merge sort of suffixes by their first WIDTH bytes, each group for itself; group: ascending numbers. All pairs of
    runs of a level are merged together: each suffix finds its rank in the other run by binary search, with hash
    comparisons."""
    at, run = at.copy(), 1
    if not len(at):
        return at
    group = np.zeros(len(at), np.int64) if group is None else group
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(at)])
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    active = np.arange(len(at))
    while True:
        active = active[size[active] > run]
        if not len(active):
            return at
        begin, end = base[active], base[active] + size[active]
        pair = begin + (active - begin) // (2 * run) * (2 * run)
        left = active - pair < run
        low = np.where(left, np.minimum(pair + run, end), pair)
        high = np.where(left, np.minimum(pair + 2 * run, end), pair + run)
        start = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            # a suffix of the right run goes after its equals in the left one
            is_left = left[open_]
            go = np.empty(len(open_), bool)
            for side in (True, False):
                k = is_left == side
                go[k] = _before(data, hashes, at[middle[k]], at[active[open_[k]]], not side)
            low[open_] = np.where(go, middle + 1, low[open_])
            high[open_] = np.where(go, high[open_], middle)
        own = active - np.where(left, pair, pair + run)
        moved = at[active]
        at[pair + own + low - start] = moved
        run *= 2


def equal_runs(data: np.ndarray, hashes: PrefixHashes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, number of the run of equal strings of each)."""
    order = suffix_sort(data, hashes, at, group)
    if len(order) < 2:
        return order, np.zeros(len(order), np.int64)
    same = (group[1:] == group[:-1]) & (common_extension(hashes, order[:-1], order[1:]) >= WIDTH)
    offsets = np.arange(WIDTH)
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 1 << 16):
        i = pairs[k : k + (1 << 16)]
        if (data[order[i][:, None] + offsets] != data[order[i + 1][:, None] + offsets]).any():  # a collision
            order = np.array(sorted(at.tolist(), key=lambda p: data[p : p + WIDTH].tobytes()), np.int64)  # equal strings are in one group, so groups don't matter here
            same = np.fromiter((np.array_equal(data[p : p + WIDTH], data[q : q + WIDTH]) for p, q in zip(order[:-1], order[1:])), bool, len(order) - 1)
            break
    return order, np.concatenate([[0], np.cumsum(~same)])


class Names:
    """A set of names as a Bloom filter, made of one slice for each shard of names."""

    def __init__(self, bits: np.ndarray, shard_bits: int) -> None:
        self.bits, self.shard_bits, self.slice_bits = bits, shard_bits, (len(bits) * 8 >> shard_bits).bit_length() - 1

    def has(self, names: np.ndarray) -> np.ndarray:
        short = names.view(np.uint64) >> np.uint64(32 - self.shard_bits)
        base = (short >> np.uint64(32)) << np.uint64(self.slice_bits)
        out = np.ones(len(names), bool)
        for place in _places(short, self.slice_bits):
            at = base + place
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _places(short: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = _mix(short + np.uint64(1)), np.uint64((1 << slice_bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _slice_of(short: np.ndarray, slice_bits: int) -> bytes:
    found = np.zeros(1 << (slice_bits - 3), np.uint8)
    for place in _places(short, slice_bits):
        np.bitwise_or.at(found, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return found.tobytes()


def cut_segments(texts: list[bytes], base: int = _BASES[0], wanted: Names | None = None, hot: Names | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Block by block: (text number, start in it, length, name, print, place of the named piece in it, deal, start in the buffer) of segments, and the buffer.

    wanted: only segments of these names. hot: names whose segments are cut into single strings, and dealt by print too.
    """

    def cut(owners: list[int], bases: list[int], parts: list[bytes]) -> tuple:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        hashes = PrefixHashes(data, base)
        value = _mix(hashes.all(GRAM))
        # hash of the smallest piece of each string, by doubling
        smallest, width = value, 1
        while width * 2 <= SPAN:
            smallest, width = np.minimum(smallest[:-width], smallest[width:]), width * 2
        n = len(value) - SPAN + 1
        smallest = np.minimum(smallest[:n], smallest[SPAN - width :][:n])
        whole = np.ones(n, bool)
        for e in ends[:-1]:
            whole[max(0, e - WIDTH + 1) : e] = False
        # the next string has the same piece unless it begins behind that piece, or a smaller one comes in
        breaks = np.flatnonzero(np.r_[True, (smallest[1:] != smallest[:-1]) | (value[: n - 1] == smallest[:-1]) | (whole[1:] != whole[:-1])])
        last = np.r_[breaks[1:], n]
        ok = whole[breaks]
        start, last = breaks[ok], last[ok]
        name = smallest[start].view(np.int64)
        if wanted is not None:
            ok = wanted.has(name)
            start, last, name = start[ok], last[ok], name[ok]
        place, todo = start.copy(), np.flatnonzero(value[start] != name.view(np.uint64))
        while len(todo):
            place[todo] += 1
            todo = todo[value[place[todo]] != name[todo].view(np.uint64)]
        length, mark = last - start - 1 + WIDTH, place - start
        single = np.zeros(len(start), bool)
        if hot is not None and len(start):
            single = hot.has(name)
            times = np.where(single, length - WIDTH + 1, 1)
            each = np.repeat(np.arange(len(start)), times)
            step = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            start, mark, name, single = start[each] + step, mark[each] - step, name[each], single[each]
            length = np.where(single, WIDTH, length[each])
        owner = np.searchsorted(ends, start, side="right")
        local = start - (ends - sizes)[owner] + np.array(bases)[owner]
        prints = _mix(hashes.of(start, length) ^ (length.astype(np.uint64) << np.uint64(56))).view(np.int64)
        return np.array(owners)[owner], local, length, name, prints, mark, np.where(single, name ^ prints, name), start, data

    owners, bases, parts, held = [], [], [], 0
    for k, text in enumerate(texts):
        step = BLOCK_BYTES
        for at in range(0, max(0, len(text) - WIDTH + 1), step):
            part = text[at : at + step + WIDTH - 1]  # pieces overlap, so no string is lost
            owners.append(k), bases.append(at), parts.append(part)
            held += len(part)
            if held >= BLOCK_BYTES:
                yield cut(owners, bases, parts)
                owners, bases, parts, held = [], [], [], 0
    if parts:
        yield cut(owners, bases, parts)


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a batch in parts of about BLOCK_BYTES, so that no worker holds all texts of a batch as Python objects."""
    begin, held, texts = 0, 0, []
    for k, t in enumerate(batch.column(column)):
        texts.append(t.as_py())
        held += len(texts[-1])
        if held >= BLOCK_BYTES:
            yield batch.slice(begin, k + 1 - begin), texts
            begin, held, texts = k + 1, 0, []
    if texts:
        yield batch.slice(begin), texts


def _sent(short: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
    """Ascending shortened names as one row for each shard: the shard, what tells names apart in it, and a byte of each print."""
    shards = (short >> np.uint64(32)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards)]
    low = short.astype(np.uint32)
    parts = list(zip(cuts, cuts[1:]))
    return pa.RecordBatch.from_pydict({"shard": pa.array(shards[cuts[:-1]], pa.int32()), "low": pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), "some": pa.array([some[a:b].tobytes() for a, b in parts], pa.binary())})


_SENT = "shard int, low binary, some binary"


def _filters(names: DataFrame, shard_bits: int, bits: int, often: int, varied: int) -> tuple[Names, Names]:
    """Filters of the names that rows _SENT hold `often` times, and of those that they hold with `varied` different bytes of prints."""
    slice_bits = bits.bit_length() - 1 - shard_bits

    def unite(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint8)) for batch in rows for x, y in zip(batch.column("low"), batch.column("some"))]
        both = np.concatenate([x.astype(np.uint64) << np.uint64(8) | y for x, y in held])
        both.sort()
        low = both >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        times = np.diff(np.r_[first, len(low)])
        kinds = np.add.reduceat(np.r_[True, both[1:] != both[:-1]].astype(np.int64), first)
        short = low[first] | np.uint64(key[0].as_py() << 32)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([key[0].as_py()], pa.int32()), "often": [_slice_of(short[times >= often], slice_bits)], "varied": [_slice_of(short[kinds >= varied], slice_bits)]})

    out = [np.zeros((1 << shard_bits, 1 << (slice_bits - 3)), np.uint8) for _ in range(2)]
    slices = materialize(names.repartition("shard").groupBy("shard").applyInArrow(unite, "shard int, often binary, varied binary"), "slices")
    for r in slices.collect():  # FILTER_MOST bits for each at most
        out[0][r["shard"]], out[1][r["shard"]] = np.frombuffer(bytes(r["often"]), np.uint8), np.frombuffer(bytes(r["varied"]), np.uint8)
    discard(slices)
    return Names(out[0].ravel(), shard_bits), Names(out[1].ravel(), shard_bits)


def _counted(shard_bits: int, base: int):
    """Names of all segments, shortened: once for a text that has a name a few times, as often as it has it otherwise."""
    most_texts, spare = 1 << (32 - shard_bits), np.uint64(32 - shard_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, 0

        def flush() -> pa.RecordBatch:
            each, some = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(each, kind="stable")
            each = each[order]
            first = np.r_[True, each[1:] != each[:-1]]
            times = np.diff(np.r_[np.flatnonzero(first), len(each)])
            keep = first | np.repeat(times > 16, times)
            return _sent(each[keep] >> spare, some[order[keep]])

        for batch in batches:
            for _, texts in _batches(batch, 0):
                for owner, _, _, name, prints, *_ in cut_segments(texts, base):
                    held.append((name.view(np.uint64) >> spare << spare | ((owner + seen) % most_texts).astype(np.uint64), prints.astype(np.uint8)))
                    n += len(name)
                seen += len(texts)
                if n >= SENT or seen >= most_texts:
                    if n:
                        yield flush()
                    held, n, seen = [], 0, 0
        if n:
            yield flush()

    return run


def _shortened(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                short = np.unique(np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(32 - shard_bits))
                yield _sent(short, np.zeros(len(short), np.uint8))

    return run


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of substrings one after the other, and where each begins in them, with the end as a last entry."""
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))], np.r_[0, ends]


def _distinct(base: int, wanted, hot):
    """Rows (deal, seg, least, most) of a task's segments; wanted and hot: broadcast names. seg: the place of the named piece as one
    byte, then the segment. Equal ones fold here, about SENT at a time, so a passage that everyone has leaves a task as few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            deal, prints, ids, length = (np.concatenate(x) for x in zip(*(h[:4] for h in held)))
            data = np.concatenate([h[4] for h in held])
            start = np.cumsum(length) - length
            order, first = _folded(deal, prints, data, start, length)
            least, most = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
            kept = order[first]
            for k in range(0, len(kept), 16_384):
                i = kept[k : k + 16_384]
                raw, offsets = _gathered(data, start[i], length[i])
                seg = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_pydict({"deal": deal[i], "seg": seg, "least": least[k : k + 16_384], "most": most[k : k + 16_384]})

        for batch in batches:
            for rows, texts in _batches(batch, 2):
                ids = np.asarray(rows.column(0))
                for owner, _, length, name, prints, mark, deal, start, data in cut_segments(texts, base, wanted.value, hot.value):
                    if len(owner):
                        raw, at = _gathered(data, start, length)
                        held.append((deal, prints, ids[owner], length + 1, np.insert(raw, at[:-1], mark.astype(np.uint8))))
                        n += len(owner)
                if n >= SENT:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _folded(deal: np.ndarray, prints: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): segments ordered so that equal ones follow each other, and where each distinct one begins. Bytes decide."""
    order = np.lexsort((prints, deal))
    same = (deal[order[1:]] == deal[order[:-1]]) & (prints[order[1:]] == prints[order[:-1]])
    pairs = np.flatnonzero(same)
    for k in range(0, len(pairs), 1 << 15):
        a, b = order[pairs[k : k + (1 << 15)]], order[pairs[k : k + (1 << 15)] + 1]
        even = length[a] == length[b]
        n = np.where(even, length[a], 0)
        (x, at), (y, _) = _gathered(data, start[a], n), _gathered(data, start[b], n)
        differ = np.add.reduceat(np.r_[x != y, False], np.minimum(at[:-1], len(x))) > 0
        same[pairs[k : k + (1 << 15)]] = even & ~differ
    return order, np.flatnonzero(np.r_[True, ~same])


def _places_of(base: int, wanted, hot):
    """Rows (id, key, name, print, at) of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _batches(batch, 2):
                ids, keys = np.asarray(rows.column(0)), np.asarray(rows.column(1))
                for owner, local, _, name, prints, *_ in cut_segments(texts, base, wanted.value, hot.value):
                    yield pa.RecordBatch.from_pydict({"id": ids[owner], "key": keys[owner], "name": name, "print": prints, "at": local})

    return run


#: A row of _solve that only says that two different segments have one name and print.
_CLASH = -1


def _solve(base: int):
    """Rows (deal, seg, least, most) sorted by deal in; (name, print, from, to, doc) out: strings that start at from..to of
    the segment stand in doc, which is smaller than the largest document of the segment."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        deal, least, most = (np.asarray(rows.column(c).combine_chunks()) for c in ("deal", "least", "most"))
        seg = rows.column("seg").combine_chunks()
        seg = pa.concat_arrays(seg.chunks) if isinstance(seg, pa.ChunkedArray) else seg
        offsets = np.frombuffer(seg.buffers()[1], np.int32)[seg.offset : seg.offset + len(seg) + 1].astype(np.int64)
        data = np.frombuffer(seg.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        hashes = PrefixHashes(data, base)

        def print_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return _mix(hashes.of(starts, sizes) ^ (sizes.astype(np.uint64) << np.uint64(56))).view(np.int64)

        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        prints = print_of(starts + 1, sizes - 1)
        order, one = _folded(deal, prints, data, starts, sizes)
        least, most = np.minimum.reduceat(least[order], one), np.maximum.reduceat(most[order], one)
        kept = order[one]
        deal, prints, mark, starts, sizes = deal[kept], prints[kept], data[starts[kept]].astype(np.int64), starts[kept] + 1, sizes[kept] - 1
        clash = ((deal[1:] == deal[:-1]) & (prints[1:] == prints[:-1])).any()
        name = _mix(hashes.of(starts + mark, GRAM)).view(np.int64)
        counts = sizes - WIDTH + 1
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(int(counts.sum())) - first[owner]
        doc = least[owner].copy()
        # equal strings have one name, and their named piece at one place: each such group is sorted for itself
        place = mark[owner] - offset
        some = np.lexsort((place, deal[owner]))
        o, p = owner[some], place[some]
        new = np.r_[True, (deal[o[1:]] != deal[o[:-1]]) | (p[1:] != p[:-1])]
        alone = new & np.r_[new[1:], True]
        some, group = some[~alone], np.cumsum(new)[~alone]
        if len(some):
            at = starts[owner[some]] + offset[some]
            back = np.empty(len(data), np.int32)
            back[at] = some
            ordered, run = equal_runs(data, hashes, at, group)
            window = back[ordered]
            low = np.full(int(run[-1]) + 1, _NONE, np.int64)
            np.minimum.at(low, run, doc[window])
            doc[window] = low[run]
        begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[begin[1:], len(owner)] - 1
        k = doc[begin] < most[owner[begin]]
        begin, end = begin[k], end[k]
        o = owner[begin]
        out = {"name": name[o], "print": prints[o], "from": offset[begin].astype(np.int32), "to": offset[end].astype(np.int32), "doc": doc[begin]}
        if clash:
            out = {c: np.r_[x, np.array([_CLASH], x.dtype)] for c, x in out.items()}
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        weight = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            weight += batch.column("seg").nbytes
            if weight < BLOCK_BYTES:
                continue
            rows = pa.concat_tables(held)
            deal, sizes = np.asarray(rows.column("deal").combine_chunks()), np.cumsum(pa.compute.binary_length(rows.column("seg")).to_numpy())
            done = 0
            # whole deals, about BLOCK_BYTES of them at a time; the last one may go on in the next batch
            ends = np.flatnonzero(deal[1:] != deal[:-1]) + 1
            while len(ends := ends[ends > done]):
                before = int(sizes[done - 1]) if done else 0
                cut = int(ends[min(np.searchsorted(sizes[ends - 1], before + BLOCK_BYTES), len(ends) - 1)])
                yield block(rows.slice(done, cut - done))
                done = cut
            held = [rows.slice(done)]
            weight = held[0].column("seg").nbytes
        if held:
            yield block(pa.concat_tables(held))

    return run


_HITS = "name long, print long, from int, to int, doc long"


def _merge(ranges: list | None, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["from"], r["to"]) for r in ranges or []):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, min(b, n)) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, copy, ranges in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw = text.as_py()
            n = len(raw)
            gone = [(0, n)] if copy.as_py() and n >= WIDTH else _merge(ranges.as_py(), n)
            pieces, at = [], 0
            for a, b in gone:
                pieces.append(raw[at:a])
                at = b
            pieces.append(raw[at:])
            sizes.append(n), removed.append(sum(b - a for a, b in gone)), spans.append(len(gone)), kept.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept) for every row of docs; row holds the other columns of the input, kept the bytes left."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("id"), raw.alias("raw"), F.sha2(raw, 256).alias("sha"))
    # only texts that stand twice or more have a row here, one for each salt, so that a group of copies is dealt to SALTS places
    firsts = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    marked = materialize(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(firsts, ["sha", "salt"], "left").select("row", "id", F.xxhash64("sha").alias("key"), "raw", copy.alias("copy")), "texts")
    may_lose = f"NOT copy AND octet_length(raw) >= {WIDTH}"
    own = marked.filter(may_lose).select("id", "key", "raw")
    for base in _BASES:
        wanted, hot, solved = _found(own, input_bytes(marked), base)
        if not solved.filter(F.col("from") == _CLASH).head(1):
            break
        discard(solved)
    shard_bits = wanted.shard_bits
    send = docs.sparkSession.sparkContext.broadcast
    known, _ = _filters(solved.select("name").mapInArrow(_shortened(shard_bits), _SENT), shard_bits, len(wanted.bits) * 8, 1, VARIED)
    places = own.mapInArrow(_places_of(base, send(known), send(hot)), "id long, key long, name long, print long, at long")
    ranges = places.join(solved, ["name", "print"]).filter("doc < id").select("id", "key", (F.col("at") + F.col("from")).alias("a"), (F.col("at") + F.col("to") + WIDTH).alias("b"))
    ranges = ranges.groupBy("id", "key").agg(F.collect_list(F.struct(F.col("a").alias("from"), F.col("b").alias("to"))).alias("ranges"))
    # written first, so that the shuffle of places is freed before texts are shuffled; copies and short texts have no ranges and stay where they are
    ranges = materialize(ranges, "ranges")
    joined = marked.filter(may_lose).join(ranges, ["id", "key"], "left").select("row", "raw", "copy", "ranges")
    joined = joined.union(marked.filter(f"NOT ({may_lose})").select("row", "raw", "copy", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")))
    return joined.mapInArrow(_cut, StructType([marked.schema["row"], *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept", BinaryType())]))


def _found(own: DataFrame, size: int, base: int) -> tuple[Names, Names, DataFrame]:
    """Names that stand twice or more, those that are hot, and the solved strings of the former. size: bytes of the texts as stored."""
    shard_bits = min(16, max(4, (size // SHARD_BYTES).bit_length()))
    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (size // 2).bit_length()))
    wanted, hot = _filters(own.select("raw").mapInArrow(_counted(shard_bits, base), _SENT), shard_bits, bits, 2, VARIED)
    send = own.sparkSession.sparkContext.broadcast
    segments = own.mapInArrow(_distinct(base, send(wanted), send(hot)), "deal long, seg binary, least long, most long")
    dealt = segments.repartition("deal").sortWithinPartitions("deal")
    return wanted, hot, materialize(dealt.mapInArrow(_solve(base), _HITS), "solved")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text; a character that a removal cuts in two goes whole. n_chars, if there, follows."""
    found = remove_repeats(docs)
    left = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.try_validate_utf8(F.col("kept")))
    left = F.coalesce(left, F.regexp_replace(F.make_valid_utf8("kept"), "�", ""))
    out = found.withColumn("_left", left)
    pick = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[(pick[c] if c in pick else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
