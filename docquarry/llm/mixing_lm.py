"""LM scoring: online logistic mixing of hashed-context bit predictors, with a smoothed unigram score beside it.

What is scored. A text is its tokens, as the base score has them: lower-cased words, then one end. Words are joined by a
blank and the end is a line end, and the bytes of that string are predicted bit by bit, in the bits of Huffman codes of
the training bytes, one for each byte before, so that common letters take few predictions. score = -bits * log10(2); bits per byte is by bytes of the text.

Method. Four predictors look up the bits that followed the same context in the training texts: the last two, four and six bytes,
and the word so far with the two words before it. A context and the node of the code tree are hashed to a
slot, whose log-odds go into a logistic mixer. The mixer's weights are gated by which of the two long contexts have been
seen. A table then refines the mixed probability by what came true after like predictions in training, and both are averaged. While
a text is scored, its weights learn from it, STEP bits at a time, from the trained state on; the next text starts afresh
(so does each PIECE of a very long text), so a score depends on the text and the model alone.

Copies. Texts are grouped by their bytes first, in the tasks before they are moved, and written with the number of training rows
that hold them. Word counts, learning and scoring take each distinct text once, and rows find their text's score by its SHA-256.

Learning. Every training row is learned from. Texts are dealt to learners by a hash of their content, and a learner takes them in order of that
hash, so the model depends on the texts and not on how rows are dealt, read or estimated. A learner takes
a text once, with the number of its copies. The number of learners follows the summed length of the training texts: one for LEARNER_BYTES, at most
MOST_LEARNERS. A learner predicts each block of texts with the counts of the blocks before it, learns weights and refinement from that (a Newton
step), and then counts the block, each text as often as it has copies. Counts of learners are added slice by slice,
weights are averaged by the bits that each gate had, refinement counts are added. The slots of the long contexts follow the same length
(SLOT_BYTES of text for each, up to 2**MOST_BITS for a predictor, which is what a worker can hold); what tasks get is a byte
for each slot. Above that bound slots are shared by more contexts, and the word counts, a distributed table, go on growing.

Unigram score: sum of log10((c + 1) / (N + V + 1)) over tokens, counts from training rows. Words fold in the tasks before
they are counted. The FREQUENT most frequent words' counts are sent to the tasks, so only rare words of a text are rows of a join.

Defined results. Null is the empty text: one end token. A null id is never held out. Repeated rows are counted and scored
each. Very long texts go piece by piece, LEAD bytes of context before each. Without training rows every bit costs one bit. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_bucket, materialize, table
from .suffix_dedup import PrefixHashes, _mix

FOLDS, HELD_OUT = 7, 2
PREDICTORS, GATES = 4, 3
#: Bytes of training text for a learner, and learners at most.
LEARNER_BYTES, MOST_LEARNERS = 32 << 20, 4_096
#: Slots of a predictor in powers of two: one for so many bytes of training text, and at most these; fewer for short contexts.
SLOT_BYTES, LEAST_BITS, MOST_BITS = 1, 12, 22
FEWER = (6, 1, 0, 0)
#: Slots of all predictors that are added together.
SLICE = 1 << 16
#: A count of nothing, the log-odds that a byte holds as one, and their bound.
PRIOR, UNIT, BOUND = 0.2, 1 / 16, 127
#: A gate's first weights, how far they go for a bit, and the weight of the refinement's start.
START, RATE, HOLD = 0.35, 0.003, 400.0
#: What a block's curvature still counts in the next block.
KEEP = 0.9
BUCKETS, WIDEST = 49, 12.0
STEP = 256
#: Bytes of a piece of text, of context before it, and of pieces that are worked on together.
PIECE, LEAD, BLOCK = 1 << 13, 96, 1 << 17
FREQUENT, FREQUENT_LENGTH = 1 << 16, 64
#: Bytes of texts whose copies fold together before they are moved.
COPIES_BYTES = 64 << 20
END = "\n"


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The (node, bit) steps from the root of a Huffman tree to each symbol."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, n = {}, len(counts)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n, n))
        n += 1
    paths = []
    for i in range(len(counts)):
        path, at = [], i
        while at in parent:
            at, bit = parent[at]
            path.append((at, bit))
        paths.append(path[::-1])
    return paths


@dataclass
class Code:
    """Huffman codes of bytes, one for each byte before: where the steps of (byte before, byte) begin, and their nodes and bits."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        paths = [path for row in counts for path in huffman(row)]
        flat = np.array([step for path in paths for step in path])
        return cls(np.cumsum([0, *map(len, paths)]), flat[:, 0].astype(np.uint32), flat[:, 1].astype(np.uint8))


def token_text(raw: bytes) -> bytes:
    """The tokens of a text as one string."""
    return b" ".join(raw.lower().split()) + END.encode()  # bytes: both touch ASCII only


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Blocks of (text number, context and piece, bytes of context)."""
    block, held = [], 0
    for k, raw in enumerate(texts):
        text = token_text(raw)
        for s in range(0, len(text), PIECE):
            lead = min(s, LEAD)
            block.append((k, text[s - lead : s + PIECE], lead))
            held += len(block[-1][1])
            if held >= BLOCK:
                yield block
                block, held = [], 0
    if block:
        yield block


def contexts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The hashed context of each predictor at every byte of pieces that begin at starts."""
    first = np.zeros(len(data), bool)
    first[starts] = True
    blank = (data == 32) | (data == 10)
    opens = first.copy()
    opens[1:] |= blank[:-1]
    at = np.flatnonzero(opens)
    word = np.cumsum(opens) - 1
    hashes = PrefixHashes(data)
    place = np.arange(len(data))
    prefix = hashes.of(at[word], place - at[word])
    whole = hashes.of(at, np.diff(np.r_[at, len(data)]))
    head = first[at]
    before = np.r_[np.uint64(0), whole[:-1]]
    before[head] = 0
    second = np.r_[np.uint64(0), before[:-1]]
    second[head] = 0
    m = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    found, last, since = {}, np.zeros(len(data), np.uint64), place - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    value = data.astype(np.uint64) + np.uint64(1)
    for k in range(1, 7):
        last = last * np.uint64(257)
        last[k:] += value[:-k] * (since[k:] >= k)
        found[k] = last
    words = prefix + (before * m[0] + second * m[1])[word]
    return [(_mix(x + np.uint64(k + 1) * m[2]) >> np.uint64(32)).astype(np.uint32) for k, x in enumerate((found[2], found[4], found[6], words))]


def slot_bits(bits: int) -> list[int]:
    """Bits of each predictor's slots."""
    return [max(LEAST_BITS, bits - f) for f in FEWER]


def slot_starts(bits: int) -> list[int]:
    """First slot of each predictor, and the number of all."""
    return np.cumsum([0, *(1 << b for b in slot_bits(bits))]).tolist()


def flattened(block: list[tuple[int, bytes, int]], code: Code, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(bit, slots of each predictor, number of bits of each piece) of a block."""
    sizes = np.array([len(p) for _, p, _ in block])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(p for _, p, _ in block), np.uint8)
    found = contexts(data, starts)
    coded = np.ones(len(data), bool)
    for s, (_, _, lead) in zip(starts, block):
        coded[s : s + lead] = False
    at = np.flatnonzero(coded)
    before = np.r_[np.uint8(10), data[:-1]]
    before[starts] = 10
    pair = before[at].astype(np.intp) << 8 | data[at]
    begin = code.start[pair]
    n = code.start[pair + 1] - begin
    ends = np.cumsum(n)
    pick = np.arange(int(ends[-1])) + np.repeat(begin - (ends - n), n)
    spread = code.node[pick] * np.uint32(0x9E3779B1)
    byte = np.repeat(at, n)
    slots = []
    for context, b, start in zip(found, slot_bits(bits), slot_starts(bits)):
        h = (context.take(byte) + spread) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        slots.append((h >> np.uint32(32 - b)).astype(np.intp) + start)
    owner = np.searchsorted(starts, at, side="right") - 1
    return code.bit[pick], slots, np.bincount(owner, n, len(block)).astype(np.int64)


@dataclass
class State:
    """What the mixer has learned: weights of each gate, and the refinement table's counts of ones and of all."""

    weights: np.ndarray
    ones: np.ndarray
    seen: np.ndarray

    @classmethod
    def fresh(cls) -> State:
        return cls(np.full((GATES, PREDICTORS), START, np.float32), np.zeros(BUCKETS), np.zeros(BUCKETS))

    def __post_init__(self) -> None:
        centre = 1 / (1 + np.exp(-np.linspace(-WIDEST, WIDEST, BUCKETS)))
        self.refined = ((self.ones + HOLD * centre) / (self.seen + HOLD)).astype(np.float32)


def gates_of(inputs: np.ndarray) -> np.ndarray:
    """0: neither long context has been seen; 1: the last six bytes have; 2: the words have."""
    return np.where(inputs[3] != 0, np.int8(2), (inputs[2] != 0).astype(np.int8))


def bucket_of(z: np.ndarray) -> np.ndarray:
    return np.rint((z + np.float32(WIDEST)) * np.float32((BUCKETS - 1) / (2 * WIDEST))).astype(np.intp)


def mixed(bit: np.ndarray, inputs: np.ndarray, sizes: np.ndarray, state: State) -> np.ndarray:
    """Cost in bits of each piece; every piece starts from state and learns as it goes.

    inputs has a row for each predictor. Pieces are cut into chunks of STEP bits, the last one filled up with nothing; the
    k-th chunks of all pieces are worked on together, each with its own piece's weights.
    """
    gate = gates_of(inputs)
    first = np.cumsum(sizes) - sizes
    chunks = -(-sizes // STEP)
    chunk = np.cumsum(chunks) - chunks
    place = np.arange(len(bit)) + np.repeat(chunk * STEP - first, sizes)
    n = int(chunks.sum())
    true, x = np.zeros(n * STEP, np.float32), np.zeros((n, GATES * PREDICTORS, STEP), np.float32)
    true[place] = bit
    # a bit's inputs stand in the rows of its gate, the other gates' rows are zero
    cell = place // STEP * (GATES * PREDICTORS * STEP) + place % STEP + gate.astype(np.intp) * (PREDICTORS * STEP)
    for k in range(PREDICTORS):
        x.ravel()[cell + k * STEP] = inputs[k]
    true, z = true.reshape(n, STEP), np.zeros((n, STEP), np.float32)
    weights = np.tile(state.weights.ravel(), (len(sizes), 1))
    order = np.argsort(-chunks, kind="stable")
    for k in range(int(chunks.max(initial=0))):
        order = order[chunks[order] > k]
        now = chunk[order] + k
        xs = x[now]
        z[now] = zs = np.clip(np.matmul(weights[order][:, None, :], xs)[:, 0], -WIDEST, WIDEST)
        miss = true[now] - 1 / (1 + np.exp(-zs))
        weights[order] += np.float32(RATE) * np.matmul(xs, miss[:, :, None])[:, :, 0]
    z = z.ravel()[place]
    p = (1 / (1 + np.exp(-z)) + state.refined[bucket_of(z)]) / 2
    paid = np.log2(np.where(bit > 0, p, 1 - p))
    return -np.add.reduceat(np.r_[paid.astype(np.float64), 0.0], first) * (sizes > 0)


class Learner:
    """Counts and mixer of the texts of one share."""

    def __init__(self, code: Code, bits: int) -> None:
        self.code, self.bits = code, bits
        self.counts = np.zeros(2 * slot_starts(bits)[-1], np.uint32)
        self.state, self.gated = State.fresh(), np.zeros(GATES)
        self.sums = np.zeros((GATES, PREDICTORS))
        self.curved = np.zeros((GATES, PREDICTORS, PREDICTORS))

    def learn(self, texts: list[bytes], copies: list[int] | None = None) -> None:
        many = copies is not None and max(copies, default=1) > 1
        for block in _pieces(texts):
            bit, slots, sizes = flattened(block, self.code, self.bits)
            pairs = self.counts.view(np.uint64)
            inputs = np.empty((PREDICTORS, len(bit)), np.float32)
            for k, s in enumerate(slots):
                both = pairs[s]
                ones = (both >> np.uint64(32)).astype(np.uint32).astype(np.float32) + np.float32(PRIOR)
                inputs[k] = np.log(ones / (both.astype(np.uint32).astype(np.float32) + np.float32(PRIOR)))
            np.clip(inputs, -BOUND * UNIT, BOUND * UNIT, out=inputs)
            times = np.repeat(np.array([copies[k] for k, _, _ in block], np.uint32), sizes) if many else np.uint32(1)
            self.mix(bit, inputs, times)
            # of the table's type, which is the fast way
            for s in slots:
                np.add.at(self.counts, s * 2 + bit, times)

    def mix(self, bit: np.ndarray, inputs: np.ndarray, times: np.ndarray | np.uint32 = np.uint32(1)) -> None:
        """Learns from a block: one step of each gate's weights, scaled by how curved its loss is, and the refinement's counts, for each bit as often as given."""
        gate, z = gates_of(inputs), np.empty(len(bit), np.float32)
        counted = lambda what, n, own: np.bincount(what, minlength=n) if own.ndim == 0 else np.bincount(what, own, n).astype(np.int64)
        gated = counted(gate, GATES, times)
        for g in np.flatnonzero(gated):
            at = np.flatnonzero(gate == g)
            x, weights = np.stack([row.take(at) for row in inputs]), self.state.weights[g]
            z[at] = zs = np.clip(weights @ x, -WIDEST, WIDEST)
            p = 1 / (1 + np.exp(-zs))
            self.curved[g] = KEEP * self.curved[g] + np.array([[a @ b for b in x] for a in x * (p * (1 - p))])
            step = np.linalg.solve(self.curved[g] + np.eye(PREDICTORS), x @ (bit[at] - p))
            self.state.weights[g] = np.clip(weights + step, -4, 4)
        self.gated += gated
        self.sums += self.state.weights * gated[:, None]
        bucket = bucket_of(z)
        self.state.seen += counted(bucket, BUCKETS, times)
        self.state.ones += counted(bucket[bit > 0], BUCKETS, times if times.ndim == 0 else times[bit > 0])

    def parts(self, learner: int = 0) -> Iterator[pa.RecordBatch]:
        """The counts slice by slice, and the mixer as slice -1."""
        mixer = np.concatenate([self.gated, self.sums.ravel(), self.state.ones, self.state.seen])
        yield _row(-1, learner, mixer)
        for k in range(0, len(self.counts) // 2, SLICE):
            part = self.counts[2 * k : 2 * (k + SLICE)]
            if part.any():
                yield _row(k // SLICE, learner, part)


def _row(k: int, learner: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "learner": pa.array([learner], pa.int32()), "blob": pa.array([zlib.compress(values.tobytes(), 1)], pa.binary())})


def _united(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's counts added and turned into bytes of log-odds; the mixers' sums added in order of the learners, as sums of doubles depend on it."""
    k, total, mixers = key[0].as_py(), 0, {}
    for batch in rows:
        for learner, blob in zip(batch.column("learner").to_pylist(), batch.column("blob")):
            raw = zlib.decompress(blob.as_py())
            if k < 0:
                mixers[learner] = np.frombuffer(raw, np.float64)
            else:
                total = total + np.frombuffer(raw, np.uint32).astype(np.int64)
    for learner in sorted(mixers):
        total = total + mixers[learner]
    if k >= 0:
        total = np.rint(np.clip(np.log((total[1::2] + PRIOR) / (total[::2] + PRIOR)) / UNIT, -BOUND, BOUND)).astype(np.int8)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Model:
    code: Code
    bits: int
    odds: np.ndarray
    state: State

    def cost(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text costs."""
        out = np.zeros(len(texts))
        for block in _pieces(texts):
            bit, slots, sizes = flattened(block, self.code, self.bits)
            cost = mixed(bit, np.stack([self.odds[s] for s in slots]) * np.float32(UNIT), sizes, self.state)
            np.add.at(out, [k for k, _, _ in block], cost)
        return out


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _held_out(doc_id: str) -> Column:
    return F.coalesce(id_bucket(F.col(doc_id), FOLDS) == HELD_OUT, F.lit(False))


def _texts(column: pa.Array, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Texts of a batch in lists of about `most` bytes."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts, each text's as often as it has copies (second column, if there is one), folded about a million at a time."""
    seen: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words = [*seen.items()]
        for k in range(0, len(words), 65_536):
            w, n = zip(*words[k : k + 65_536])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["token", "n"])
        seen.clear()

    for batch in batches:
        done = 0
        copies = batch.column(1).to_pylist() if batch.num_columns > 1 else [1] * batch.num_rows
        for texts in _texts(batch.column(0)):
            for t, n in zip(texts, copies[done:]):
                if n == 1:
                    seen.update(t.lower().split())
                else:
                    for w, k in Counter(t.lower().split()).items():
                        seen[w] += k * n
            seen[END.encode()] += sum(copies[done : done + len(texts)])
            done += len(texts)
            if len(seen) > 500_000:
                yield from flush()
    yield from flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """(token, c) of training rows (raw), or of distinct texts and their copies (raw, n)."""
    return rows.mapInArrow(_folded, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def pair_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte follows each in the training texts' tokens, from the word counts: a blank comes before and after a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = np.frombuffer(b" " + token + b" ", np.uint8).astype(np.intp)
                np.add.at(total, text[:-1] << 8 | text[1:], np.int64(c))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(1 << 16, np.int64)
    for r in counts.select("token", "c").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task with their copies, folded about COPIES_BYTES at a time."""
    for batch in batches:
        for texts in _texts(batch.column(0), COPIES_BYTES):
            seen = Counter(texts)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["raw", "n"])


def train(rows: DataFrame, code: Code, size: int) -> Model:
    """A model of all training rows (raw), or of distinct texts and their copies (raw, n); size: the summed length of the texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, (size // SLOT_BYTES).bit_length()))
    n = max(1, min(MOST_LEARNERS, -(-size // LEARNER_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, number, held, copies, room = None, None, [], [], 0
        for batch in batches:
            for raw, times, own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = raw.as_py()
                if held and own == number and held[-1] == raw:
                    copies[-1] += times
                    continue
                if held and (own != number or room >= 1 << 22):
                    learner.learn(held, copies)
                    held, copies, room = [], [], 0
                if own != number:
                    if learner is not None:
                        yield from learner.parts(number)
                    learner, number = Learner(code, bits), own
                held.append(raw)
                copies.append(times)
                room += len(raw)
        if held:
            learner.learn(held, copies)
        if learner is not None:
            yield from learner.parts(number)

    folded = rows if "n" in rows.columns else rows.mapInArrow(_copies, "raw binary, n long")
    hashed = folded.withColumn("hash", F.xxhash64("raw"))
    dealt = hashed.withColumn("learner", F.pmod("hash", F.lit(n)).cast("int")).repartitionById(n, F.col("learner")).sortWithinPartitions("learner", "hash", "raw")
    learned = dealt.select("raw", "n", "learner").mapInArrow(run, "slice int, learner int, blob binary")
    slices = materialize(learned.repartition("slice").groupBy("slice").applyInArrow(_united, "slice int, blob binary"), "slices")
    odds, state = np.zeros(slot_starts(bits)[-1], np.int8), State.fresh()
    for r in slices.collect():  # a byte for each slot
        if r["slice"] >= 0:
            odds[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(bytes(r["blob"]), np.int8)
            continue
        gated, sums, ones, seen = np.split(np.frombuffer(bytes(r["blob"])), np.cumsum([GATES, GATES * PREDICTORS, BUCKETS]))
        weights = np.where(gated[:, None] > 0, sums.reshape(GATES, PREDICTORS) / np.maximum(gated, 1)[:, None], START)
        state = State(weights.astype(np.float32), ones, seen)
    discard(slices)
    return Model(code, bits, odds, state)


_SCORED = "digest binary, n_bytes long, bits double, n_tokens long, n_known long, base double, rare array<struct<token:binary,n:long>>"


def _scored(model, frequent):
    """A row for each text: its cost, what its frequent words add to the base score, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            done = 0
            for texts in _texts(batch.column(1)):
                digests = batch.column(0).slice(done, len(texts))
                done += len(texts)
                tokens, sure, base, rare = [], [], [], []
                for t in texts:
                    found = Counter(t.lower().split())
                    found[END.encode()] = 1
                    unknown = [{"token": w, "n": n} for w, n in found.items() if w not in known]
                    tokens.append(found.total())
                    sure.append(tokens[-1] - sum(r["n"] for r in unknown))
                    base.append(math.fsum(n * known[w] for w, n in found.items() if w in known))
                    rare.append(unknown)
                made = [pa.array([len(t) for t in texts], pa.int64()), pa.array(model.value.cost(texts)), pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([digests, *made], names=["digest", "n_bytes", "bits", "n_tokens", "n_known", "base", "rare"])

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _held_out(doc_id).alias("held_out"), _raw(text).alias("raw"))
    texts = materialize(rows.groupBy("raw").agg(F.count_if(~F.col("held_out")).alias("n")), "texts")
    training = texts.filter("n > 0")
    counts = materialize(word_counts(training), "counts")
    total, distinct, size = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.col("c") * (F.octet_length("token") + 1))).first())
    most = counts.filter(F.octet_length("token") <= FREQUENT_LENGTH).orderBy(F.desc("c"), "token").limit(FREQUENT)
    send = docs.sparkSession.sparkContext.broadcast
    frequent = send({bytes(r["token"]): math.log10((r["c"] + 1) / (total + distinct + 1)) for r in most.collect()})
    model = send(train(training, Code.of(pair_counts(counts)), size))
    digest = F.unhex(F.sha2("raw", 256)).alias("digest")
    scored = materialize(texts.select(digest, "raw").mapInArrow(_scored(model, frequent), _SCORED).withColumn("key", F.monotonically_increasing_id()), "scored")
    pairs = scored.select("key", F.explode("rare").alias("r")).select("key", "r.token", "r.n")
    c = F.coalesce("c", F.lit(0))
    found = pairs.join(counts, "token", "left").groupBy("key").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("rest"))
    whole = rows.select("doc_id", "held_out", digest).join(scored.drop("rare").join(found, "key", "left"), "digest")
    discard(texts)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("bits") * -math.log10(2)).alias("score"), F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
