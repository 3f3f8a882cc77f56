"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Method. Frequent words are compiled, in sorted order, into a minimal acyclic automaton: states with equal futures
are one state, so suffixes are shared. Arcs carry how many words go before them; the sum along a word's path is its
index, and the index names its ids. The automaton is packed into flat arrays (state base + byte -> slot), which
the workers of an executor memory-map from one file. The distinct pre-tokens of a batch walk it together, one byte at a time, as numpy
arrays. Words that it does not accept are merged exactly by the library's model and kept in a bounded cache.
Decoding joins the bytes of the ids. One scan, no exchange; the lexicon's size is a parameter.

Defined results. Null is the empty text: no ids. Repeated rows give repeated results; a null doc_id stays null; an
empty table gives an empty result. encode() adds columns to whatever columns there are; a column that has
the name of one that it adds is replaced in the result.
"""

from __future__ import annotations

import hashlib
import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import send_file, table
from .pretokens import as_letters, byte_letters, cut_byte_level, frequent_pretokens, load_tokenizer

LEXICON_SIZE = 40_000
SAMPLE_ROWS = 3_000
CACHE_SIZE = 200_000
#: Characters of text that are encoded together; bounds a worker's memory.
CHUNK = 2_000_000


class Lexicon:
    """A minimal acyclic automaton over bytes that numbers its words in sorted order, and the ids of each."""

    NAMES = ("base", "check", "target", "before", "final", "offsets", "ids")
    #: Places that are tried together for a state's arcs.
    STEP = 256

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Incremental construction from sorted words: what a new word can't change is frozen and shared."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        frozen: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, byte, child

        def freeze(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (final[child], tuple(sorted(arcs[child].items())))
                same = frozen.setdefault(key, child)
                arcs[parent][byte] = same

        words, last = sorted(w for w in entries if w), b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            freeze(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            last = word
        freeze(0)
        number = {0: 0} | {s: i + 1 for i, s in enumerate(frozen.values())}
        below: dict[int, int] = {}
        for s in [*frozen.values(), 0]:  # children are frozen before their parents
            below[s] = int(final[s]) + sum(below[c] for c in arcs[s].values())
        return cls._pack(arcs, final, number, below, [entries[w] for w in words])

    @classmethod
    def _pack(cls, arcs, final, number, below, ids) -> Lexicon:
        size = sum(len(arcs[s]) for s in number) * 2 + 1024
        check, target, before = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        base, ends = np.zeros(len(number), np.int32), np.zeros(len(number), bool)
        cursor, arity = 0, -1
        for s in sorted(number, key=lambda s: -len(arcs[s])):  # full states first, single arcs fill the gaps
            n, ends[number[s]] = number[s], final[s]
            if not arcs[s]:
                continue
            labels = sorted(arcs[s])
            if len(labels) != arity:
                cursor, arity = 0, len(labels)
            at = -1
            while at < 0:
                while cursor + 256 + cls.STEP >= len(check):
                    check, target, before = (np.concatenate([a, np.full(len(a), fill, np.int32)]) for a, fill in ((check, -1), (target, 0), (before, 0)))
                fits = np.ones(cls.STEP, bool)
                for byte in labels:
                    fits &= check[cursor + byte : cursor + byte + cls.STEP] == -1
                if fits.any():
                    at = cursor = cursor + int(fits.argmax())
                else:
                    cursor += cls.STEP
            base[n] = at
            passed = int(final[s])
            for byte in labels:
                child = arcs[s][byte]
                check[at + byte], target[at + byte], before[at + byte] = n, number[child], passed
                passed += below[child]
        used = int(base.max(initial=0)) + 257
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = np.array([i for x in ids for i in x], np.uint32)
        return cls(base=base, check=check[:used], target=target[:used], before=before[:used], final=ends, offsets=offsets, ids=flat)

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n)) for n in self.NAMES]
        head = np.array([x for p in parts for x in (ord(p.dtype.char), len(p))], np.int64)
        return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Memory-maps a dump, so that the workers of an executor share its pages."""
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(view, np.int64, 2 * len(cls.NAMES))
        at, arrays = head.nbytes, {}
        for name, kind, n in zip(cls.NAMES, head[::2].tolist(), head[1::2].tolist()):
            arrays[name] = np.frombuffer(view, np.dtype(chr(kind)), n, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(**arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where the automaton does not accept it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        blob = np.frombuffer(b"".join(words), np.uint8)
        index, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        out = np.full(len(words), -1, np.int64)
        live, depth = np.flatnonzero(lengths > 0), 0
        while len(live):
            slot = self.base[state[live]] + blob[starts[live] + depth]
            ok = self.check[slot] == state[live]
            live, slot = live[ok], slot[ok]
            index[live] += self.before[slot]
            state[live] = self.target[slot]
            depth += 1
            ended = lengths[live] == depth
            done = live[ended]
            out[done] = np.where(self.final[state[done]], index[done], -1)
            live = live[~ended]
        return out


def token_bytes(tok) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens stand for their own strings."""
    of = {c: b for b, c in byte_letters().items()}
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    for token, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = special[i].encode() if i in special else bytes(of[c] for c in token)
    return out


class Codec:
    """Encodes and decodes texts in one worker."""

    def __init__(self, tokenizer_path: str, lexicon: Lexicon, cache_size: int = CACHE_SIZE) -> None:
        self.tok = load_tokenizer(tokenizer_path)
        self.model, self.lexicon, self.cache_size = self.tok.model, lexicon, cache_size
        self.bytes_of, self.cache = token_bytes(self.tok), {}

    def merged(self, piece: str) -> np.ndarray:
        """Ids of a word that the lexicon lacks."""
        ids = self.cache.get(piece)
        if ids is None:
            ids = np.array([t.id for t in self.model.tokenize(as_letters(piece))], np.uint32)
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The distinct pre-tokens of all the texts are looked up together."""
        seen: dict[str, int] = {}
        cut = []
        for t in texts:
            pieces = cut_byte_level(t)
            cut.append(None if pieces is None else np.array([seen.setdefault(p, len(seen)) for p in pieces], np.int64))
        words = list(seen)
        index = self.lexicon.find([w.encode() for w in words])
        known, rest = index >= 0, np.flatnonzero(index < 0).tolist()
        extra = [self.merged(words[i]) for i in rest]
        # one flat table: the lexicon's ids, then those of the merged words
        flat = np.concatenate([self.lexicon.ids, *extra]) if extra else self.lexicon.ids
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = index[known]
        start[known], size[known] = self.lexicon.offsets[at], self.lexicon.offsets[at + 1] - self.lexicon.offsets[at]
        if rest:
            size[rest] = [len(x) for x in extra]
            start[rest] = len(self.lexicon.ids) + np.cumsum(size[rest]) - size[rest]
        out = []
        for t, pieces in zip(texts, cut):
            if pieces is None:
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            n = size[pieces]
            before = np.cumsum(n) - n
            out.append(flat[np.arange(int(n.sum())) + np.repeat(start[pieces] - before, n)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


def build_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text", size: int = LEXICON_SIZE, sample_rows: int = SAMPLE_ROWS) -> bytes:
    """The packed lexicon of the most frequent words of a bounded sample; any lexicon gives the same results."""
    model = load_tokenizer(tokenizer_path).model
    words = frequent_pretokens(docs, text, cut_byte_level, size, sample_rows)
    return Lexicon.build({w.encode(): [t.id for t in model.tokenize(as_letters(w))] for w in words}).dump()


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in groups of about CHUNK characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _map_texts(docs: DataFrame, tokenizer_path: str, text: str, column: Column, schema: str, fields, **options) -> DataFrame:
    """A column of docs as `kept`, and what fields() gives of the texts."""
    lexicon = send_file(docs.sparkSession, "lexicon", build_lexicon(docs, tokenizer_path, text, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path, Lexicon.mapped(SparkFiles.get(lexicon)))
        for batch in batches:
            done = 0
            for group in _groups([t.as_py() or "" for t in batch.column(batch.num_columns - 1)]):
                rows = batch.slice(done, len(group))
                done += len(group)
                arrays, names = fields(codec, codec.encode(group))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *arrays], names=[*rows.schema.names[:-1], *names])

    kept = docs.select(column.alias("kept"), F.col(f"`{text}`").alias("text"))
    return kept.mapInArrow(run, StructType([kept.schema["kept"], *StructType.fromDDL(schema).fields]))


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", **options) -> DataFrame:
    """Every row of docs without its text, with n_tokens, ids (array) and decoded, the text that the ids give back."""
    added = {"n_tokens", "ids", "decoded"}
    columns = [c for c in docs.columns if c != text and c not in added]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0)

    def fields(codec: Codec, ids: list[np.ndarray]):
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([codec.decode(x).decode() for x in ids], pa.string())], ["n_tokens", "ids", "decoded"]

    out = _map_texts(docs, tokenizer_path, text, kept, "n_tokens long, ids array<int>, decoded string", fields, **options)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in columns], *sorted(added, key=out.columns.index))


def encode_digests(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs."""

    def fields(codec: Codec, ids: list[np.ndarray]):
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([digest(x.astype("<u4").tobytes()) for x in ids]), pa.array([digest(codec.decode(x)) for x in ids])], ["n_tokens", "ids_sha256", "decoded_sha256"]

    return _map_texts(docs, tokenizer_path, text, F.col(f"`{doc_id}`").cast("long"), "n_tokens long, ids_sha256 string, decoded_sha256 string", fields, **options).withColumnRenamed("kept", "doc_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
