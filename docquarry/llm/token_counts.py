"""Token counts by a two-tier lookup on the map side, with no shuffle of pre-tokens.

Method. A compact table of the lengths, in tokens, of frequent pre-tokens is broadcast: its size is a parameter
(TABLE_SIZE words, about 1 MB), whatever the corpus. A task cuts texts into pre-tokens and sums lengths from
this table; pre-tokens that it lacks are encoded once by the library's model and kept in the worker's own cache,
which is bounded and starts anew when full. Texts outside the fast path's characters, or with a special token's
string, are encoded whole by the library. Rows are never moved: one scan, no exchange.

Defined results. Null is the empty text: 0 bytes, 0 tokens. Repeated rows give repeated results; a null doc_id
stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pretokens import as_letters, cut_word_end, frequent_pretokens, load_tokenizer

TABLE_SIZE = 50_000
SAMPLE_ROWS = 3_000
CACHE_SIZE = 300_000
LIMIT = 2_048


class _Lengths(dict):
    """Frequent lengths, then the worker's cache of the others, in one mapping that encodes what it lacks."""

    def __init__(self, words: list[str], lengths: np.ndarray, model, cache_size: int) -> None:
        super().__init__(zip(words, lengths.tolist()))
        self.fixed, self.model, self.cache_size, self.own = len(words), model, cache_size, []

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(as_letters(piece)))
        if len(self.own) >= self.cache_size:
            for old in self.own:
                del self[old]
            self.own = []
        self.own.append(piece)
        self[piece] = n
        return n


def pack_lengths(words: list[str], model) -> tuple[bytes, np.ndarray]:
    """The broadcast form: words joined by line feeds (no pre-token holds white space) and a byte for each length."""
    keep = [(w, n) for w in words if (n := len(model.tokenize(as_letters(w)))) < 256]
    return "\n".join(w for w, _ in keep).encode(), np.array([n for _, n in keep], dtype=np.uint8)


def count_tokens(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, table_size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS, cache_size: int = CACHE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs."""
    spark = docs.sparkSession
    words = frequent_pretokens(docs, text, cut_word_end, table_size, sample_rows)
    sent = spark.sparkContext.broadcast(pack_lengths(words, load_tokenizer(tokenizer_path).model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer_path)
        blob, lengths = sent.value
        known = _Lengths(blob.decode().split("\n") if len(lengths) else [], lengths, tok.model, cache_size)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                sizes.append(len(t) if t.isascii() else len(t.encode()))
                pieces = cut_word_end(t)
                counts.append(len(tok.encode(t, add_special_tokens=False).ids) if pieces is None else sum(map(known.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
