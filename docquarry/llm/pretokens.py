"""Pre-tokens of the two public vocabularies, cut exactly as the tokenizers library cuts them.

The fast path takes texts whose characters all lie in a range on which Python and the library agree about case,
normal form and classes. Any other text, and any text with a special token's string, goes whole through the
library, so results never depend on which path a text took.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the library's patterns; Python's own \s has more.
_S = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters alone are cut here. U+0130 lower-cases to two characters and stays out.
_SAFE = re.compile("[\x00-įı-ɏ‐-‧€]*")
_WORD_END = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_S}\p{{L}}\p{{N}}]+")
_WORD_END_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_BYTE_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BYTE_LEVEL_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def cut_word_end(text: str) -> list[str] | None:
    """Pre-tokens of the lower-casing vocabulary with word ends; None: the library must take this text."""
    if text.isascii():
        return None if "<|" in text else _WORD_END_ASCII.findall(text.lower())
    if "<|" in text or not _SAFE.fullmatch(text):
        return None
    return _WORD_END.findall(text.lower())


def cut_byte_level(text: str) -> list[str] | None:
    """Pre-tokens of the byte-level vocabulary; None: the library must take this text."""
    if text.isascii():
        return None if "<|" in text else _BYTE_LEVEL_ASCII.findall(text)
    if "<|" in text or not _SAFE.fullmatch(text):
        return None
    return _BYTE_LEVEL.findall(text)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TO_LETTERS = {b: c for b, c in byte_letters().items() if chr(b) != c}


def as_letters(piece: str) -> str:
    """A pre-token as the vocabulary spells it."""
    return piece.encode().decode("latin-1").translate(_TO_LETTERS)


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def some_files(docs: DataFrame, text: str, most: int = 8) -> DataFrame:
    """docs, or a table of at most `most` of the Parquet files below it, spread evenly over their names, where these have the text column."""
    files = sorted(docs.inputFiles())
    if len(files) <= most or not all(f.endswith(".parquet") for f in files):
        return docs
    found = docs.sparkSession.read.parquet(*[files[k * len(files) // most] for k in range(most)])
    return found if text in found.columns else docs


def frequent_pretokens(docs: DataFrame, text: str, cut: Callable[[str], list[str] | None], size: int, sample_rows: int) -> list[str]:
    """The most frequent pre-tokens of a sample of about `sample_rows` rows, most frequent first, ties by text.

    This only decides which pre-tokens are looked up in the broadcast tier; results are the same with any list. Rows come from a
    few files with all tasks that these have; each task sends its own `size` most frequent, and the driver gets `size` rows.
    """
    files = some_files(docs, text)
    share = min(1.0, sample_rows / max(files.count(), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(cut(t.as_py()) or ())
            if len(seen) > 20 * size:
                seen = Counter(dict(seen.most_common(4 * size)))
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    sample = files.select(F.col(text).alias("text")).filter("text IS NOT NULL").sample(share, seed=7)
    found = sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in found.orderBy(F.desc("n"), "piece").limit(size).collect()]
