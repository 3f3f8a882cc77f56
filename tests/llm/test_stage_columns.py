"""Every stage of the pipeline over columns with clashing names, and over null, empty and repeated rows: all values come through."""

from collections import Counter

import public_tokenizers
import pytest

from docquarry.llm import bpe, line_crf, mixing, simhash, suffix_dedup

NAMES = ["_row", "_key", "_times", "_copy", "row", "key", "times", "kept", "__text_to_encode", "a.b", "p", "size"]
GOOD = "Plain words make a good line of text here and there.\n"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, GOOD + "one two three four", "s1"), (1, GOOD + "one two three four", "s1"), (2, None, None), (3, "", "s2"), (None, "some other words entirely " * 9, "s1"), (None, None, "s2"), (7, "x" * 5000, "s3")]
    rows = [(i, t, "en", s, None, *[f"{n}{k}" for n in NAMES]) for k, (i, t, s) in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, shape)


def values(frame, leave=()):
    return Counter(tuple(v for c, v in zip(frame.columns, r) if c not in leave) for r in frame.collect())


def test_quality(docs):
    class Always:
        def score(self, texts):
            import numpy as np

            return np.array([0.0 if t is None else 1.0 for t in texts])

    found = line_crf.keep_good(docs, Always())
    assert found.schema == docs.schema and values(found) == values(docs.filter("text IS NOT NULL"))


def test_near_duplicates_and_repeats(docs):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and not values(kept) - values(docs)
    cut = suffix_dedup.without_repeats(docs)
    changing = ("text", "n_chars")
    assert cut.columns == docs.columns and values(cut, changing) == values(docs, changing)


def test_mix(docs):
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    rows, originals = values(found), values(docs)
    assert rows and set(rows) <= set(originals) and all(r[1] for r in rows)
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).filter("size > 0 AND doc_id = 7").collect()}
    assert sum(n for r, n in rows.items() if r[0] == 7) == times[7]


def test_tokens(docs):
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert found.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids", "decoded"]
    assert values(found, ("n_tokens", "ids", "decoded")) == values(docs, ("text",))
    assert Counter(r["decoded"] for r in found.collect()) == Counter(r["text"] or "" for r in docs.collect())
