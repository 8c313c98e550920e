"""Token counts against the library on whole texts; the two tiers against plain counting."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece

from hallwatch.llm import token_counts
from odd_rows import SCHEMA, documents, frame, odd, prose  # noqa: F401


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


def want(library, rows):
    return sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows), key=repr)


def nasty():
    return [(100 + k, t) for k, t in enumerate(["a  b", " ", "   ", "\n", "\n\n a", "x\n \ny ", "▁", "a ▁b▁c", "▁ ▁", "<s></s> <unk> <0x0A>", "don't 12345 3.14", "tab\there", "中文 日本語", "\U0001F600\U0001F600",
                                                "a" * 5000, "é" * 3000 + " x", "ﬁ ½ Å", "\x00\x00", "word\r\nword", "   ", " " * 4000])]


@pytest.mark.parametrize("limit", [token_counts.FREQUENT, 4])
def test_counts(spark, odd, library, limit):
    rows = odd + nasty()
    got = token_counts.count_tokens(frame(spark, rows), token_counts.default_model(), limit)
    assert sorted(((*r,) for r in got.collect()), key=repr) == want(library, rows)


def test_documents_and_nothing(spark, documents, library):
    got = token_counts.op12_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((*r,) for r in got), key=repr) == sorted(((*w, w[2] > 4096) for w in want(library, documents)), key=repr)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), token_counts.default_model()).count() == 0


def test_a_small_cache(spark, odd, library, monkeypatch):
    own = token_counts.Model(token_counts.default_model())
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 3)
    pieces = [b" ", b"\n", b" the", b"\nThe", b"  x", b" " + "ü".encode() * 80, b" the"]
    for _ in range(3):
        assert own.lengths(pieces) == [1, 1, 1, len(library.encode("\nThe")) - 1, len(library.encode(" x")), len(library.encode("ü" * 80)), 1]
    assert own.lengths([]) == []


def test_frequent_pre_tokens_hold_all_common_ones(spark):
    """Each that is more than 1 / limit of all must be there, also after merging many summaries."""
    rows = [(k, "the cat the dog the " + prose(__import__("random").Random(k), 10)) for k in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("text").repartition(150)
    _, names = token_counts.frequent(texts, 8)
    assert {b" the"} <= set(names) and len(names) <= 8


def test_merging_keeps_the_bound():
    rng = np.random.default_rng(1)
    held, counts = token_counts.Frequent(16), Counter()
    for _ in range(50):
        values, n = np.unique(np.minimum(rng.zipf(1.3, 200), 5000).astype(np.uint64), return_counts=True)
        counts.update(dict(zip(values.tolist(), n.tolist())))
        held.add(values, n, lambda k: b"%d" % values[k])
    total = sum(counts.values())
    assert len(held.keys) <= 16 and {k for k, n in counts.items() if n > total / 16} <= set(held.keys.tolist())
    assert all(held.names[k] == b"%d" % held.keys[k] for k in range(len(held.keys)))


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        table = token_counts.LengthTable(keys, np.arange(1, len(keys) + 1).astype(np.uint32))
        assert table.find(keys).tolist() == list(range(1, len(keys) + 1))
        assert not table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
