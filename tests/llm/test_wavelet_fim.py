"""Fill-in-middle against a regular-expression reading, ranks against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hallwatch.llm import wavelet_fim
from odd_rows import SCHEMA, documents, frame, odd  # noqa: F401

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_reading(doc_id, text, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def read(done):
    back = wavelet_fim.restore(F.col("output"), F.col("form"))
    return sorted(((*r,) for r in done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("text")).collect()), key=repr)


def nasty():
    return [(100 + k, t) for k, t in enumerate(["a <P> b c", "<S>", "half <M mark >", "ends with <", "<", "<P", "x <S y <P z <M w", " lead", "trail \n", "\t", "é ü 中文 \U0001F600\U0001F600 ñ",
                                                "a\x0bb\x0cc\rd", "\x00 \x1f", "word " * 500, "  no break", "> <", "P>x <S>"])] + [(200 + k, "ab cd <x> é ef ") for k in range(60)]


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (100, 0)])
def test_forms_and_cuts(spark, odd, rate, spm):
    rows = odd + nasty()
    assert read(wavelet_fim.fill_in_middle(frame(spark, rows), rate=rate, spm=spm)) == sorted((plain_reading(i, t, rate, spm) for i, t in rows), key=repr)


def test_documents_and_nothing(spark, documents):
    got = wavelet_fim.op11_wavelet_fim(spark, "/root/testdata/sf0.001")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((*r,) for r in got.collect()) == sorted((i, n, form, p, m, sha(out), sha(text)) for i, n, form, p, m, out, text in (plain_reading(*d) for d in documents))
    assert wavelet_fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_rows_on_one_null_id(spark):
    rows = [(None if k % 3 else k, f"text {k} with words " * (k % 7)) for k in range(600)]
    assert read(wavelet_fim.fill_in_middle(frame(spark, rows))) == sorted((plain_reading(i, t) for i, t in rows), key=repr)


def test_matrix_counts():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix, places = wavelet_fim.WaveletMatrix(symbols, 3), np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, places).tolist() == [int((symbols[:p] == s).sum()) for p in places]
        assert matrix.rank(4, places, 1).tolist() == [int((symbols[:p] >= 4).sum()) for p in places]
