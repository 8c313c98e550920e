"""Importance resampling against plain counting and sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hallwatch.llm import importance_resampling as R
from odd_rows import SCHEMA, documents, frame, odd  # noqa: F401

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=1):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) % R.BUCKETS for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain_reading(rows, target, longest=1):
    """(doc_id, n_features, weight, score, may be drawn) per row, and how many to draw."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text, longest)[1])
    for text in target:
        t.update(features(text, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, found = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    return out, 10 * sum(o[4] for o in out) // 100


def ranked(out, draw):
    order = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    return sorted([(*o[:4], k + 1 if k < draw else None) for k, o in enumerate(order)] + [(*o[:4], None) for o in out if not o[4]], key=repr)


def rows_of(df):
    return sorted(((*r,) for r in df.collect()), key=repr)


def target(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


@pytest.mark.parametrize("segment", [R.SEGMENT, 4])
def test_documents(spark, documents, segment):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = R.resample(spark.read.parquet(f"{SMALL}/documents.parquet"), bench, segment_rows=segment)
    assert rows_of(got) == ranked(*plain_reading(documents, target(spark)))


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, odd, longest):
    rows = odd + [(500 + k, "some words of text " * 8 + str(k)) for k in range(40)]
    got = R.resample(frame(spark, rows), spark.createDataFrame([("some words, A text",), (None,)], "text string"), longest=longest, segment_rows=3)
    assert rows_of(got) == ranked(*plain_reading(rows, ["some words, A text", None], longest))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.resample(empty, spark.createDataFrame([], "text string")).count() == 0
    got = R.resample(spark.createDataFrame([(1, "a b c " * 10), (2, "")], "doc_id long, text string"), spark.createDataFrame([], "text string"), percent=100)
    assert [(r.doc_id, r["rank"]) for r in got.collect()] == [(1, 1), (2, None)]


def test_equal_rows_split(spark, monkeypatch):
    """A third of all rows with one null id and one text: every rank once, segments stay bounded."""
    rows = [(None, "the same text of many words " * 5) if k % 3 == 0 else (k, f"other text {k} of many words " * 5) for k in range(900)]
    seen = []
    inner = R._number
    monkeypatch.setattr(R, "_number", lambda begins, draw: seen.append(np.diff(begins)) or inner(begins, draw))
    got = R.resample(frame(spark, rows), spark.createDataFrame([("text",)], "text string"), percent=100, segment_rows=50)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 901))
    assert seen[0].max() <= 100 and len(seen[0]) == 17


def test_checksums():
    words = [b"", b"a", b"word", bytes(range(256)), b"x" * 1000, "é中".encode(), b"y" * 64, b"z" * 65]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert R.checksums(data, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    assert R.checksums(data, starts, ends, np.full(len(words), 77, np.uint32)).tolist() == [zlib.crc32(w, 77) for w in words]


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k, 5) for k in range(100)], "doc_id long, n long")
    got = R.draw_largest(rows, F.lit(True), F.col("n"), F.col("doc_id"), 50, 8).collect()
    assert {(r.doc_id, r["rank"]) for r in got} == {(k, k + 1 if k < 50 else None) for k in range(100)}
