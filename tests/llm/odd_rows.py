"""Rows that operators must survive, with columns whose names they use inside."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, batch int, bucket string, id double, n_words string, keys int, size string"


def prose(rnd, n, stock="abcdefgh"):
    return " ".join("".join(rnd.choice(stock) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rnd = random.Random(7)
    base, passage = prose(rnd, 120), prose(rnd, 40)
    edited = base.split(" ")
    edited[60] = "CHANGED"
    far = base.split(" ")
    far[10:50] = prose(rnd, 40).split(" ")
    long = prose(rnd, 60_000)
    texts = [base, base, " ".join(edited), base.upper(), " ".join(far), passage + " " + prose(rnd, 90), prose(rnd, 70) + "\n" + passage, passage + " " + passage,
             "", None, " \t\n ", "one", "One", "two words", "four words stand here", "five words stand here now", long, long + " tail", "!!! $$$ 123", "Ünïcödé 中文 \U0001F600 text",
             "a a a a a a a a a a a a a a a a a a a a", "line\nline\n\n \nline", "Licensed under CC BY-NC 4.0.", "x all rights reserved y General Public License", "\x00 null byte \x1c sep"]
    return list(enumerate(texts)) + [(3, base.upper()), (3, prose(rnd, 30)), (None, base), (None, None), (None, "one")]


def frame(spark, rows):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[k % 3], None, k, "b", float(k), "n", None, "s") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd():
    return odd_texts()


@pytest.fixture(scope="session")
def documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text) for r in rows)
