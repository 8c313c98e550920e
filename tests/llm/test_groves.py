"""Large groves of near copies: blocks bounded, no grove in one task, pivots once a block."""

import random

from pyspark.sql import functions as F

from hallwatch.llm import ngram_join
from odd_rows import prose


def copies(n, words, seed):
    rnd = random.Random(seed)
    base = prose(rnd, words).split(" ")
    for k in range(n):
        text = list(base)
        text[k % words] = f"w{k}"
        yield " ".join(text)


def test_a_grove_of_ten_thousand_sets(spark, monkeypatch):
    seen = []
    inner = ngram_join._wide_links
    monkeypatch.setattr(ngram_join, "_wide_links", lambda wide, *rest: seen.extend(r["count"] for r in wide.groupBy("grove", "block").count().collect()) or inner(wide, *rest))
    rows = [(k, t) for k, t in enumerate(copies(10_000, 80, 1))] + [(20_000 + k, f"alone {k} with words of its own {k * 7} and more {k * 3}") for k in range(50)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert got.where("doc_id < 20000").select("component_id").distinct().count() == 1
    assert got.where("doc_id >= 20000 and doc_id = component_id").count() == 50
    assert len(seen) >= 10 and max(seen) <= ngram_join.BLOCK_SETS


def test_very_long_texts(spark):
    rows = [(k, t) for k, t in enumerate(copies(6, 100_000, 2))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0} and got.agg(F.min("n_shingles")).first()[0] > 90_000
