"""The language stage of the pipeline on unlearned and on many languages."""

import random

import corpus_pipeline


def test_language_stage_drops_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem i sumieniem",
               "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto"]
    for langs in (["en"], ["en", "fr"], ["en", "fr", "de"], ["en", "fr", "de", "es"]):
        own = docs.where(docs.lang.isin(langs))
        planted = own.unionByName(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(foreign)], "doc_id long, text string, lang string"))
        kept = {r.doc_id for r in corpus_pipeline.language(spark, planted, "").collect()}
        assert kept == {r.doc_id for r in own.collect()}


def test_language_stage_keeps_clean_texts_of_ten_languages(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 8)))
    common, rows = [word() for _ in range(60)], []
    for number in range(10):
        own = common + [word() for _ in range(60)]
        rows += [(number * 100 + k, " ".join(rnd.choice(own) for _ in range(80)), f"l{number}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, "").count() == len(rows)
