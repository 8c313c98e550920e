"""A training-data pipeline of five stages over ``documents``; each stage's rows are a Parquet table for the next.

A stage function takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import best_fit_packing, language_id, ngram_join, quality_rules, substring_dedup
from hallwatch.operators.state_tables import settle

#: Shares of all grams of a text, whatever the number of languages: those its language contains, and the lead over the second.
#: At sf0.01 every text has 0.58 and 0.11 or more; prose in three unlearned languages has 0.15 or less of the first.
LEAST_HELD, LEAST_MARGIN = 0.35, 0.05


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rule or stray from every language go."""
    known, refs, _ = quality_rules.fit(docs)
    return docs.where(quality_rules.passes(known, refs, F.col("text")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a language that stands out go."""
    model = language_id.learn(docs.select("text", "lang"))
    found = docs.withColumn("_found", language_id.language(model, F.col("text")))
    good = (F.col("_found.lang_pred") != language_id.UNKNOWN) & (F.col("_found.held") >= LEAST_HELD) & (F.col("_found.margin") >= LEAST_MARGIN)
    return found.where(good if model.languages else F.lit(True)).drop("_found")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays (rows that repeat an id stay together)."""
    groups = ngram_join.near_duplicates(docs)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a smaller document too are cut out; documents that lose all words go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup.remove_repeats(docs, carry=rest, untouched=True).where("n_removed = 0 or n_removed < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col("carried").getField(c) for c in rest}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: where every piece of every document lies."""
    return best_fit_packing.pack(docs)


STAGES = [("quality rules", quality), ("language id", language), ("n-gram jaccard join", near_duplicates), ("substring dedup", repeats), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
