"""Queries on tables of other shapes than the supplied ones: folders of files, near copies, events close together."""

import os
import shutil

import duckdb
from pyspark.sql import functions as F

from check import compare
from hallwatch.plans.catalog import all_queries
from hallwatch.plans.views import number_code

FOLDER = "/root/testdata/sf0.001"


def _checked(spark, folder, name):
    q, con = all_queries()[name], duckdb.connect()
    for t in ("events", "orders", "embeddings"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'").fetchall()
    return compare(q(spark, folder).toPandas(), con.execute(q.check).fetchdf())


def _tables(folder, *names):
    for name in names:
        shutil.copy(f"{FOLDER}/{name}.parquet", folder)


def test_streamed_table_of_several_files(spark, folder):
    spark.read.parquet(f"{FOLDER}/embeddings.parquet").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    _tables(folder, "events", "orders")
    assert _checked(spark, folder, "gallery_reload_stream") == "ok"


def test_expiry_ends_with_the_last_event(spark, folder):
    """Last touches ten hours, and half a second more or less, before the last event."""
    _tables(folder, "orders", "embeddings")
    end = 1_706_659_200_000_000
    stamps = [(0, end - 36_000_500_000), (1, end - 36_000_000_000), (2, end - 35_999_500_000), (3, end - 80_000_000_000), (3, end - 35_998_100_000), (4, end + 261)]
    rows = [(i, u, us) for i, (u, us) in enumerate(stamps)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, us long").select(
        "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    d.coalesce(1).write.parquet(f"{folder}/events.parquet")
    assert all_queries()["gallery_expiry_stream"](spark, folder).count() == 3
    assert _checked(spark, folder, "gallery_expiry_stream") == "ok"


def test_live_gallery_with_copies_of_vectors(spark, folder):
    _tables(folder, "events", "orders")
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    same = e.select(F.col("vec_id").alias("_of"), "embedding")
    (e.drop("embedding").withColumn("_of", F.col("vec_id") % F.lit(10)).join(same, "_of").select(*e.columns)
     .coalesce(1).write.parquet(f"{folder}/embeddings.parquet"))
    assert _checked(spark, folder, "live_gallery_matches") == "ok"


def test_code_words_differ_in_twelve_bits(spark):
    words = [sum(((n & mask).bit_count() % 2) << k for k, mask in enumerate(number_code())) for n in [*range(5000), *(2**24 - 1 - k * k for k in range(4000))]]
    assert all(w.bit_count() >= 12 for w in words if w)  # a linear code: the least weight is the least distance
