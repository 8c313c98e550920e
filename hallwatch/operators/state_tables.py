"""Tables between the rounds of an operator, written to the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


WIDE = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16", "parquet.enable.dictionary": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session that names none gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settle(df: DataFrame, wide: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors and cuts the lineage.

    Unlike ``checkpoint()`` it also gives the planner true sizes; a checkpoint keeps the estimate of the plan it came
    from, and estimates of joins multiply from round to round. ``wide`` is for rows of megabytes: small row groups, so
    that a reader, which never goes beyond a row group at once, holds only a few."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write = df.write.options(**WIDE) if wide else df.write
    write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for table in tables:
        path = getattr(table, "_settled_at", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
