"""Frame and detection tables as batch or streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hallwatch import schemas


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Files are taken in arrival order, a bounded number per batch; a backlog waits and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all cameras; the camera is a column."""
    return read_table(spark, path, schemas.FRAMES)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return stream_table(spark, path, schemas.FRAMES, files_per_trigger)
