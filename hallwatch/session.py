"""Session settings the operators expect; a cluster may set more."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),  # texts and vectors make wide rows
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # operators that work in rounds leave no shuffle files behind
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """For tests and the benchmark only."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("hallwatch")
               .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC"))
    return configure(builder.getOrCreate())
