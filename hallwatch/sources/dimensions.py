"""Camera, zone and topology dimensions from configuration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch import schemas
from hallwatch.params import DEFAULTS, Params


def read_cameras(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    """One row per camera; the stream address is not part of the schema and never read."""
    return camera_dimension(spark.read.schema(schemas.CAMERAS).json(path), p)


def camera_dimension(config: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    no_areas = F.array().cast(schemas.CAMERAS["exclusion_zones"].dataType)
    return config.select(
        "camera_id", F.coalesce("name", "camera_id").alias("name"), F.coalesce("fps", F.lit(p.default_fps)).alias("fps"),
        F.coalesce("exclusion_zones", no_areas).alias("exclusion_zones"),
    )


def exclusion_areas(cameras: DataFrame) -> DataFrame:
    """One row per exclusion rectangle."""
    return cameras.select("camera_id", F.explode("exclusion_zones").alias("a")).select("camera_id", "a.*")


def read_zones(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    return zone_dimension(spark.read.schema(schemas.ZONE_CONFIG).json(path), p)


def zone_dimension(config: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per zone and camera; ``zone_ord`` keeps the configured order."""
    return config.select(
        "zone_ord", "name", F.coalesce("max_handover_sec", F.lit(p.zone_handover_sec)).alias("max_handover_sec"),
        F.explode("cameras").alias("camera_id", "c"),
    ).select("zone_ord", "name", "camera_id", F.col("c.polygon").alias("polygon"), "max_handover_sec")


def read_edges(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    """``overlap_ord`` of the configuration says which of several edges counts first; a configuration
    of one file without it keeps the order of its lines."""
    rows = spark.read.schema(schemas.OVERLAP_CONFIG).json(path)
    return edge_dimension(rows.withColumn("overlap_ord", F.coalesce("overlap_ord", F.monotonically_increasing_id())), p)


def edge_dimension(overlaps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Every overlap becomes two directed edges, exit and entry rectangles swapped on the way back."""
    limit = F.coalesce("max_handover_sec", F.lit(p.edge_handover_sec)).alias("max_handover_sec")
    a, b = F.col("cameras")[0], F.col("cameras")[1]
    one, two = F.col("cam1_exit_zone"), F.col("cam2_entry_zone")

    def edge(offset, src, dst, leave, enter):
        return overlaps.select(
            (F.col("overlap_ord") * 2 + offset).cast("long").alias("edge_ord"), src.alias("from_camera"), dst.alias("to_camera"),
            leave.alias("exit_zone"), enter.alias("entry_zone"), limit,
        )

    return edge(0, a, b, one, two).unionByName(edge(1, b, a, two, one))
