"""File listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import fold


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of files, without their content."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("created_time"))


def file_catalog(files: DataFrame, search: str | None = None, file_type: str | None = None,
                 status: str | None = None, sort_by: str | None = None, descending: bool = True) -> DataFrame:
    """Filtered listing; a status may be the lifecycle or the canonical one."""
    out = files
    if search and search.strip():
        out = out.filter(fold(F.col("file_name")).contains(search.strip().casefold()))
    if file_type:
        out = out.filter(F.col("file_type") == file_type)
    if status:
        wanted = status.casefold()
        out = out.filter((F.lower("lifecycle_status") == wanted) | (F.lower("canonical_status") == wanted))
    if sort_by:
        key = F.col("size") if sort_by == "size" else F.col("created_time")
        out = out.orderBy(key.desc() if descending else key.asc(), "file_id")
    return out
