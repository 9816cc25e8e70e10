"""Description of a collection of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridframe.functions import rules
from gridframe.model import Grid
from gridframe.operators.aggregates import grid_spec


def file_table(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, size) of the files under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def fingerprint(files: DataFrame) -> DataFrame:
    """Number of files, latest change in seconds, sizes of the first and last file, joined by dashes."""
    stats = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.max(F.unix_seconds("modified")).alias("changed"),
        F.min_by("size", "path").alias("first"), F.max_by("size", "path").alias("last"),
    )
    return stats.select("file_count", F.concat_ws("-", "file_count", "changed", "first", "last").alias("fingerprint"))


def catalog(grid: Grid, files: DataFrame | None = None) -> DataFrame:
    """One row per grid: axes, dates, bounds, variables with units and labels, regions, and the file fingerprint."""
    variables = F.array(*[
        F.struct(F.lit(v).alias("name"), F.lit(grid.long_names.get(v) or v).alias("label"), F.lit(grid.units.get(v)).cast("string").alias("unit"))
        for v in grid.variables
    ])
    regions = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(v).alias("label")) for k, v in rules.REGION_NAMES.items()])
    rows = grid_spec(grid).withColumns({"variables": variables, "regions": regions})
    if files is None:
        return rows
    one = fingerprint(files)
    return rows.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")
