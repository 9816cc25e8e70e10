"""Listing files with empty ones, and opening them inside tasks by the machines' own access to their folder."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_system(path: str):
    """pyarrow's file system for a path (of the machine, or with a scheme), and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@%?&=+,;~!$'()*[]"))


def listed_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, _metadata) of the files below a path, those of length zero too, which Spark's readers pass over.

    ``_metadata`` has file_path and file_name, so that expressions over a reader's metadata name files here as well. The paths are those that Spark's own
    listing holds on the driver.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    paths = sorted(unquote(p) for p in reader.load(path).inputFiles())
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(1000, len(paths))))
    return rows.select("path", F.struct(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name")).alias("_metadata"))


def empty_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, _metadata) of the files of length zero."""
    seen = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("_name")).distinct()
    return listed_files(spark, path, glob).join(seen, F.col("_metadata.file_name") == F.col("_name"), "left_anti")
