"""The header of every file of a folder, kept between scans.

The registry is a Parquet table (file, file_size, modified, header). An update lists the folder, which reads no
content, and only files that are new or have changed since are read; their headers are appended. A file
without a line that can be read has a null header.
"""

from __future__ import annotations

from datetime import timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.functions.lines import cleaned

SCHEMA = "file string, file_size long, modified timestamp, header string"
_OWN = ["file", "file_size", "modified"]


def clean_header(line: Column) -> Column:
    """A first line without a byte order mark and a carriage return."""
    return F.regexp_replace(cleaned(line), "^﻿", "")


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, file_size, modified) of all files that hold a byte; content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


class HeaderRegistry:
    """Headers of files, kept as a table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All that has been seen, also of files that have gone or changed since."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def unknown(self, folder: str | list[str]) -> DataFrame:
        """(file, file_size, modified) of files that are new or have changed since they were seen."""
        return listing(self.spark, folder).join(self.rows().select(*_OWN).distinct(), _OWN, "left_anti")

    def update(self, folder: str | list[str]) -> DataFrame:
        """(file, file_size, modified, header) of the files below ``folder`` as they are now; what is not known yet is read and kept."""
        new = self.unknown(folder)
        since = new.agg(F.min("modified")).first()[0]
        if since is not None:
            self._probe(folder, since).join(new, _OWN, "right").select(*_OWN, "header").write.mode("append").parquet(self.path)
        return listing(self.spark, folder).join(self.rows().dropDuplicates(_OWN), _OWN)

    def _probe(self, folder: str | list[str], since) -> DataFrame:
        """The first lines of files that are as new as the oldest unknown one: Spark leaves older ones out when it lists them."""
        after = (since.astimezone(timezone.utc) - timedelta(milliseconds=1)).strftime("%Y-%m-%dT%H:%M:%S.%f")
        read = self.spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).option("modifiedAfter", after).option("timeZone", "UTC").option("recursiveFileLookup", True).text(folder)
        about = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_size", "file_size"), ("file_modification_time", "modified"), ("file_block_start", "block"))]
        first = read.select("value", *about, F.monotonically_increasing_id().alias("id")).where("block = 0")
        return first.groupBy(*_OWN).agg(clean_header(F.min_by("value", "id")).alias("header"))
