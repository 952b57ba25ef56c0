"""Writers: appended store, repaired files, exchange text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of one file at the most.
FILE_ROWS = 5_000_000


def _spread(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Few files for each partition of the store; Spark splits partitions that are too large for one task."""
    return rows.hint("rebalance", *by).sortWithinPartitions(*by)


def append_store(rows: DataFrame, path: str, by: tuple[str, ...] = ("symbol",)) -> None:
    """Appends to the Parquet store, clustered so that each partition gets few files."""
    _spread(rows, by).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: tuple[str, ...] = ("symbol",)) -> None:
    """Overwrites only the partitions that ``rows`` has; ``rows`` must not be read from ``path``."""
    out = _spread(rows, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).parquet(path)


def write_csv(rows: DataFrame, path: str, time: str = "open_time", newest_first: bool = False) -> None:
    """One folder of text per symbol, with a header in each file; in order of their names the files follow one another in time, each in order."""
    order = ["symbol", F.desc(time) if newest_first else F.asc(time)]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", FILE_ROWS)
    ordered.partitionBy("symbol").option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, order: str) -> None:
    """One folder of Parquet per symbol; in order of their names the files follow one another by ``order``, each in order."""
    ordered = rows.repartitionByRange("symbol", order).sortWithinPartitions("symbol", order).write.option("maxRecordsPerFile", FILE_ROWS)
    ordered.partitionBy("symbol").parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """(file, line_no, line) as text, one folder ``file=...`` per file, whose files go on from one another in order of their names. Folders that exist are replaced, others stay; ``rows`` must not be read from ``path``."""
    ordered = rows.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no").select("file", F.col("line").alias("value"))
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy("file").text(path)


def fixed_scale(price: str, volume: str) -> tuple:
    """Prices with 8 and volumes with 10 decimals, trailing zeros kept."""
    return F.col(price).cast("decimal(38,8)").cast("string"), F.col(volume).cast("decimal(38,10)").cast("string")
