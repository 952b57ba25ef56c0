"""Times and bar sizes. All times are epoch milliseconds, UTC; "now" is always a parameter, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000

# The bar sizes in minutes and their names. 1M is 28 days.
INTERVALS = {1: "1m", 3: "3m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 120: "2h", 240: "4h", 360: "6h", 480: "8h", 720: "12h", 1440: "1d", 4320: "3d", 10080: "1w", 40320: "1M"}
# The sizes of the exchanges that don't offer all of them.
LIMITED_INTERVALS = {"okx": [1], "mexc": [1, 5, 15, 30, 60, 240, 480, 1440, 10080, 40320]}


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def minute_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.date_format(F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")


def align_down(ms: Column, interval: int | Column) -> Column:
    return ms - F.pmod(ms, F.lit(interval) if isinstance(interval, int) else interval)


def align_up(ms: Column, interval: int | Column) -> Column:
    """The start of the next bar, even from the start of a bar."""
    step = F.lit(interval) if isinstance(interval, int) else interval
    return align_down(ms, step) + step


def last_completed_bar(now: Column, interval: int | Column) -> Column:
    step = F.lit(interval) if isinstance(interval, int) else interval
    return align_down(now, step) - step


def interval_label(minutes: Column) -> Column:
    """The name of a bar size; any other number is an error."""
    names = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    wrong = F.raise_error(F.concat(F.lit("no bar size of minutes: "), minutes.cast("string")))
    return F.coalesce(F.try_element_at(names, minutes), wrong.cast("string"))


def interval_table(spark: SparkSession) -> DataFrame:
    """(minutes, label, ms) of all bar sizes."""
    return spark.createDataFrame([(m, label, m * MINUTE) for m, label in INTERVALS.items()], "minutes int, label string, ms long")


def supported_intervals(wanted: DataFrame) -> DataFrame:
    """``wanted`` (exchange, minutes) with the column supported."""
    offered = F.lit(False)
    for exchange, sizes in LIMITED_INTERVALS.items():
        offered = offered | ((F.col("exchange") == exchange) & F.col("minutes").isin(sizes))
    offered = offered | (~F.col("exchange").isin(list(LIMITED_INTERVALS)) & F.col("minutes").isin(list(INTERVALS)))
    return wanted.withColumn("supported", offered)
