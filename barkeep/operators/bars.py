"""Bars: resampling, listing dates, exported records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeep.functions.times import DAY, align_down
from barkeep.operators import blocks


def bars_of_ticks(ticks: DataFrame, interval_ms: int) -> DataFrame:
    """(symbol, open_time, open, high, low, close, volume) of (symbol, ts_ms, event_id, px); ties of time go by event_id."""
    key = F.col("ts_ms") * 1_000_000 + F.col("event_id")
    return ticks.groupBy("symbol", align_down(F.col("ts_ms"), interval_ms).alias("open_time")).agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"), F.sum("px").alias("volume")
    )


def resample(bars: DataFrame, interval_ms: int) -> DataFrame:
    """Coarser bars; partial aggregates go before the shuffle, so no symbol is one task's burden."""
    return bars.groupBy("symbol", align_down(F.col("open_time"), interval_ms).alias("start")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("start", "open_time")


def sorted_bars(bars: DataFrame) -> DataFrame:
    """In ranges of symbol and time, ascending within; a large symbol has several partitions."""
    return bars.repartitionByRange("symbol", "open_time").sortWithinPartitions("symbol", "open_time")


def listing_dates(daily: DataFrame, symbols: DataFrame, now_ms: int) -> DataFrame:
    """(symbol, listed): the first daily bar, or a day before now for symbols without any; ``symbols`` may have probe_failed, for which it is thirty days."""
    first = daily.groupBy("symbol").agg(F.min("open_time").alias("first"))
    failed = F.coalesce("probe_failed", F.lit(False)) if "probe_failed" in symbols.columns else F.lit(False)
    listed = F.when(failed, F.lit(now_ms - 30 * DAY)).otherwise(F.coalesce("first", F.lit(now_ms - DAY)))
    return symbols.join(first, "symbol", "left").select("symbol", listed.alias("listed"))


def bootstrap(bars: DataFrame, now_ms: int, interval_ms: int, depth: int = 5000) -> DataFrame:
    """Bars of the last ``depth`` intervals of time, the history of a symbol without stored rows."""
    return bars.where(F.col("open_time") >= now_ms - depth * interval_ms)


def t6_records(bars: DataFrame, interval_ms: int) -> DataFrame:
    """(symbol, close_time, open, high, low, close, f_val, volume) in single precision, in ranges of symbol and time, newest first within each symbol."""
    single = [F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close")]
    rows = bars.select("symbol", (F.col("open_time") + interval_ms).alias("close_time"), *single, F.lit(0.0).cast("float").alias("f_val"), F.col("volume").cast("float").alias("volume"))
    return rows.repartitionByRange("symbol", F.desc("close_time")).sortWithinPartitions("symbol", F.desc("close_time"))


def positions(bars: DataFrame, by: str, newest_first: bool) -> DataFrame:
    """Adds rec_no, the position of a row in its symbol by its time, from 1."""
    order = F.desc(by) if newest_first else F.asc(by)
    rows = bars.withColumn("_block", blocks.of_time(F.col(by)))
    return blocks.numbered(rows, "symbol", ["_block"], [order], "rec_no", backwards=newest_first).drop("_block")
