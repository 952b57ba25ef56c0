"""Order-dependent work on keys that may hold a third of all rows.

A symbol or file is cut into blocks along its order: of time, of position or of lines. A window runs within
a block; what crosses from one block to the next is carried by a table with one row for each block: how many
rows lie before it, the largest value before it, the last time before it. So no task holds a whole key, and
what a window over a whole key still sorts is one row for each BLOCK_ROWS. Rows whose key is null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barkeep.functions.times import MINUTE

#: Rows of a block of positions; blocks of time are as wide as so many bars.
BLOCK_ROWS = 500_000
#: The block of rows without a time; it comes first.
NO_TIME = -(2**63)


def of_time(time: Column, interval_ms: int = MINUTE) -> Column:
    """The block of a time: its start in milliseconds. A null has a block of its own, before all others."""
    width = F.lit(BLOCK_ROWS * (interval_ms or MINUTE)).cast("long")
    return F.coalesce(time - F.pmod(time, width), F.lit(NO_TIME).cast("long"))


def of_position(position: Column) -> Column:
    """The block of a whole number that counts rows."""
    number = position.cast("long")
    return F.coalesce(number - F.pmod(number, F.lit(BLOCK_ROWS).cast("long")), F.lit(NO_TIME).cast("long"))


def _earlier(key: str, blocks: list[str], backwards: bool) -> Window:
    order = [F.desc(b) if backwards else F.asc(b) for b in blocks]
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, key: str, blocks: list[str], order: list[Column], to: str, backwards: bool = False, counted: str = "*") -> DataFrame:
    """``rows`` with ``to``, the position of a row in its key from 1: by the columns ``blocks``, and within a block by ``order``.

    With backwards the blocks are taken from the last to the first; ``order`` then descends too. Where ``rows`` come from a wide exchange, a column of it that
    is never null may be counted, so that both uses of ``rows`` read the same exchange.
    """
    counts = rows.groupBy(key, *blocks).agg(F.count(counted).alias("n_block"))
    counts = counts.select(key, *blocks, F.coalesce(F.sum("n_block").over(_earlier(key, blocks, backwards)), F.lit(0)).alias("n_before"))
    inner = F.row_number().over(Window.partitionBy(key, *blocks).orderBy(*order))
    return rows.withColumn(to, inner).join(counts, [key, *blocks]).withColumn(to, (F.col(to) + F.col("n_before")).cast("long")).drop("n_before")


def running_max(rows: DataFrame, key: str, blocks: list[str], order: list[Column], value: Column, to: str) -> DataFrame:
    """``rows`` with ``to``, the largest value of the rows before a row in its key, null for the first one; see ``numbered``."""
    tops = rows.groupBy(key, *blocks).agg(F.max(value).alias("top_block"))
    tops = tops.select(key, *blocks, F.max("top_block").over(_earlier(key, blocks, False)).alias("top_before"))
    inner = F.max(value).over(Window.partitionBy(key, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(to, inner).join(tops, [key, *blocks]).withColumn(to, F.greatest(to, "top_before")).drop("top_before")


def neighbours(times: DataFrame, key: str, ts: str, interval_ms: int) -> DataFrame:
    """``times``, unique within a key, with block, prev_ts and delta: the time before in the same block, null for the first one."""
    rows = times.withColumn("block", of_time(F.col(ts), interval_ms))
    before = F.lag(ts).over(Window.partitionBy(key, "block").orderBy(ts))
    return rows.withColumn("prev_ts", before).withColumn("delta", F.col(ts) - F.col("prev_ts"))


def seams(ends: DataFrame, key: str) -> DataFrame:
    """``ends`` (key, block, first, last, ...) with prev_ts and delta between the last time of the block before and the first one of a block; null where there is none."""
    before = F.lag("last").over(Window.partitionBy(key).orderBy("block"))
    return ends.withColumn("prev_ts", F.when(F.col("first").isNotNull(), before)).withColumn("delta", F.col("first") - F.col("prev_ts"))
