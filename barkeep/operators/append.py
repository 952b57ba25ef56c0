"""What of the incoming rows is new. Stored and incoming rows have (symbol, ts, ...), incoming ones also pos, a whole number that orders them.

Running maxima and numbers go by blocks of positions, so no symbol is one task's burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barkeep.functions.lines import batch_number
from barkeep.operators import blocks


def last_times(stored: DataFrame) -> DataFrame:
    """(symbol, last_ts); on Parquet a scan of two columns."""
    return stored.groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def _after(incoming: DataFrame, stored: DataFrame, floor: int) -> DataFrame:
    return incoming.join(last_times(stored), "symbol", "left").withColumn("last_ts", F.coalesce("last_ts", F.lit(floor)))


def append_static(incoming: DataFrame, stored: DataFrame, floor: int = 0) -> DataFrame:
    """Rows later than the last stored time of their symbol; repeats among them stay."""
    return _after(incoming, stored, floor).where("ts > last_ts").drop("last_ts")


def append_monotonic(incoming: DataFrame, stored: DataFrame, floor: int = 0) -> DataFrame:
    """Rows later than the last stored time and than every incoming row before them, so the result strictly ascends.

    Rows that the stored time already excludes are dropped before the window; they can't raise its maximum.
    """
    rows = append_static(incoming, stored, floor).withColumn("_block", blocks.of_position(F.col("pos")))
    rows = blocks.running_max(rows, "symbol", ["_block"], [F.col("pos")], F.col("ts"), "_top")
    return rows.where("_top is null or ts > _top").drop("_top", "_block")


def append_archives(incoming: DataFrame, stored: DataFrame, floor: int = 0) -> DataFrame:
    """Rows later than the last stored time and than all of the earlier archives (file_no); repeats within an archive stay."""
    tops = incoming.groupBy("symbol", "file_no").agg(F.max("ts").alias("top"))
    before = Window.partitionBy("symbol").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("symbol", "file_no", F.max("top").over(before).alias("earlier"))
    rows = append_static(incoming, stored, floor).join(tops, ["symbol", "file_no"])
    return rows.where("earlier is null or ts > earlier").drop("earlier")


def take_until_known(pages: DataFrame, stored: DataFrame, floor: int = 0) -> DataFrame:
    """Newest-first pages (page, pos) up to the first row that is already stored; later rows are ignored even if new."""
    rows = _after(pages, stored, floor).withColumns({"_known": (F.col("ts") <= F.col("last_ts")).cast("int"), "_block": blocks.of_position(F.col("pos"))})
    rows = blocks.running_max(rows, "symbol", ["page", "_block"], [F.col("pos")], F.col("_known"), "_seen")
    return rows.where("_known = 0 and coalesce(_seen, 0) = 0").drop("_known", "_seen", "_block", "last_ts")


def union_bulk_recent(bulk: DataFrame, recent: DataFrame) -> DataFrame:
    """All bulk rows, then the recent rows that are later than a symbol's last bulk row."""
    return bulk.unionByName(append_static(recent, bulk))


def append_counts(new: DataFrame) -> DataFrame:
    return new.groupBy("symbol").agg(F.count("*").alias("n_appended"))


def legacy_seconds(resume: DataFrame) -> DataFrame:
    """``resume`` (symbol, last_ts) with is_legacy: fewer than 13 digits are seconds of an old format, to be skipped."""
    return resume.withColumn("is_legacy", F.length(F.col("last_ts").cast("string")) < 13)


def staged_names(staged: DataFrame) -> DataFrame:
    """Adds batch_no from the batch's name; rows of other names are dropped."""
    return staged.withColumn("batch_no", batch_number(F.col("batch_name"))).where("batch_no is not null")


def merge_staged(staged: DataFrame) -> DataFrame:
    """Staged rows in order of time: the highest batch holds the oldest rows. seq numbers them within the symbol, from 1."""
    rows = staged.withColumns({"_back": -F.col("batch_no"), "_block": blocks.of_position(F.col("pos"))})
    return blocks.numbered(rows, "symbol", ["_back", "_block"], [F.col("pos")], "seq").drop("_back", "_block")


def recoverable(staged: DataFrame, committed: DataFrame) -> DataFrame:
    """(symbol, last_batch, n_batches, missing) of symbols that were left staged without a commit; missing lists absent batches."""
    left = staged.join(committed.select("symbol"), "symbol", "left_anti").select("symbol", "batch_no").distinct()
    have = left.groupBy("symbol").agg(F.max("batch_no").alias("last_batch"), F.count("*").alias("n_batches"))
    wanted = have.select("symbol", F.explode(F.sequence(F.lit(1), F.col("last_batch"))).alias("batch_no"))
    absent = wanted.join(left, ["symbol", "batch_no"], "left_anti").groupBy("symbol").agg(F.array_sort(F.collect_list("batch_no")).alias("gone"))
    out = have.join(absent, "symbol", "left")
    return out.select("symbol", "last_batch", "n_batches", F.coalesce(F.array_join("gone", ","), F.lit("")).alias("missing"))
