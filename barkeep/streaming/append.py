"""The store fed by a stream: new rows only, exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barkeep.operators.append import last_times

_NEW = "symbol string, ts long, pos long, rest string"


def _later(floor: int):
    """Keeps of a symbol's rows those that are later than its last time and than all rows before them; the state is its last time."""

    def run(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pages)).sort_values("pos", kind="stable")
        last = state.get[0] if state.exists else max(floor, int(rows["seed"].iloc[0]))
        tops = np.maximum.accumulate(np.concatenate([[last], rows["ts"].to_numpy()]))
        state.update((int(tops[-1]),))
        yield rows.loc[rows["ts"].to_numpy() > tops[:-1], ["symbol", "ts", "pos", "rest"]]

    return run


def new_rows(landed: DataFrame, floor: int = 0, last: DataFrame | None = None) -> DataFrame:
    """The rows of ``landed``, a stream of (symbol, ts, ..., pos), that are later than their symbol's last time and than every row of the symbol before them.

    The last time of each symbol is kept in Spark's state store, so a batch costs what its rows cost. ``last`` (symbol, last_ts) is where symbols
    begin, else they begin at the floor. Rows without a symbol, a time or a position are left out. Within a batch rows go by pos; the rows of a symbol in one batch are sorted in one task,
    so a trigger should bound its batches.
    """
    kept = [c for c in landed.columns if c not in ("symbol", "ts", "pos")]
    rest = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}) if kept else F.lit(None).cast("string")
    rows = landed.where("symbol is not null and ts is not null and pos is not null")
    rows = rows.select("symbol", F.col("ts").cast("long").alias("ts"), F.col("pos").cast("long").alias("pos"), rest.alias("rest"))
    if last is not None:
        rows = rows.join(last.select("symbol", F.col("last_ts").alias("seed")), "symbol", "left")
        rows = rows.withColumn("seed", F.coalesce("seed", F.lit(floor).cast("long")))
    else:
        rows = rows.withColumn("seed", F.lit(floor).cast("long"))
    out = rows.groupBy("symbol").applyInPandasWithState(_later(floor), _NEW, "last_ts long", "append", GroupStateTimeout.NoTimeout)
    if kept:
        out = out.withColumn("rest", F.from_json("rest", landed.select(*kept).schema))
    columns = {c: F.col(f"rest.`{c}`") for c in kept} | {c: F.col(c).cast(landed.schema[c].dataType) for c in ("symbol", "ts", "pos")}
    return out.select(*[columns[c].alias(c) for c in landed.columns])


def stream_append(landed: DataFrame, store: str, checkpoint: str, floor: int = 0, history: DataFrame | None = None) -> StreamingQuery:
    """Appends ``new_rows`` of ``landed`` to the Parquet folder ``store``, all that is there.

    Spark's file sink logs the files of each batch with the batch, and readers of the folder go by that log; so a restart
    neither loses nor repeats rows. The folder belongs to the stream alone. ``history`` (symbol, ts, ...), rows that are stored elsewhere,
    tells where symbols begin; its last times are written beside the checkpoint when the stream starts for the first time.
    """
    last = None
    if history is not None:
        spark, seed = landed.sparkSession, f"{checkpoint.rstrip('/')}-seed"
        try:
            last = spark.read.schema("symbol string, last_ts long").parquet(seed)
        except AnalysisException:
            last_times(history).write.parquet(seed)
            last = spark.read.schema("symbol string, last_ts long").parquet(seed)
    out = new_rows(landed, floor, last).writeStream.format("parquet").outputMode("append")
    return out.option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_distinct(landed: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``landed`` (with symbol and ts in milliseconds) without repeats of a symbol's time that come within ``lateness``."""
    timed = landed.withColumn("event_time", F.timestamp_millis("ts"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["symbol", "ts"])
