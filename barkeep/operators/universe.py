"""Which symbols are to be updated, kept or deleted. Instruments have the columns of ``sources.files.INSTRUMENTS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeep.functions.lines import instrument_family
from barkeep.plans.rules import KEEPS_UNKNOWN, TRADFI_TAGS, UNIVERSES, in_universe, tagged


def universe(instruments: DataFrame, exchange: str, data: str, tradfi: tuple[str, ...] = TRADFI_TAGS) -> DataFrame:
    return instruments.where(in_universe(exchange, data, tradfi))


def universes(instruments: DataFrame, tradfi: tuple[str, ...] = TRADFI_TAGS) -> DataFrame:
    """(exchange, data, symbol) of all rules over one master, in one pass."""
    fits = F.array(*[F.when(in_universe(e, d, tradfi), F.struct(F.lit(e).alias("exchange"), F.lit(d).alias("data"))) for e, d in UNIVERSES])
    return instruments.select("symbol", F.explode(F.array_compact(fits)).alias("x")).select("x.exchange", "x.data", "symbol")


def without_tradfi(instruments: DataFrame, parts: tuple[str, ...] = TRADFI_TAGS) -> DataFrame:
    return instruments.where(~tagged(F.col("tags"), parts))


def split_active(instruments: DataFrame, delete_delisted: bool) -> DataFrame:
    """Adds action: update, or delete for those that don't trade where that is wanted."""
    return instruments.withColumn("action", F.when(F.col("is_trading") | F.lit(not delete_delisted), "update").otherwise("delete"))


def with_family(instruments: DataFrame) -> DataFrame:
    return instruments.withColumn("family", instrument_family(F.col("symbol"), F.col("inst_family")))


def _known(requested: DataFrame, instruments: DataFrame) -> DataFrame:
    known = instruments.select("symbol", F.col("is_trading"), F.lit(True).alias("is_known"))
    return requested.join(known, "symbol", "left")


def _action(keep_unknown: bool, delete_delisted: bool) -> Column:
    gone = F.lit("delete" if delete_delisted else "update")
    unknown = F.lit("delete" if delete_delisted else "update" if keep_unknown else "drop")
    return F.when(F.col("is_known").isNull(), unknown).when(F.col("is_trading"), "update").otherwise(gone)


def resolve_requested(requested: DataFrame, instruments: DataFrame, keep_unknown: bool, delete_delisted: bool) -> DataFrame:
    """(symbol, action): update, delete or drop for every requested symbol."""
    return _known(requested, instruments).select("symbol", _action(keep_unknown, delete_delisted).alias("action"))


def resolve_everywhere(requested: DataFrame, instruments: DataFrame) -> DataFrame:
    """(exchange, delete_delisted, symbol, action) under the rule of each exchange, from one join."""
    actions = [F.struct(F.lit(e).alias("exchange"), F.lit(d).alias("delete_delisted"), _action(keep, d).alias("action")) for e, keep in KEEPS_UNKNOWN.items() for d in (False, True)]
    rows = _known(requested, instruments).select("symbol", F.explode(F.array(*actions)).alias("x"))
    return rows.select("x.exchange", "x.delete_delisted", "symbol", "x.action")


def delisted_on_disk(inventory: DataFrame, instruments: DataFrame, active_only: bool = False) -> DataFrame:
    """Stored symbols that the master, or its active part, doesn't have."""
    known = instruments.where("is_trading") if active_only else instruments
    return inventory.join(known.select("symbol"), "symbol", "left_anti")


def active_requested(requested: DataFrame, instruments: DataFrame) -> DataFrame:
    return requested.join(instruments.where("is_trading").select("symbol"), "symbol", "left_semi")


def end_bounds(symbols: DataFrame, instruments: DataFrame, now_ms: int) -> DataFrame:
    """(symbol, end_ms): the delivery of an inactive contract, else now."""
    ends = instruments.where("not is_trading and delivery_time > 0").select("symbol", "delivery_time")
    return symbols.join(ends, "symbol", "left").select("symbol", F.coalesce("delivery_time", F.lit(now_ms)).alias("end_ms"))


def start_bounds(resume: DataFrame, instruments: DataFrame) -> DataFrame:
    """(symbol, start_ms): the last stored time or the listing, whichever is later; resume has (symbol, last_ts)."""
    listed = instruments.where("list_time > 0").select("symbol", "list_time")
    return resume.join(listed, "symbol", "left").select("symbol", F.greatest("last_ts", F.coalesce("list_time", "last_ts")).alias("start_ms"))


def union_instruments(active: DataFrame, closed: DataFrame) -> DataFrame:
    """Both lists; a symbol in both stays twice."""
    return active.unionByName(closed)


def delete_set(instruments: DataFrame, inventory: DataFrame) -> DataFrame:
    """(symbol) that don't trade, and stored ones that the master doesn't have."""
    inactive = instruments.where("not is_trading").select("symbol")
    return inactive.unionByName(delisted_on_disk(inventory, instruments)).distinct()


def purged(store: DataFrame, to_delete: DataFrame) -> DataFrame:
    """The store without the rows of deleted symbols."""
    return store.join(to_delete.select("symbol"), "symbol", "left_anti")


def symbol_list(symbols: DataFrame) -> DataFrame:
    """One row with the symbols joined by comma and space, for a message on a list that people asked for."""
    return symbols.agg(F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("symbols"))
