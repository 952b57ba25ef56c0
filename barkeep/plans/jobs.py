"""The jobs that people run: update, verify, repair, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.operators import append, bars, universe, verify
from barkeep.plans.fetch import chunk_ranges, fetch_plan, wanted_archives
from barkeep.plans.rules import APPENDS, FLOORS, KEEPS_UNKNOWN, LineRule
from barkeep.sources import files, sinks
from barkeep.sources.shared import scratch
from barkeep.sources.versions import VersionedTable


@dataclass(frozen=True)
class Update:
    """What an update decides: the plan of what to fetch, the new rows, their counts, and the store without deleted symbols."""

    plan: DataFrame
    new: DataFrame
    counts: DataFrame
    kept: DataFrame


def _wanted(requested: DataFrame, instruments: DataFrame, exchange: str, delete_delisted: bool) -> DataFrame:
    actions = universe.resolve_requested(requested, instruments, KEEPS_UNKNOWN.get(exchange, True), delete_delisted)
    return actions.where("action = 'update'").select("symbol")


def _plan(wanted: DataFrame, store: DataFrame, instruments: DataFrame, exchange: str, now_ms: int, interval_ms: int, daily: DataFrame | None) -> DataFrame:
    resolved = wanted.join(append.last_times(store), "symbol", "left").join(instruments.select("symbol", "is_trading", "list_time", "delivery_time"), "symbol", "left")
    if daily is not None:
        resolved = resolved.join(bars.listing_dates(daily, wanted, now_ms), "symbol", "left")
    return fetch_plan(resolved, exchange.split("_")[0], now_ms, interval_ms)


def update_bars(
    incoming: DataFrame, store: DataFrame, instruments: DataFrame, requested: DataFrame, exchange: str, now_ms: int, interval_ms: int, delete_delisted: bool = False, daily: DataFrame | None = None
) -> Update:
    """(symbol, ts, ...) rows of ``incoming``, with pos, or file_no where archives come one by one, against ``store``; only symbols that resolve to an update count.

    ``daily`` has the daily bars (symbol, open_time) that tell when a symbol was listed, for exchanges that don't say.
    """
    base = exchange.split("_")[0]
    wanted = _wanted(requested, instruments, exchange, delete_delisted)
    plan = _plan(wanted, store, instruments, exchange, now_ms, interval_ms, daily)
    kinds = {"monotonic": append.append_monotonic, "static": append.append_static, "archives": append.append_archives}
    new = kinds[APPENDS[base]](incoming.join(wanted, "symbol", "left_semi"), store.select("symbol", "ts"), FLOORS[base])
    gone = universe.delete_set(instruments, store.select("symbol").distinct()) if delete_delisted else requested.limit(0)
    return Update(plan, new.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts"), append.append_counts(new), universe.purged(store, gone))


def apply_update(update: Update, table: VersionedTable, gone: DataFrame | None = None, token: str | None = None) -> int:
    """Commits an update to a versioned table: its new rows, once under the token, and then the symbols in ``gone`` leave. The table's version."""
    new = update.new.select(*(table.read().columns if table.version() else [c for c in update.new.columns if c not in ("pos", "file_no")]))
    version = table.append(new, token)
    return version if gone is None else table.remove(gone, None if token is None else f"{token} purge")


#: The order in which kinds of archives are taken.
KINDS = ("monthly", "daily", "funding")


def update_from_archives(
    spark: SparkSession, root: str, manifest: DataFrame, recent: DataFrame, store: DataFrame, instruments: DataFrame, requested: DataFrame, exchange: str, now_ms: int, interval_ms: int, layout: str = "bars_8"
) -> Update:
    """``update_bars`` from landed archives: of ``manifest`` (kind, symbol, date_ts) those are read that may hold something new in the windows which the plan asks for, then come ``recent`` rows (symbol, ts, ...).

    The archives to read are written as a table first, whose size tells Spark whether it can prune their folders.
    """
    plan = _plan(_wanted(requested, instruments, exchange, False), store, instruments, exchange, now_ms, interval_ms, None)
    archives = _written(wanted_archives(manifest, append.last_times(store), chunk_ranges(plan, now_ms)), "archives")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    file_no = rank[F.col("kind")].cast("long") * (1 << 52) + F.col("date_ts")
    rows = files.read_archives(spark, root, archives, layout).withColumn("file_no", file_no).withColumnRenamed("open_time", "ts").drop("kind", "date_ts")
    found = update_bars(rows, store, instruments, requested, exchange, now_ms, interval_ms)
    archived = _written(found.new.drop("file_no"), "archived")
    asked = recent.join(_wanted(requested, instruments, exchange, False), "symbol", "left_semi")
    new = archived.unionByName(append.append_static(asked, store.select("symbol", "ts").unionByName(archived.select("symbol", "ts")), FLOORS[exchange.split("_")[0]]))
    return Update(plan, new, append.append_counts(new), found.kept)


def update_funding(bulk: DataFrame, recent: DataFrame, store: DataFrame, floor: int = 0) -> DataFrame:
    """New funding rows: those of the archives beyond the store, then recent ones beyond both."""
    archived = append.append_archives(bulk, store, floor).select(recent.columns)
    return archived.unionByName(append.append_static(recent, store.select("symbol", "ts").unionByName(archived.select("symbol", "ts")), floor))


def verify_files(raw: DataFrame, rule: LineRule, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, summary, verdict)."""
    report = verify.file_report(raw, rule, listed)
    return report, verify.summary(report), verify.verdict(report)


def verify_store(spark: SparkSession, path: str, rule: LineRule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, summary, verdict) of all files below a path; files that can't be read have read_failed."""
    raw = files.scan_raw_lines(spark, path, skip_unreadable=True)
    return verify_files(raw, rule, files.with_read_failed(files.list_files(spark, path), raw))


def repair_files(raw: DataFrame, rule: LineRule) -> tuple[DataFrame, DataFrame]:
    """(lines, report): the lines of the files that need repair, after it, and the report of all files; clean files are not touched."""
    report = verify.file_report(raw, rule)
    return verify.repaired(raw, rule, report), verify.after_repair(report)


def repair_store(spark: SparkSession, path: str, rule: LineRule) -> DataFrame:
    """Repairs a store of lines, one folder ``file=...`` for each file, and returns the report.

    The report and the repaired lines are first written to the shared folder; then only the folders of dirty files are swapped.
    """
    raw = files.scan_raw_lines(spark, path, folders=True)
    verify.file_report(raw, rule).write.parquet(at := scratch(spark, "report"))
    report = spark.read.parquet(at)
    verify.repaired(raw, rule, report).write.parquet(at := scratch(spark, "repaired"))
    sinks.write_lines(spark.read.parquet(at), path)
    return verify.after_repair(report)


def load_lines(raw: DataFrame, table: VersionedTable) -> int:
    """Takes scanned lines (file, line_no, value, ...) into a versioned table by file; files that it has are replaced."""
    return table.replace(raw.select("file", "line_no", "value"))


def repair_table(table: VersionedTable, rule: LineRule) -> DataFrame:
    """Repairs a versioned table of lines and returns the report; only files that need it are written, and all of them change at once."""
    raw = table.read()
    report = _written(verify.file_report(raw, rule), "report")
    if not report.where("needs_repair").isEmpty():
        table.replace(verify.repaired(raw, rule, report).withColumnRenamed("line", "value"))
    return verify.after_repair(report)


def purge_table(table: VersionedTable, instruments: DataFrame) -> int:
    """Takes symbols that don't trade, or that the master doesn't have, out of a versioned table; its version."""
    return table.remove(universe.delete_set(instruments, table.keys().withColumnRenamed(table.key, "symbol")))


def _written(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(at := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)


def export_t6(store: DataFrame, interval_ms: int, path: str | None = None) -> DataFrame:
    """The exported records; with a path they are written there too, one folder per symbol, newest first, numbered by rec_no, in files of bounded size."""
    rows = bars.positions(bars.t6_records(store, interval_ms), "close_time", newest_first=True)
    if path is not None:
        sinks.write_parquet(rows, path, "rec_no")
        return rows.sparkSession.read.schema(rows.schema).parquet(path)
    return rows.repartitionByRange("symbol", "rec_no").sortWithinPartitions("symbol", "rec_no")
