"""The registered queries: every operator over inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.functions import lines, times
from barkeep.operators import append, bars, universe, verify
from barkeep.plans import bindings as b
from barkeep.plans import fetch, jobs
from barkeep.plans.rules import LineRule, line_rule_table
from barkeep.sources import files, sinks
from barkeep.sources.shared import scratch
from barkeep.sources.staging import Staging
from barkeep.sources.versions import VersionedTable

RULE = LineRule(6, salvage=True, interval_ms=times.HOUR)
FLOOR = 1420070400000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _unique(s: SparkSession, d: str) -> DataFrame:
    return verify.with_duplicates(verify.parsed(b.raw_lines(s, d), RULE)).where("is_first")


def _last_prices(s: SparkSession, d: str) -> DataFrame:
    return b.store(s, d).groupBy("symbol").agg(F.max("ts").alias("last_ts"))


# Scans


# The inputs are written as the files that are scanned, below the shared folder.


@registered
def scan_candles(s: SparkSession, d: str) -> DataFrame:
    sinks.write_csv(b.bars(s, d), path := scratch(s, "candles"))
    rows = files.scan_candles(s, path)
    return rows.select("symbol", "open_time", *[F.col(c).cast("long").alias(c) for c in ("open", "high", "low", "close", "volume")])


@registered
def scan_funding(s: SparkSession, d: str) -> DataFrame:
    rates = b.rates(s, d).select("symbol", F.col("ts").alias("funding_time"), F.col("rate").alias("funding_rate"))
    sinks.write_csv(rates, path := scratch(s, "funding"), "funding_time")
    return files.scan_funding(s, path).withColumn("funding_rate", F.col("funding_rate").cast("long"))


@registered
def scan_report(s: SparkSession, d: str) -> DataFrame:
    """Bars in files of three headers, by the length of the symbol: the layout's own, one without volume, and one that is quoted, in another order and has a column more. Files that fail are told."""
    made, path = b.bars(s, d), scratch(s, "landed")
    of = lambda n: made.where(F.length("symbol") % 3 == n)
    sinks.write_csv(of(0), f"{path}/plain")
    sinks.write_csv(of(1).drop("volume"), f"{path}/short")
    wide = of(2).select("symbol", "close", F.lit("a, b").alias("note"), "volume", "open_time", "open", "high", "low")
    wide.write.partitionBy("symbol").option("header", True).option("quoteAll", True).csv(f"{path}/wide")
    scan = files.scan_bars(s, [f"{path}/{n}" for n in ("plain", "short", "wide")])
    read = scan.rows.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.sum("close").cast("long").alias("sum_close"), F.count_if("is_corrupt").alias("n_corrupt"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(0).cast("long")
    failed = scan.failed.select(lines.symbol_of_file(F.col("file")).alias("symbol"), none.alias("n_rows"), none.alias("sum_close"), none.alias("n_corrupt"), "reason").distinct()
    return read.unionByName(failed)


@registered
def scan_raw_lines(s: SparkSession, d: str) -> DataFrame:
    sinks.write_lines(b.raw_lines(s, d).withColumnRenamed("value", "line"), path := scratch(s, "lines"))
    return files.scan_raw_lines(s, path, folders=True).select("file", "line_no", "value")


@registered
def scan_symbols_file(s: SparkSession, d: str) -> DataFrame:
    b.requested(s, d).write.option("header", True).csv(path := scratch(s, "symbols"))
    return files.scan_symbols_file(s, path)


@registered
def scan_instruments(s: SparkSession, d: str) -> DataFrame:
    b.instruments(s, d).write.json(path := scratch(s, "instruments"))
    rows = files.scan_instruments(s, path).select(*b.instruments(s, d).columns)
    return rows.withColumn("tags", F.array_join("tags", "|"))


@registered
def manifest_flatten(s: SparkSession, d: str) -> DataFrame:
    return files.flatten_manifest(b.manifest(s, d))


@registered
def store_inventory(s: SparkSession, d: str) -> DataFrame:
    return files.store_inventory(b.store(s, d))


# Lines


@registered
def clean_lines(s: SparkSession, d: str) -> DataFrame:
    raw = b.raw_lines(s, d)
    ended = raw.withColumn("value", F.when(F.col("line_no") % 10 == 0, "").when(F.col("line_no") % 7 == 0, F.concat("value", F.lit("\r"))).otherwise(F.col("value")))
    return verify.clean_lines(ended)


@registered
def split_fields(s: SparkSession, d: str) -> DataFrame:
    return verify.split_fields(b.raw_lines(s, d)).select("file", "line_no", F.size("fields").cast("long").alias("n_fields"), F.array_join("fields", "|").alias("fields"))


@registered
def valid_timestamp(s: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("-"), "value")).when(F.col("line_no") % 7 == 0, F.concat(F.lit("1234567"), "value")).otherwise(F.col("value"))
    field = F.element_at(lines.fields(odd), 1)
    return b.raw_lines(s, d).select("file", "line_no", field.alias("field"), lines.timestamp(field).alias("ts"))


@registered
def valid_records(s: SparkSession, d: str) -> DataFrame:
    return verify.parsed(b.raw_lines(s, d), RULE).where("accepted").select("file", "line_no", "ts")


@registered
def malformed_rows(s: SparkSession, d: str) -> DataFrame:
    return verify.parsed(b.raw_lines(s, d), RULE).where("not accepted").select("file", "line_no", "value")


@registered
def salvage_rows(s: SparkSession, d: str) -> DataFrame:
    return verify.parsed(b.raw_lines(s, d), RULE).where("salvaged").select("file", "line_no", "value", "line")


@registered
def canonical_header(s: SparkSession, d: str) -> DataFrame:
    wide = b.raw_lines(s, d).withColumn("value", F.when((F.col("line_no") == 1) & (F.length("file") > 5), F.concat("value", F.lit(",turnover"))).otherwise(F.col("value")))
    return verify.canonical_header(wide, RULE)


@registered
def out_of_order(s: SparkSession, d: str) -> DataFrame:
    return verify.out_of_order(verify.parsed(b.raw_lines(s, d), RULE)).where("out_of_order").select("file", "line_no", "ts")


@registered
def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return verify.with_duplicates(verify.parsed(b.raw_lines(s, d), RULE)).select("file", "line_no", "ts", "is_first")


@registered
def gaps(s: SparkSession, d: str) -> DataFrame:
    return verify.gaps(_unique(s, d), times.HOUR)


@registered
def gap_stats(s: SparkSession, d: str) -> DataFrame:
    return verify.gap_stats(b.bars(s, d), times.HOUR, "symbol", "open_time")


@registered
def file_report(s: SparkSession, d: str) -> DataFrame:
    return verify.file_report(b.raw_lines(s, d), RULE)


@registered
def verify_summary(s: SparkSession, d: str) -> DataFrame:
    return verify.summary(file_report(s, d))


@registered
def verify_verdict(s: SparkSession, d: str) -> DataFrame:
    return verify.verdict(file_report(s, d))


@registered
def gap_report_text(s: SparkSession, d: str) -> DataFrame:
    return verify.report_text(file_report(s, d))


@registered
def repair_rows(s: SparkSession, d: str) -> DataFrame:
    return verify.repaired(b.raw_lines(s, d), RULE)


@registered
def repair_versions(s: SparkSession, d: str) -> DataFrame:
    """All lines of a versioned table after its repair."""
    table = VersionedTable(s, scratch(s, "lines"), "file")
    jobs.load_lines(b.raw_lines(s, d), table)
    jobs.repair_table(table, RULE)
    return table.read()


@registered
def trim_torn_tail(s: SparkSession, d: str) -> DataFrame:
    return verify.torn_tails(b.unterminated(b.raw_lines(s, d)), RULE, FLOOR)


@registered
def resume_point(s: SparkSession, d: str) -> DataFrame:
    return verify.resume_points(b.unterminated(b.raw_lines(s, d)), RULE, FLOOR)


@registered
def verify_rules(s: SparkSession, d: str) -> DataFrame:
    return b.raw_lines(s, d).select("file").distinct().crossJoin(F.broadcast(line_rule_table(s)))  # 9 rules


@registered
def symbol_from_path(s: SparkSession, d: str) -> DataFrame:
    named = b.raw_lines(s, d).where("line_no = 1").select(F.concat(F.lit("/store/futures/"), "file", F.when(F.length("file") > 5, "_fr.csv").otherwise(".csv")).alias("path"))
    return named.select("path", lines.symbol_from_path(F.col("path")).alias("symbol"))


@registered
def legacy_seconds_guard(s: SparkSession, d: str) -> DataFrame:
    resume = resume_point(s, d).select(F.col("file").alias("symbol"), F.when(F.length("file") > 5, F.expr("resume_ts div 1000")).otherwise(F.col("resume_ts")).alias("last_ts"))
    return append.legacy_seconds(resume)


# Bars


@registered
def resample_bars(s: SparkSession, d: str) -> DataFrame:
    return bars.resample(b.bars(s, d, 5 * times.MINUTE), times.HOUR)


@registered
def sort_bars(s: SparkSession, d: str) -> DataFrame:
    return bars.positions(bars.sorted_bars(b.bars(s, d)), "open_time", False).select("symbol", "open_time", "close", "rec_no")


@registered
def t6_records(s: SparkSession, d: str) -> DataFrame:
    rows = bars.positions(bars.t6_records(b.bars(s, d), times.HOUR), "close_time", True)
    return rows.select("symbol", "close_time", "rec_no", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "f_val")])


@registered
def fixed_scale_format(s: SparkSession, d: str) -> DataFrame:
    price, volume = sinks.fixed_scale("close", "volume")
    return b.bars(s, d).select("symbol", "open_time", price.alias("close_text"), volume.alias("volume_text"))


@registered
def listing_date(s: SparkSession, d: str) -> DataFrame:
    symbols = b.ticks(s, d).select(F.explode(F.array("symbol", F.concat(F.lit("no-"), "symbol"))).alias("symbol")).distinct()
    return bars.listing_dates(b.bars(s, d, times.DAY), symbols, b.NOW_BARS)


@registered
def bootstrap_window(s: SparkSession, d: str) -> DataFrame:
    return bars.bootstrap(b.bars(s, d, 5 * times.MINUTE), b.NOW_BARS, 5 * times.MINUTE).select("symbol", "open_time", "close")


@registered
def align_down(s: SparkSession, d: str) -> DataFrame:
    return b.ticks(s, d).select("event_id", times.align_down(F.col("ts_ms"), 4 * times.HOUR).alias("aligned"))


@registered
def align_up(s: SparkSession, d: str) -> DataFrame:
    return b.ticks(s, d).select("event_id", times.align_up(F.col("ts_ms"), 4 * times.HOUR).alias("aligned"))


@registered
def last_completed_bar(s: SparkSession, d: str) -> DataFrame:
    return b.ticks(s, d).select("event_id", times.last_completed_bar(F.col("ts_ms"), times.HOUR).alias("completed"), (F.col("ts_ms") - times.MINUTE).alias("minute_ago"))


@registered
def interval_label(s: SparkSession, d: str) -> DataFrame:
    sizes = F.array(*[F.lit(m) for m in times.INTERVALS])
    rows = b.ticks(s, d).select("event_id", sizes[(F.col("event_id") % len(times.INTERVALS)).cast("int")].alias("minutes"))
    return rows.select("event_id", "minutes", times.interval_label(F.col("minutes")).alias("label"))


@registered
def supported_intervals(s: SparkSession, d: str) -> DataFrame:
    """Each event asks for a bar size at an exchange, valid or not."""
    exchange = F.element_at(F.array(*[F.lit(e) for e in ("binance", "okx", "mexc")]), (F.col("event_id") % 3 + 1).cast("int"))
    minutes = F.element_at(F.array(*[F.lit(m) for m in (*times.INTERVALS, 7)]), (F.col("event_id") % 16 + 1).cast("int"))
    return times.supported_intervals(b.ticks(s, d).select("event_id", exchange.alias("exchange"), minutes.alias("minutes")))


# Universe


@registered
def universe_filter(s: SparkSession, d: str) -> DataFrame:
    return universe.universes(b.instruments(s, d), b.TRADFI)


@registered
def exclude_tradfi(s: SparkSession, d: str) -> DataFrame:
    return universe.without_tradfi(b.instruments(s, d), b.TRADFI).select("symbol")


@registered
def split_active(s: SparkSession, d: str) -> DataFrame:
    return universe.split_active(b.instruments(s, d), True).select("symbol", "action")


@registered
def derive_inst_family(s: SparkSession, d: str) -> DataFrame:
    named = b.instruments(s, d).withColumn("symbol", F.when(F.col("contract_type") == "PERPETUAL", F.concat("symbol", F.lit("-"), "quote_asset", F.lit("-SWAP"))).otherwise(F.col("name")))
    return universe.with_family(named).select("symbol", "family")


@registered
def resolve_requested(s: SparkSession, d: str) -> DataFrame:
    return universe.resolve_everywhere(b.requested(s, d), b.instruments(s, d))


@registered
def delisted_on_disk(s: SparkSession, d: str) -> DataFrame:
    return universe.delisted_on_disk(store_inventory(s, d), b.instruments(s, d), active_only=True)


@registered
def end_bound(s: SparkSession, d: str) -> DataFrame:
    return universe.end_bounds(b.requested(s, d), b.instruments(s, d), b.NOW_ITEMS)


@registered
def start_bound(s: SparkSession, d: str) -> DataFrame:
    return universe.start_bounds(_last_prices(s, d), b.instruments(s, d))


@registered
def active_semi(s: SparkSession, d: str) -> DataFrame:
    return universe.active_requested(b.requested(s, d), b.instruments(s, d))


@registered
def union_instruments(s: SparkSession, d: str) -> DataFrame:
    master = b.instruments(s, d).select("symbol", "status", "is_trading")
    return universe.union_instruments(master.where("is_trading"), master.where("not is_trading or symbol like '%9'"))


@registered
def delete_set(s: SparkSession, d: str) -> DataFrame:
    return universe.delete_set(b.instruments(s, d), store_inventory(s, d))


@registered
def purge_delisted(s: SparkSession, d: str) -> DataFrame:
    return universe.purged(b.store(s, d), delete_set(s, d)).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max("ts").alias("last_ts"))


@registered
def purge_versions(s: SparkSession, d: str) -> DataFrame:
    """Funding rates in a versioned table, in two commits and then without the symbols that don't trade or aren't known."""
    table = VersionedTable(s, scratch(s, "rates"))
    for rows in b.funding(s, d):
        table.append(rows)
    jobs.purge_table(table, b.instruments(s, d))
    return table.read().groupBy("symbol").agg(F.count("*").alias("n_rows"), F.max("ts").alias("last_ts"))


# Append


@registered
def append_static(s: SparkSession, d: str) -> DataFrame:
    stored, incoming = b.funding(s, d)
    return append.append_static(incoming, stored)


@registered
def append_monotonic(s: SparkSession, d: str) -> DataFrame:
    stored, incoming = b.funding(s, d)
    return append.append_monotonic(incoming, stored)


@registered
def append_archives(s: SparkSession, d: str) -> DataFrame:
    stored, incoming = b.funding(s, d)
    rows = append.append_archives(incoming.withColumn("file_no", F.expr("pos div 5000")), stored)
    return rows.select(*incoming.columns, "file_no")


@registered
def append_counts(s: SparkSession, d: str) -> DataFrame:
    return append.append_counts(append_static(s, d))


@registered
def take_until_known(s: SparkSession, d: str) -> DataFrame:
    """Pages of days, newest first; within a page by order key."""
    stored, incoming = b.funding(s, d)
    pages = incoming.withColumn("page", -F.expr(f"ts div {times.DAY}"))
    return append.take_until_known(pages, stored.where("pos % 4 = 0")).select(*pages.columns)


@registered
def union_bulk_recent(s: SparkSession, d: str) -> DataFrame:
    stored, incoming = b.funding(s, d)
    return append.union_bulk_recent(stored, incoming)


@registered
def batch_name(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 100_000
    name = lines.batch_name(n)
    return b.ticks(s, d).select("event_id", name.alias("name"), lines.batch_number(name).alias("number"), lines.batch_number(F.concat(F.lit("x"), name)).alias("other"))


@registered
def merge_staged_batches(s: SparkSession, d: str) -> DataFrame:
    return append.merge_staged(append.staged_names(b.staged(s, d))).select("symbol", "batch_no", "pos", "open_time", "seq")


@registered
def recover_batches(s: SparkSession, d: str) -> DataFrame:
    staged = append.staged_names(b.staged(s, d))
    return append.recoverable(staged, staged.where("symbol = 'click'").select("symbol").distinct())


@registered
def recover_staged(s: SparkSession, d: str) -> DataFrame:
    """Two runs are left staged, one of them after its commit; both are in the table once."""
    rows = append.staged_names(b.staged(s, d)).drop("batch_name")
    stage, table = Staging(s, scratch(s, "staging")), VersionedTable(s, scratch(s, "merged"))
    stage.stage_all(rows.where("symbol <= 'm'"), "first")
    stage.stage_all(rows.where("symbol > 'm'"), "second")
    table.append(append.merge_staged(stage.batches("first")).drop("batch_no", "pos"), token="staged first")
    stage.recover(table)
    return table.read().select("symbol", "open_time", "close", "seq")


# Plans


@registered
def archive_intake(s: SparkSession, d: str) -> DataFrame:
    """Daily archives and recent bars against a store that ends fifteen days before now."""
    made, root = b.bars(s, d), scratch(s, "archives")
    day = (F.col("open_time") - F.col("open_time") % times.DAY).alias("date_ts")
    landed = made.where(F.col("open_time") < b.NOW_BARS - 3 * times.DAY).select(F.lit("daily").alias("kind"), day, *made.columns)
    landed.hint("rebalance", "symbol", "date_ts").write.partitionBy("kind", "symbol", "date_ts").option("header", True).csv(root)
    manifest = files.flatten_manifest(b.manifest(s, d)).where(F.col("date_ts") < b.NOW_BARS - 3 * times.DAY).select(F.lit("daily").alias("kind"), "symbol", "date_ts")
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    recent = made.where(F.col("open_time") >= b.NOW_BARS - 4 * times.DAY).select("symbol", F.col("open_time").alias("ts"), *prices)
    stored = made.where(F.col("open_time") < b.NOW_BARS - 15 * times.DAY).select("symbol", F.col("open_time").alias("ts"))
    symbols = made.select("symbol").distinct()
    master = symbols.select("symbol", F.lit(True).alias("is_trading"), F.lit(0).cast("long").alias("list_time"), F.lit(0).cast("long").alias("delivery_time"))
    found = jobs.update_from_archives(s, root, manifest, recent, stored, master, symbols, "okx", b.NOW_BARS, times.HOUR, layout="bars_6")
    return found.new.select("symbol", "ts", F.col("close").cast("long").alias("close"))


@registered
def manifest_prune(s: SparkSession, d: str) -> DataFrame:
    listed = files.flatten_manifest(b.manifest(s, d))
    kinds = listed.select(F.explode(F.array(*map(F.lit, fetch.SPANS))).alias("kind"), "symbol", "date_ts")
    resume = b.ticks(s, d).groupBy("symbol").agg((F.min("ts_ms") + 20 * times.DAY).alias("last_ts")).where("symbol <> 'click'")
    return fetch.prune_manifest(kinds, resume).select(*kinds.columns)


def _resolved(s: SparkSession, d: str) -> DataFrame:
    rows = b.requested(s, d).join(_last_prices(s, d), "symbol", "left").join(b.instruments(s, d).select("symbol", "is_trading", "list_time", "delivery_time"), "symbol", "left")
    rows = rows.withColumn("last_ts", F.when(F.col("symbol").endswith("3"), F.lit(None)).otherwise(F.col("last_ts")))
    daily = b.store(s, d).select("symbol", F.col("ts").alias("open_time"))
    return rows.join(bars.listing_dates(daily, b.requested(s, d), b.NOW_ITEMS), "symbol", "left")


@registered
def fetch_plan(s: SparkSession, d: str) -> DataFrame:
    return fetch.fetch_plans(_resolved(s, d), b.NOW_ITEMS, times.HOUR).select("exchange", "symbol", "start_ms", "end_ms", "nothing_new", "future_bar")


@registered
def chunk_ranges(s: SparkSession, d: str) -> DataFrame:
    plan = b.store(s, d).groupBy("symbol").agg(F.min("ts").alias("start_ms"))
    return fetch.chunk_ranges(plan, b.NOW_ITEMS)


