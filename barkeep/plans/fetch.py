"""Plans of what to fetch, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeep.functions.times import DAY, MINUTE, last_completed_bar
from barkeep.plans.rules import FETCHES, FLOORS

# How long an archive reaches from its date: it is kept if that may lie after the resume point.
SPANS = {"daily": DAY, "monthly": 30 * DAY, "funding": 31 * DAY}
#: Windows of archive requests; monthly ones are used up to RECENT before now.
MONTHLY_WINDOW, DAILY_WINDOW, RECENT = 19 * 30 * DAY, 19 * DAY, 30 * DAY
#: Bars that are fetched for a symbol without history, where only a bounded history is offered.
FIRST_BARS = 5000


def prune_manifest(archives: DataFrame, resume: DataFrame) -> DataFrame:
    """Of (kind, symbol, date_ts, ...): the archives that may hold rows after the symbol's last_ts, or all dated ones of a symbol without one."""
    spans = F.create_map(*[F.lit(x) for pair in SPANS.items() for x in pair])
    rows = archives.join(resume.select("symbol", "last_ts"), "symbol", "left")
    return rows.where(F.col("date_ts") + spans[F.col("kind")] > F.coalesce("last_ts", F.lit(-(2**63)))).drop("last_ts")


def wanted_archives(archives: DataFrame, resume: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct (kind, symbol, date_ts) of the archives that may hold rows after the symbol's last_ts and reach into one of its ``ranges`` (symbol, kind, from_ms, to_ms)."""
    spans = F.create_map(*[F.lit(x) for pair in SPANS.items() for x in pair])
    listed = prune_manifest(archives, resume).select("kind", "symbol", "date_ts").distinct()
    reaches = (F.col("date_ts") < F.col("to_ms")) & (F.col("date_ts") + spans[F.col("kind")] > F.col("from_ms"))
    return listed.join(ranges, ["kind", "symbol"]).where(reaches).select("kind", "symbol", "date_ts").distinct()


def _planned(exchange: str, now_ms: int, interval_ms: int) -> dict[str, Column]:
    """start_ms, end_ms, nothing_new and future_bar of a row of ``resolved`` under the rule of an exchange."""
    start_by, end_by = FETCHES[exchange]
    last, now = F.coalesce("last_ts", F.lit(FLOORS[exchange])), F.lit(now_ms)
    completed = last_completed_bar(now, interval_ms)
    starts: dict[str, Column] = {
        "last": last,
        "listing": F.greatest(last, F.when(F.col("list_time") > 0, F.col("list_time")).otherwise(last)),
        "bootstrap": F.coalesce("last_ts", F.lit(now_ms - FIRST_BARS * interval_ms)),
        "next_bar": last + interval_ms,
        "probe": F.coalesce("last_ts", "listed", F.when(F.col("list_time") > 0, F.col("list_time")), F.lit(FLOORS[exchange])),
    }
    delivered = ~F.coalesce("is_trading", F.lit(True)) & (F.col("delivery_time") > 0)
    ends: dict[str, Column] = {"delivery": F.when(delivered, F.col("delivery_time")).otherwise(now - MINUTE), "now": now, "completed": completed}
    start, end = starts[start_by], ends[end_by]
    return {"start_ms": start, "end_ms": end, "nothing_new": start > end, "future_bar": last > completed}


def _with_listed(resolved: DataFrame) -> DataFrame:
    return resolved if "listed" in resolved.columns else resolved.withColumn("listed", F.lit(None).cast("long"))


def fetch_plan(resolved: DataFrame, exchange: str, now_ms: int, interval_ms: int) -> DataFrame:
    """(symbol, start_ms, end_ms, nothing_new, future_bar) of (symbol, last_ts, is_trading, list_time, delivery_time[, listed]); last_ts is null without history, listed is the first day with bars."""
    return _with_listed(resolved).select("symbol", *[c.alias(n) for n, c in _planned(exchange, now_ms, interval_ms).items()])


def fetch_plans(resolved: DataFrame, now_ms: int, interval_ms: int) -> DataFrame:
    """The plans of all exchanges over one list of symbols, in one pass."""
    plans = [F.struct(F.lit(e).alias("exchange"), *[c.alias(n) for n, c in _planned(e, now_ms, interval_ms).items()]) for e in FETCHES]
    rows = _with_listed(resolved).select("symbol", F.explode(F.array(*plans)).alias("x"))
    return rows.select("symbol", "x.start_ms", "x.end_ms", "x.nothing_new", "x.future_bar", "x.exchange")


def chunk_ranges(plan: DataFrame, now_ms: int) -> DataFrame:
    """(symbol, kind, from_ms, to_ms): monthly windows from start_ms until RECENT before now, then daily windows until now."""
    old = F.lit(now_ms - RECENT) - F.col("start_ms")
    n_monthly = F.when(old > 0, F.ceil(old / MONTHLY_WINDOW)).otherwise(0)
    rows = plan.withColumn("n_monthly", n_monthly)
    rows = rows.withColumn("daily_from", F.least(F.col("start_ms") + F.col("n_monthly") * MONTHLY_WINDOW, F.greatest(F.lit(now_ms), F.col("start_ms"))))
    rows = rows.withColumn("n_daily", F.greatest(F.ceil((F.lit(now_ms) - F.col("daily_from")) / DAILY_WINDOW), F.lit(0)))

    def windows(kind: str, n: str, first: str, width: int) -> DataFrame:
        numbered = rows.where(F.col(n) > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
        start = F.col(first) + F.col("i") * width
        return numbered.select("symbol", F.lit(kind).alias("kind"), start.alias("from_ms"), F.least(start + width, F.lit(now_ms)).alias("to_ms"))

    return windows("monthly", "n_monthly", "start_ms", MONTHLY_WINDOW).unionByName(windows("daily", "n_daily", "daily_from", DAILY_WINDOW))
