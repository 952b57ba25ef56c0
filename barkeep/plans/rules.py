"""What differs between exchanges, as tables of rules rather than branches in code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.functions.times import HOUR

# Resume floors; nothing is wanted from before these times.
FLOORS = {"binance": 1420070400000, "bybit": 1420070400000, "okx": 1420070400000, "hyperliquid": 1672531200000, "lighter": 1704067200000, "mexc": 1577836800000}


@dataclass(frozen=True)
class LineRule:
    """What an accepted line looks like. An interval of 0 turns the search for gaps off."""

    n_fields: int
    allow_more: bool = False
    salvage: bool = False
    interval_ms: int = HOUR


def line_rules(interval_ms: int = HOUR) -> dict[tuple[str, str], LineRule]:
    """The rule of each (exchange, data). Funding has no fixed rhythm, and Binance spot leaves bars without trades out."""
    six = LineRule(6, interval_ms=interval_ms)
    return {
        ("binance", "futures"): LineRule(12, interval_ms=interval_ms),
        ("binance", "spot"): LineRule(12, interval_ms=0),
        ("bybit", "bars"): LineRule(6, salvage=True, interval_ms=interval_ms),
        ("okx", "bars"): LineRule(8, interval_ms=interval_ms),
        ("hyperliquid", "bars"): six,
        ("lighter", "bars"): six,
        ("mexc", "futures"): LineRule(7, allow_more=True, interval_ms=interval_ms),
        ("mexc", "spot"): LineRule(7, allow_more=True, interval_ms=interval_ms),
        ("any", "funding"): LineRule(2, interval_ms=0),
    }


def line_rule_table(spark: SparkSession, interval_ms: int = HOUR) -> DataFrame:
    rows = [(*key, r.n_fields, r.allow_more, r.salvage, r.interval_ms) for key, r in line_rules(interval_ms).items()]
    return spark.createDataFrame(rows, "exchange string, data string, n_fields int, allow_more boolean, salvage boolean, interval_ms long")


# Rules of the exchanges. Of (exchange, data): quote asset, settlement asset, either of the two, contract type, text in the name, tags to leave out.
UNIVERSES: dict[tuple[str, str], dict[str, object]] = {
    ("binance", "futures"): {"quote": "USDT", "contract": "PERPETUAL"},
    ("binance", "spot"): {"quote": "USDT"},
    ("bybit", "futures"): {"quote": "USDT", "contract": "PERPETUAL"},
    ("bybit", "spot"): {"quote": "USDT"},
    ("okx", "bars"): {"either": "USDT"},
    ("okx", "funding"): {"settle": "USDT"},
    ("hyperliquid", "bars"): {},
    ("lighter", "bars"): {},
    ("mexc", "futures"): {"name": "USDT", "no_tradfi": True},
    ("mexc", "spot"): {"name": "USDT"},
}

# Parts of the tags of contracts on traditional assets.
TRADFI_TAGS = ("Stock", "stockindex", "Commodities", "Forex")


def tagged(tags: Column, parts: tuple[str, ...] = TRADFI_TAGS) -> Column:
    """Whether any tag contains one of the parts; no tags, no."""

    def has(tag: Column) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | tag.contains(part)
        return found

    return F.coalesce(F.exists(tags, has), F.lit(False))


def in_universe(exchange: str, data: str, tradfi: tuple[str, ...] = TRADFI_TAGS) -> Column:
    """The condition on the canonical columns of instruments."""
    rule, fits = UNIVERSES[exchange, data], F.lit(True)
    if "quote" in rule:
        fits = fits & (F.col("quote_asset") == rule["quote"])
    if "settle" in rule:
        fits = fits & (F.col("settle_asset") == rule["settle"])
    if "either" in rule:
        fits = fits & ((F.col("quote_asset") == rule["either"]) | (F.col("settle_asset") == rule["either"]))
    if "contract" in rule:
        fits = fits & (F.col("contract_type") == rule["contract"])
    if "name" in rule:
        fits = fits & F.col("name").contains(rule["name"])
    if "no_tradfi" in rule:
        fits = fits & ~tagged(F.col("tags"), tradfi)
    return fits


# Whether a requested symbol that the master doesn't know is kept, where nothing is to be deleted.
KEEPS_UNKNOWN = {"binance": True, "bybit_spot": True, "bybit_futures": False, "okx": True, "hyperliquid": False, "lighter": False, "mexc": True}

# Which new rows count: those in ascending order, all later than what is stored, or archive by archive.
APPENDS = {"binance": "monotonic", "bybit": "static", "okx": "archives", "hyperliquid": "static", "lighter": "static", "mexc": "monotonic"}

# How a back-fill starts and ends. Starts: the last stored time, that or the listing, that or a bounded history, the bar after it, that or the first day with bars. Ends: delivery or shortly before now, now, the last completed bar.
FETCHES = {
    "binance": ("last", "delivery"),
    "bybit": ("last", "delivery"),
    "okx": ("listing", "now"),
    "hyperliquid": ("bootstrap", "now"),
    "lighter": ("probe", "now"),
    "mexc": ("next_bar", "completed"),
}
