"""Inputs of the operators, derived from general tables: events give ticks, bars and raw lines; orders funding; parts instruments; line items what is stored and wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barkeep.functions.times import DAY, HOUR, epoch_ms
from barkeep.operators.bars import bars_of_ticks

# The damage to raw lines by position, the first that fits; see damaged().
TORN, REPEATED, EXTRA, COMMA, SWAPPED = 97, 89, 83, 79, 71
HEADER = "open_time,open,high,low,close,volume"
#: "Now" of the bars and of the line items.
NOW_BARS, NOW_ITEMS = 1_706_745_600_000, 900_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), epoch_ms(F.col("ts")).alias("ts_ms"), F.round(F.col("value") * 100).cast("long").alias("px"), "event_id")


def bars(spark: SparkSession, sf_dir: str, interval_ms: int = HOUR) -> DataFrame:
    return bars_of_ticks(ticks(spark, sf_dir), interval_ms)


def damaged(made: DataFrame) -> DataFrame:
    """(file, line_no, value) of bars as text, with torn, repeated, wide, comma-ended and swapped lines, and a header at line 1."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("open_time"))
    rows = made.select(F.col("symbol").alias("file"), n.alias("n"), F.concat_ws(",", *[F.col(c).cast("string") for c in HEADER.split(",")]).alias("text"))
    hit = lambda m: F.col("n") % m == 0
    value = F.when(hit(TORN), F.substring("text", 1, 20)).when(hit(REPEATED), F.col("text")).when(hit(EXTRA), F.concat("text", F.lit(",0"))).when(hit(COMMA), F.concat("text", F.lit(",")))
    swapped = ~hit(TORN) & ~hit(REPEATED) & ~hit(EXTRA) & ~hit(COMMA) & hit(SWAPPED)
    body = rows.select("file", value.otherwise(F.col("text")).alias("value"), (2 * F.col("n") + F.when(swapped, 3).otherwise(0)).cast("long").alias("pos"))
    again = rows.where(~hit(TORN) & hit(REPEATED)).select("file", F.col("text").alias("value"), (F.lit(2_000_000_000).cast("long") + F.col("n")).alias("pos"))
    head = rows.select("file").distinct().select("file", F.lit(HEADER).alias("value"), F.lit(0).cast("long").alias("pos"))
    order = Window.partitionBy("file").orderBy("pos")
    return body.unionByName(again).unionByName(head).select("file", F.row_number().over(order).cast("long").alias("line_no"), "value")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(bars(spark, sf_dir))


def unterminated(raw: DataFrame) -> DataFrame:
    """Adds terminated: the last line of every file lacks its newline."""
    return raw.withColumn("terminated", F.col("line_no") < F.max("line_no").over(Window.partitionBy("file")))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, rate, pos) of all orders."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("symbol"), epoch_ms(F.col("o_orderdate")).alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("rate"), F.col("o_orderkey").alias("pos")
    )


def funding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming): even order keys before a time are stored."""
    rows = rates(spark, sf_dir)
    stored = rows.where("pos % 2 = 0 and ts < 800000000000")
    return stored, rows.where("pos % 2 = 1")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    quote = F.when(size % 3 == 0, "USDT").when(size % 3 == 1, "USDC").otherwise("BTC")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("symbol"),
        F.concat(F.lit("P"), key.cast("string"), F.lit("_"), quote).alias("name"),
        F.when(size % 6 == 0, F.concat(F.lit("F"), size.cast("string"))).alias("inst_family"),
        F.when(key % 5 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contract_type"),
        quote.alias("quote_asset"),
        F.when(size % 2 == 0, "USDT").otherwise("BTC").alias("settle_asset"),
        F.when(key % 7 == 0, "SETTLING").otherwise("TRADING").alias("status"),
        (key % 7 != 0).alias("is_trading"),
        F.when(size % 5 == 0, F.lit(0).cast("long")).otherwise(F.lit(700_000_000_000) + size * F.lit(DAY)).alias("list_time"),
        F.when(size % 4 == 0, F.lit(850_000_000_000) + size * F.lit(DAY)).otherwise(F.lit(0).cast("long")).alias("delivery_time"),
        F.array("p_type", "p_brand").alias("tags"),
    )


#: Parts of tags that stand for traditional assets among the parts.
TRADFI = ("PROMO", "ECONOMY")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts): what is stored; the symbols of suppliers up to 20 are not in the master."""
    items = table(spark, sf_dir, "lineitem")
    known = items.select(F.col("l_partkey").cast("string").alias("symbol"), epoch_ms(F.col("l_shipdate")).alias("ts"))
    other = items.where("l_suppkey <= 20").select((F.col("l_suppkey") + 1_000_000).cast("string").alias("symbol"), epoch_ms(F.col("l_shipdate")).alias("ts"))
    return known.unionByName(other)


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    known = items.where("l_linenumber = 1 and l_partkey % 11 = 0").select(F.col("l_partkey").cast("string").alias("symbol"))
    other = items.where("l_suppkey <= 10").select((F.col("l_suppkey") + 1_000_000).cast("string").alias("symbol"))
    return known.unionByName(other).distinct()


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, details): one listed archive per symbol and day, nested by month."""
    day = ticks(spark, sf_dir).select("symbol", (F.col("ts_ms") - F.col("ts_ms") % DAY).alias("date_ts")).distinct()
    url = F.concat("symbol", F.lit("/"), F.col("date_ts").cast("string"), F.lit(".zip"))
    groups = day.withColumn("month", F.expr(f"date_ts div {30 * DAY}")).groupBy("symbol", "month").agg(F.collect_list(F.struct("date_ts", url.alias("url"))).alias("group_details"))
    return groups.groupBy("symbol").agg(F.collect_list(F.struct("group_details")).alias("details"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, batch_name, pos, open_time, close): hourly bars staged newest first, 100 to a batch; batch 3 is lost."""
    made = bars(spark, sf_dir).select("symbol", "open_time", "close")
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time"))) - 1
    rows = made.withColumn("back", back).withColumn("batch", F.expr("back div 100") + 1)
    name = F.concat(F.lit("batch_"), F.lpad(F.col("batch").cast("string"), 5, "0"))
    return rows.where("batch <> 3").select("symbol", name.alias("batch_name"), (99 - F.col("back") % 100).cast("int").alias("pos"), "open_time", "close")
