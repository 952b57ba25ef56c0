"""Scans of landed files. Schemas are given, never inferred."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barkeep.functions.lines import csv_fields as lines_csv
from barkeep.functions.lines import decoded, file_of_folder, symbol_of_file
from barkeep.sources.headers import HeaderRegistry, clean_header
from barkeep.sources.shared import scratch

# The columns of each layout, in the order of the files.
LAYOUTS = {
    "bars_12": "close_time long, open double, high double, low double, close double, volume double, timestamp long, quote_av double, trades long, tb_base_av double, tb_quote_av double, ignore string",
    "bars_6": "open_time long, open double, high double, low double, close double, volume double",
    "bars_8": "open_time long, open decimal(38,8), high decimal(38,8), low decimal(38,8), close decimal(38,8), volume decimal(38,10), vol_ccy decimal(38,10), vol_ccy_quote decimal(38,10)",
    "bars_7_fut": "open_time long, open decimal(38,8), high decimal(38,8), low decimal(38,8), close decimal(38,8), volume decimal(38,10), amount decimal(38,10)",
    "bars_7_spot": "open_time long, open decimal(38,8), high decimal(38,8), low decimal(38,8), close decimal(38,8), volume decimal(38,10), quote_asset_volume decimal(38,10)",
    "funding": "funding_time long, funding_rate double",
}
INSTRUMENTS = "exchange string, symbol string, name string, inst_family string, contract_type string, quote_asset string, settle_asset string, status string, is_trading boolean, list_time long, delivery_time long, tags array<string>"
#: Before any date of an archive.
NO_DATE = -(2**62)
SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:").match


def _file() -> Column:
    return F.col("_metadata.file_path").alias("file")


@dataclass(frozen=True)
class Scan:
    """``rows`` of the files that can be read, with file and is_corrupt; ``failed`` (file, reason) of the others."""

    rows: DataFrame
    failed: DataFrame

    def corrupt(self) -> DataFrame:
        """(file, n_corrupt) of the files with lines that don't parse."""
        return self.rows.where("is_corrupt").groupBy("file").agg(F.count("*").alias("n_corrupt"))


def _by_name(spark: SparkSession, path: str | list[str], layout: str, wanted: tuple[str, ...], registry: HeaderRegistry | None) -> Scan:
    """Scans delimited files whose headers name the columns, in any order and with others between.

    A header that is the layout's own needs no lookup; of files with another one the places of the wanted columns are joined by
    file. A line that doesn't parse is kept and marked; lines that repeat their file's header, and empty ones, are left out. Files
    that can't be read or lack a wanted column are left out and listed.
    """
    kinds = dict(c.strip().split(" ", 1) for c in re.split(r",(?![^(]*\))", LAYOUTS[layout]))
    known = (registry or HeaderRegistry(spark, scratch(spark, "headers"))).update(path)
    names = F.transform(lines_csv(F.col("header")), lambda n: F.trim(n))
    lacking = F.array_except(F.array(*map(F.lit, wanted)), names)
    known = known.withColumn("reason", F.when(F.col("header").isNull(), "it can't be read").when(F.size(lacking) > 0, F.concat(F.lit("no column "), F.array_join(lacking, ", "))))
    own = ",".join(kinds)
    odd = known.where(F.col("header").isNull() | (F.col("header") != own))
    odd = odd.select("file", F.col("header").alias("odd_header"), "reason", F.size(names).alias("odd_n"), F.array(*[F.array_position(names, c).cast("int") for c in wanted]).alias("odd_places"))
    read = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).text(path).select(_file(), clean_header(F.col("value")).alias("value"))
    rows = read.join(odd, "file", "left").where(F.col("reason").isNull() & (F.col("value") != "") & (F.col("value") != F.coalesce("odd_header", F.lit(own))))
    places = F.coalesce("odd_places", F.array(*[F.lit(list(kinds).index(c) + 1) for c in wanted]))
    rows = rows.select("file", lines_csv(F.col("value")).alias("fields"), places.alias("places"), F.coalesce("odd_n", F.lit(len(kinds))).alias("n"))
    texts = [F.get("fields", F.get("places", F.lit(i)) - 1) for i in range(len(wanted))]
    values = [F.when(t != "", t.try_cast(kinds[c])) for c, t in zip(wanted, texts, strict=True)]
    bad = F.size("fields") != F.col("n")
    for text, value in zip(texts, values, strict=True):
        bad = bad | F.coalesce((text != "") & value.isNull(), F.lit(False))
    rows = rows.select("file", *[v.alias(c) for c, v in zip(wanted, values, strict=True)], bad.alias("is_corrupt"))
    return Scan(rows, known.where("reason is not null").select("file", "reason"))


def _strict(scan: Scan) -> DataFrame:
    if first := scan.failed.orderBy("file").first():
        raise ValueError(f"{first['reason']} in {unquote(first['file'])} and {scan.failed.count() - 1} other files")
    return scan.rows


def scan_bars(spark: SparkSession, path: str | list[str], layout: str = "bars_6", registry: HeaderRegistry | None = None) -> Scan:
    """The columns that all layouts have, by the names in each file's header, as rows (file, symbol, open_time, open, high, low, close, volume, is_corrupt), and the files that failed.

    With a registry only files that are new or have changed are read for their headers.
    """
    opened = "timestamp" if layout == "bars_12" else "open_time"
    scan = _by_name(spark, path, layout, (opened, "open", "high", "low", "close", "volume"), registry)
    rows = scan.rows.select("file", symbol_of_file(F.col("file")).alias("symbol"), F.col(opened).alias("open_time"), "open", "high", "low", "close", "volume", "is_corrupt")
    return Scan(rows, scan.failed)


def scan_candles(spark: SparkSession, path: str | list[str], layout: str = "bars_6", registry: HeaderRegistry | None = None) -> DataFrame:
    """The rows of ``scan_bars`` without file; a file that failed is an error here."""
    return _strict(scan_bars(spark, path, layout, registry)).drop("file")


def scan_funding_files(spark: SparkSession, path: str | list[str], registry: HeaderRegistry | None = None) -> Scan:
    """(file, symbol, funding_time, funding_rate, is_corrupt), by the names in each file's header, and the files that failed."""
    scan = _by_name(spark, path, "funding", ("funding_time", "funding_rate"), registry)
    return Scan(scan.rows.select("file", symbol_of_file(F.col("file")).alias("symbol"), "funding_time", "funding_rate", "is_corrupt"), scan.failed)


def scan_funding(spark: SparkSession, path: str | list[str], registry: HeaderRegistry | None = None) -> DataFrame:
    """(symbol, funding_time, funding_rate); a file that failed is an error here."""
    return _strict(scan_funding_files(spark, path, registry)).select("symbol", "funding_time", "funding_rate")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size) of all files that hold a byte, also of unreadable ones; their content is not read. Spark leaves empty files out."""
    return spark.read.format("binaryFile").load(path).select(_file(), F.col("length").alias("file_size"))


def with_read_failed(listed: DataFrame, raw: DataFrame) -> DataFrame:
    """``listed`` (file, file_size) with read_failed: the file has bytes, but no line of it could be read."""
    read = raw.select("file").distinct().withColumn("was_read", F.lit(True))
    return listed.join(read, "file", "left").withColumn("read_failed", F.col("was_read").isNull() & (F.col("file_size") > 0)).drop("was_read")


def scan_raw_lines(spark: SparkSession, path: str, skip_unreadable: bool = False, folders: bool = False) -> DataFrame:
    """(file, file_size, line_no, value, terminated): the lines of each file in their order, from 1.

    A file is read in several splits. Lines are numbered within their split and the lines of the splits
    before are added, so no file is one task's burden. With folders, a folder ``file=...`` counts as one file: its files go on
    from one another in order of their names. Files without any byte, and with
    skip_unreadable those that can't be read, yield no row: ``list_files`` and ``with_read_failed`` tell the latter.
    """
    read = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", skip_unreadable).text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.first(F.when(F.col("block") == 0, F.col("size"))).alias("size"))
    splits = splits.withColumn("file", file_of_folder(F.col("path")) if folders else F.col("path"))
    earlier = Window.partitionBy("file").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    splits = splits.select("file", "path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), *[F.sum(c).over(whole).alias(c) for c in ("n", "bytes", "size")])
    inner = F.row_number().over(Window.partitionBy("path", "block").orderBy("id"))
    numbered = lines.drop("size").withColumn("inner", inner).join(splits, ["path", "block"]).withColumn("line_no", (F.col("before") + F.col("inner")).cast("long"))
    ended = ~((F.col("line_no") == F.col("n")) & (F.col("bytes") == F.col("size") + 1))
    return numbered.select("file", F.col("size").alias("file_size"), "line_no", "value", ended.alias("terminated"))


def scan_symbols_file(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) from the column ``Symbol`` or ``symbol``; without either no rows, which means all symbols."""
    rows = spark.read.option("header", True).csv(path)
    exact = [c for c in ("Symbol", "symbol") if c in rows.columns]
    if not exact:
        return spark.createDataFrame([], "symbol string")
    return rows.select(F.col(exact[0]).alias("symbol")).where("symbol is not null")


def scan_instruments(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return spark.read.schema(INSTRUMENTS).format(file_format).load(path)


def flatten_manifest(manifest: DataFrame) -> DataFrame:
    """(symbol, date_ts, url) of nested listings details[].group_details[]."""
    groups = manifest.select("symbol", F.explode("details").alias("d"))
    return groups.select("symbol", F.explode("d.group_details").alias("f")).select("symbol", "f.date_ts", "f.url")


def scan_archives(spark: SparkSession, paths: list[str], layout: str = "bars_6") -> DataFrame:
    """The rows of selected archives, plain or gzip, with file_no in the order of ``paths``; their columns go by position, as archives may lack a header's names.

    All paths have a scheme, or none has.
    """
    with_scheme = {bool(SCHEME(p)) for p in paths}
    if len(with_scheme) > 1:
        raise ValueError("archives with and without a scheme in their paths")
    rows = spark.read.schema(LAYOUTS[layout]).option("header", True).csv(paths).withColumn("file", F.col("_metadata.file_path"))
    if with_scheme == {True}:
        own, keys = F.regexp_replace(decoded(F.col("file")), "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/"), [re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", p) for p in paths]
    else:
        own, keys = F.regexp_replace(decoded(F.col("file")), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), list(paths)
    numbers = spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "key string, file_no int")
    return rows.withColumn("key", own).join(numbers, "key").drop("key", "file")


def read_archives(spark: SparkSession, root: str, wanted: DataFrame, layout: str = "bars_6") -> DataFrame:
    """The rows of the archives ``wanted`` (kind, symbol, date_ts) below folders kind=.../symbol=.../date_ts=..., with these three columns.

    The scan is joined with ``wanted``, by which Spark leaves out the folders of all other archives before it reads; where
    ``wanted`` is too large to broadcast only the join leaves them out. Columns go by position.
    """
    key = ["kind", "symbol", "date_ts"]
    rows = spark.read.schema(f"{LAYOUTS[layout]}, kind string, symbol string, date_ts long").option("header", True).csv(root)
    return rows.join(wanted.where(F.col("date_ts") > NO_DATE), key, "left_semi")


def store_inventory(store: DataFrame) -> DataFrame:
    """(symbol) of all that is stored; on a store partitioned by symbol only partitions are read."""
    return store.select("symbol").distinct()
