"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, a temporary folder is taken, but in local mode only: on a cluster
    the executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-barkeep-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a row group, and of a page, of tables with long rows: writers hold a group in memory, and readers a column of it.
GROUP_BYTES, PAGE_BYTES = 1 << 20, 1 << 18


def written(df: DataFrame, name: str, compression: str | None = None, small: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again, which cuts its lineage; in small row groups if its rows are long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES} if small else {}
    df.write.options(**sizes).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than one in HOT_SHARE of all rows, and more than HOT_ROWS of them.
HOT_SHARE, HOT_ROWS = 256, 200


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> list[tuple]:
    """(key, parts) of the hot keys in a table of counts: so many parts that each is no longer hot. There are HOT_SHARE at the most."""
    limit = max(HOT_ROWS, total // HOT_SHARE)
    rows = counts.where(F.col(key).isNotNull() & (F.col(count) > limit)).select(key, F.ceil(F.col(count) / limit).cast("int"))
    return [tuple(r) for r in rows.collect()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(rows: DataFrame, other: DataFrame, key: str, hot: list[tuple], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other``, which has one row for each key: rows of the given hot keys go to several tasks.

    A row's part follows from a hash of the columns ``by``; ``other`` has a copy of a hot key's row for each of its parts.
    """
    if not hot:
        return rows.join(other, key, how)
    parts_of, part = free_name(rows, "parts"), free_name(rows, "part")
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} {other.schema[key].dataType.simpleString()}, {parts_of} int"))
    dealt = rows.join(parts, key, "left").withColumn(part, F.pmod(F.xxhash64(*by), F.coalesce(parts_of, F.lit(1)))).drop(parts_of)
    copies = other.join(parts, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts_of, F.lit(1)).cast("long") - 1))).drop(parts_of)
    return dealt.join(copies, [key, part], how).drop(part)


#: Bits of the table that stands for a set of keys in ``among``.
WANTED_BITS = 1 << 23


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ``wanted``, and few others, as long as these are fewer than about WANTED_BITS / 8.

    The hash of each wanted key sets a bit of a table of fixed size (two megabytes), which is broadcast; so
    rows that no join needs are dropped where they are read. Exactness is left to that join.
    """
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(WANTED_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    own = wanted.columns[0]
    word, bits, at = free_name(rows, "word"), free_name(rows, "bits"), free_name(rows, "at")
    table = wanted.select(place(F.col(own)).alias(at)).groupBy(F.floor(F.col(at) / 64).alias(word)).agg(F.bit_or(bit(F.col(at))).alias(bits))
    probed = rows.withColumn(at, place(F.col(key))).withColumn(word, F.floor(F.col(at) / 64)).join(F.broadcast(table), word)
    return probed.where(F.col(bits).bitwiseAND(bit(F.col(at))) != 0).drop(word, bits, at)


#: Rows of an Arrow batch on its way to Python and back: whole texts are long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Bytes of an Arrow batch, about, and rows that a scan of Parquet decodes at once, where rows hold whole texts or sets.
BATCH_BYTES, READ_ROWS = 4 << 20, 128


def small_reads(spark: SparkSession) -> None:
    """Bounds the bytes of this session's Arrow batches and the rows of its Parquet batches, so that an executor holds few long rows at a time."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < as_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def as_bytes(size: str) -> int:
    """A size of Spark's settings, as 262144, 256k or 64MB."""
    number = size.strip().lower().removesuffix("b")
    unit = "kmgtp".find(number[-1:]) + 1 if number[-1:] else 0
    return int(number[:-1] if unit else number) << 10 * unit


def long_table(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """A small table of equally long lists of integers, as JVM-side literals."""
    names = list(columns)
    fields = [F.split(F.lit(" ".join(map(str, columns[n]))), " ") for n in names]
    rows = spark.range(1).select(F.explode(F.arrays_zip(*[f.alias(n) for f, n in zip(fields, names)])).alias("x"))
    out = rows.select(*[F.col("x").getField(n).cast("long").alias(n) for n in names])
    return out if columns[names[0]] else out.limit(0)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
