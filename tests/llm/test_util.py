"""Joins of hot keys and filters by bits, held against plain joins."""

from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barkeep.llm import _util


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [0, 50, 10**9])
def test_hot_keys_are_joined_as_others(spark, monkeypatch, how, limit):
    """Keys with most of the rows, null keys, keys without a partner, and columns named as the join's own."""
    monkeypatch.setattr(_util, "HOT_ROWS", limit)
    monkeypatch.setattr(_util, "HOT_SHARE", 10)
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 40)
    rows = spark.range(600).select(key.cast("long").alias("k"), "id", F.lit("p").alias("part"), F.lit("q").alias("parts"))
    other = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("value"))
    hot = _util.hot_keys(rows.groupBy("k").count(), "k", "count", rows.count())
    assert len(hot) <= 10 and (limit > 600 or 7 in {h[0] for h in hot}) and all(h[0] is not None for h in hot)
    found = _util.spread_join(rows, other, "k", hot, ["id"], how)
    want = rows.join(other, "k", how)
    assert found.columns == want.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_hot_key_goes_to_several_tasks(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("k"), "id")
    other = spark.createDataFrame([(1, "a")], "k long, value string")
    hot = _util.hot_keys(rows.groupBy("k").count(), "k", "count", 4000)
    assert hot == [(1, 20)]
    assert _util.spread_join(rows, other, "k", hot, ["id"]).count() == 4000


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_wanted_rows_are_never_dropped(spark, monkeypatch, bits):
    monkeypatch.setattr(_util, "WANTED_BITS", bits)
    rows = spark.range(5000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("word"), F.lit(2).alias("bits"))
    wanted = rows.where("id % 100 = 0").select("key")
    found = _util.among(rows, "key", wanted)
    assert found.columns == rows.columns
    ids = {r["id"] for r in found.collect()}
    assert {*range(0, 5000, 100)} <= ids and (bits == 64 or len(ids) < 70)
    assert _util.among(rows, "key", wanted.limit(0)).count() == 0


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert _util.free_name(df, "b") == "b" and _util.free_name(df, "a") == "a__"


def test_long_rows_go_in_small_batches(spark):
    """Neither Arrow batches nor those of a Parquet scan hold many long rows, whatever their number of rows allows."""
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        _util.small_reads(spark)
        rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("long "), 20_000).alias("text"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
        assert max(r["n"] for r in sizes) <= _util.BATCH_BYTES + 200_000
        assert int(spark.conf.get(keys[1])) <= _util.READ_ROWS
        spark.conf.set(keys[0], "256k")
        _util.small_reads(spark)
        assert spark.conf.get(keys[0]) == "256k"  # smaller ones stay
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_of_long_rows_have_small_row_groups(spark):
    noise = F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 512) for i in range(40)])
    found = _util.written(spark.range(0, 2000, 1, 1).select("id", noise.alias("text")), "long", small=True)
    [path] = found.inputFiles()
    parts = pq.ParquetFile(urlparse(path).path).metadata
    assert found.count() == 2000 and max(parts.row_group(i).total_byte_size for i in range(parts.num_row_groups)) < 3 * _util.GROUP_BYTES
