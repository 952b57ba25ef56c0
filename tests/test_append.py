"""New rows, universes, plans, bars and streams on small cases."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from barkeep.functions import lines, times
from barkeep.operators import append, bars, universe
from barkeep.plans import fetch, jobs
from barkeep.plans.rules import LineRule, in_universe
from barkeep.sources import files, sinks
from barkeep.streaming.append import stream_append, stream_distinct

ROWS = "symbol string, ts long, pos long"


@pytest.fixture
def overlap(spark):
    """Stored until 2; a page brings 2, 3, 3, 4."""
    stored = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, ts long")
    return stored, spark.createDataFrame([("A", 2, 0), ("A", 3, 1), ("A", 3, 2), ("A", 4, 3)], ROWS)


def taken(df) -> list[int]:
    return [r["ts"] for r in df.orderBy("pos").collect()]


def test_page_overlap(overlap):
    stored, page = overlap
    assert taken(append.append_static(page, stored)) == [3, 3, 4]
    assert taken(append.append_monotonic(page, stored)) == [3, 4]


def test_append_twice_is_append_once(overlap):
    stored, page = overlap
    new = append.append_monotonic(page, stored)
    assert append.append_monotonic(page, stored.union(new.select("symbol", "ts"))).count() == 0


def test_a_fetch_of_the_last_row_only_is_nothing_new(spark, overlap):
    assert append.append_static(spark.createDataFrame([("A", 2, 0)], ROWS), overlap[0]).count() == 0


def test_unknown_symbols_start_at_the_floor(spark, overlap):
    page = spark.createDataFrame([("B", 5, 0), ("B", 50, 1)], ROWS)
    assert taken(append.append_static(page, overlap[0], floor=10)) == [50]


def test_archives_advance_one_by_one(spark, overlap):
    rows = [("A", 2, 0, 0), ("A", 5, 1, 0), ("A", 5, 2, 0), ("A", 4, 3, 1), ("A", 6, 4, 1)]
    page = spark.createDataFrame(rows, f"{ROWS}, file_no int")
    assert taken(append.append_archives(page, overlap[0])) == [5, 5, 6]


def test_newest_first_stops_at_known_rows(spark, overlap):
    rows = [("A", 9, 0, 0), ("A", 8, 1, 0), ("A", 2, 2, 1), ("A", 7, 3, 1)]
    assert taken(append.take_until_known(spark.createDataFrame(rows, f"{ROWS}, page int"), overlap[0])) == [9, 8]


def test_zero_volume_is_kept(spark):
    ticks = spark.createDataFrame([("A", 0, 1, 0), ("A", 70_000, 2, 5)], "symbol string, ts_ms long, event_id long, px long")
    assert bars.bars_of_ticks(ticks, 60_000).where("volume = 0").count() == 1


def test_resampling_in_steps_is_resampling_at_once(spark):
    rows = [("A", i * 1000, i, (i * 7919) % 100) for i in range(20_000)]
    ticks = spark.createDataFrame(rows, "symbol string, ts_ms long, event_id long, px long")
    fine = bars.bars_of_ticks(ticks, 60_000)
    steps = bars.resample(bars.resample(fine, 300_000), times.HOUR)
    once = bars.resample(fine, times.HOUR)
    assert sorted(map(tuple, steps.select(once.columns).collect())) == sorted(map(tuple, once.collect()))


def test_unknown_bar_size_is_an_error(spark):
    df = spark.createDataFrame([(7,)], "minutes int").select(times.interval_label(F.col("minutes")))
    with pytest.raises(Exception, match="no bar size"):
        df.collect()


@pytest.mark.parametrize(("symbol", "family", "wanted"), [("BTC-USDT-SWAP", None, "BTC-USDT"), ("BTC-USDT-SWAP", "X", "X"), ("BTC", "", "BTC")])
def test_family(spark, symbol, family, wanted):
    df = spark.createDataFrame([(symbol, family)], "s string, f string")
    assert df.select(lines.instrument_family(F.col("s"), F.col("f"))).first()[0] == wanted


def test_universe_rules(spark):
    columns = "symbol string, name string, contract_type string, quote_asset string, settle_asset string, tags array<string>"
    rows = [("a", "AUSDT", "PERPETUAL", "USDT", "USDT", []), ("b", "BUSDT", "PERPETUAL", "USDT", "USDT", ["mc-trade-zone-Stock"]), ("c", "C", "PERPETUAL", "BTC", "USDT", None), ("d", "DUSDT", "CURRENT_QUARTER", "USDT", "USDT", ["stock"])]
    master = spark.createDataFrame(rows, columns)
    own = lambda e, d: sorted(r["symbol"] for r in master.where(in_universe(e, d)).collect())
    assert own("binance", "futures") == ["a", "b"]
    assert own("okx", "bars") == ["a", "b", "c", "d"]
    assert own("mexc", "futures") == ["a", "d"]  # case matters in tags


def test_unknown_symbols_by_exchange(spark):
    master = spark.createDataFrame([("A", True), ("B", False)], "symbol string, is_trading boolean")
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    act = lambda keep, delete: {r["symbol"]: r["action"] for r in universe.resolve_requested(wanted, master, keep, delete).collect()}
    assert act(True, False) == {"A": "update", "B": "update", "C": "update"}
    assert act(False, False) == {"A": "update", "B": "update", "C": "drop"}
    assert act(True, True) == act(False, True) == {"A": "update", "B": "delete", "C": "delete"}


def test_windows_cover_the_range_once(spark):
    now = 1_700_000_000_000
    plan = spark.createDataFrame([("old", now - 3000 * times.DAY), ("new", now - 5 * times.DAY), ("done", now)], "symbol string, start_ms long")
    rows = fetch.chunk_ranges(plan, now).orderBy("symbol", "from_ms").collect()
    for symbol, start in (("old", now - 3000 * times.DAY), ("new", now - 5 * times.DAY)):
        own = [r for r in rows if r["symbol"] == symbol]
        assert own[0]["from_ms"] == start and own[-1]["to_ms"] == now
        assert all(a["to_ms"] == b["from_ms"] for a, b in zip(own, own[1:], strict=False))
    assert not [r for r in rows if r["symbol"] == "done"]


def test_the_first_day_with_bars_starts_a_plan(spark):
    """Stored rows count first, then the first day with bars, then the master's listing, then the floor."""
    rows = [("A", 5, 7, 9), ("B", None, 7, 9), ("C", None, None, 9), ("D", None, None, 0)]
    resolved = spark.createDataFrame([(s, last, True, listing, 0, listed) for s, last, listed, listing in rows], "symbol string, last_ts long, is_trading boolean, list_time long, delivery_time long, listed long")
    plan = fetch.fetch_plan(resolved, "lighter", 10**13, times.HOUR)
    assert {r["symbol"]: r["start_ms"] for r in plan.collect()} == {"A": 5, "B": 7, "C": 9, "D": 1704067200000}
    master = spark.createDataFrame([(s, True, 0, 0) for s in "AB"], "symbol string, is_trading boolean, list_time long, delivery_time long")
    daily = spark.createDataFrame([("B", 3 * times.DAY), ("B", 2 * times.DAY)], "symbol string, open_time long")
    wanted, none = spark.createDataFrame([("A",), ("B",)], "symbol string"), spark.createDataFrame([], ROWS)
    found = jobs.update_bars(none, none, master, wanted, "lighter", 10**13, times.HOUR, daily=daily)
    assert {r["symbol"]: r["start_ms"] for r in found.plan.collect()} == {"A": 10**13 - times.DAY, "B": 2 * times.DAY}


def test_future_bars_are_flagged(spark):
    rows = spark.createDataFrame([("A", 10 * times.HOUR, True, 0, 0), ("B", None, True, 0, 0)], "symbol string, last_ts long, is_trading boolean, list_time long, delivery_time long")
    plan = {r["symbol"]: r for r in fetch.fetch_plan(rows, "mexc", 9 * times.HOUR, times.HOUR).collect()}
    assert plan["A"]["future_bar"] and plan["A"]["nothing_new"]


def test_missing_batches_are_named(spark):
    staged = spark.createDataFrame([("A", "batch_00003", 0), ("A", "batch_00001", 0), ("A", "other", 0)], "symbol string, batch_name string, pos int")
    none = spark.createDataFrame([], "symbol string")
    assert append.recoverable(append.staged_names(staged), none).first()["missing"] == "2"


def test_csv_scans(spark, tmp_path):
    (tmp_path / "BTC.csv").write_text("open_time,open,high,low,close,volume\n1,1,2,0.5,1.5,0\nx,1,2,0.5,1.5,0\n")
    rows = files.scan_candles(spark, str(tmp_path / "BTC.csv")).collect()
    assert [(r["symbol"], r["is_corrupt"]) for r in rows] == [("BTC", False), ("BTC", True)]
    (tmp_path / "ETH_fr.csv").write_text("funding_time,funding_rate\n5,0.25\n")
    assert tuple(files.scan_funding(spark, str(tmp_path / "ETH_fr.csv")).first()) == ("ETH", 5, 0.25)


def test_columns_go_by_name(spark, tmp_path):
    """Files with other orders and further columns are read by their headers; one without a column fails."""
    (tmp_path / "A.csv").write_text("close,open_time,open,high,low,volume\n1.5,7,1,2,0.5,9\n")
    (tmp_path / "B B.csv").write_text("open_time,open,high,low,close,volume,turnover\r\n8,1,2,0.5,1.25,9,77\r\n")
    (tmp_path / "C.csv").write_text("")
    rows = files.scan_candles(spark, str(tmp_path)).collect()
    assert sorted((r["symbol"], r["open_time"], r["close"], r["volume"], r["is_corrupt"]) for r in rows) == [("A", 7, 1.5, 9.0, False), ("B B", 8, 1.25, 9.0, False)]
    (tmp_path / "D.csv").write_text("open_time,open,high,low,close\n1,1,1,1,1\n")
    with pytest.raises(ValueError, match=r"volume.*D\.csv"):
        files.scan_candles(spark, str(tmp_path))
    (tmp_path / "x_fr.csv").write_text("symbol,funding_rate,funding_time\nX,0.5,3\n")
    assert tuple(files.scan_funding(spark, str(tmp_path / "x_fr.csv")).first()) == ("x", 3, 0.5)


def test_all_candle_layouts(spark, tmp_path):
    for layout, columns in files.LAYOUTS.items():
        if layout != "funding":
            names = [c.split(" ")[0] for c in re.split(r", ", columns)]
            path = tmp_path / layout / "S.csv"
            path.parent.mkdir()
            path.write_text(",".join(names) + "\n" + ",".join(str(i + 1) for i in range(len(names))) + "\n")
            row = files.scan_candles(spark, str(path), layout).first()
            assert row["open_time"] == names.index("timestamp" if layout == "bars_12" else "open_time") + 1 and row["volume"] == names.index("volume") + 1


def test_empty_folder_of_candles(spark, tmp_path):
    (tmp_path / "A.csv").write_text("")
    assert files.scan_candles(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_archives_of_equal_names(spark, tmp_path, scheme):
    paths = []
    for i, folder in enumerate(("a1", "a 2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "2024-01.csv").write_text(f"open_time,open,high,low,close,volume\n{i},1,1,1,1,1\n")
        paths.append(f"{scheme}{tmp_path}/{folder}/2024-01.csv")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"open_time,open,high,low,close,volume\n2,1,1,1,1,1\n"))
    paths.append(f"{scheme}{tmp_path}/z.csv.gz")
    assert sorted((r["open_time"], r["file_no"]) for r in files.scan_archives(spark, paths).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_instruments_scan(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"symbol": "A", "is_trading": true, "tags": ["x", "y"]}\n{"symbol": "B"}\n')
    rows = {r["symbol"]: r for r in files.scan_instruments(spark, str(tmp_path)).collect()}
    assert rows["A"]["tags"] == ["x", "y"] and rows["B"]["is_trading"] is None


def test_symbol_list(spark):
    assert universe.symbol_list(spark.createDataFrame([("B",), ("A",), ("B",)], "symbol string")).first()["symbols"] == "A, B"


def test_written_csv_comes_back(spark, tmp_path):
    rows = [("A/B", 2, 1.0, 1.0, 1.0, 1.0, 5.0), ("A/B", 1, 1.0, 1.0, 1.0, 1.0, 6.0), ("C+ d%", 1, 1.0, 1.0, 1.0, 1.0, 7.0)]
    sinks.write_csv(spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double"), str(tmp_path / "csv"))
    assert sorted(tuple(r)[:7] for r in files.scan_candles(spark, str(tmp_path / "csv")).collect()) == sorted(rows)


def test_exported_records(spark, tmp_path):
    rows = spark.createDataFrame([("A", 60_000, 1.0, 2.0, 0.5, 1.5, 3.0), ("A", 0, 1.0, 2.0, 0.5, 1.25, 3.0)], "symbol string, open_time long, open double, high double, low double, close double, volume double")
    assert [(r["close_time"], r["close"], r["rec_no"]) for r in jobs.export_t6(rows, 60_000).collect()] == [(120_000, 1.5, 1), (60_000, 1.25, 2)]
    assert [(r["close_time"], r["rec_no"]) for r in jobs.export_t6(rows, 60_000, str(tmp_path / "t6")).orderBy("rec_no").collect()] == [(120_000, 1), (60_000, 2)]
    assert len(list((tmp_path / "t6" / "symbol=A").glob("*.parquet"))) == 1


def test_verify_job(spark):
    raw = spark.createDataFrame([("f", 1, "open_time,open"), ("f", 2, "60000,1"), ("f", 3, "0,1"), ("f", 4, "x")], "file string, line_no long, value string")
    report, summary, verdict = jobs.verify_files(raw, LineRule(2, interval_ms=60_000))
    assert (report.first()["total_records"], report.first()["malformed"], report.first()["out_of_order"]) == (2, 1, 1)
    assert tuple(summary.first()) == (0, 1) and verdict.first()["any_unresolved"]


def test_listing_after_a_failed_probe(spark):
    daily = spark.createDataFrame([("A", 5)], "symbol string, open_time long")
    asked = spark.createDataFrame([("A", False), ("B", None), ("C", True)], "symbol string, probe_failed boolean")
    now = 100 * times.DAY
    assert {tuple(r) for r in bars.listing_dates(daily, asked, now).collect()} == {("A", 5), ("B", now - times.DAY), ("C", now - 30 * times.DAY)}


@pytest.mark.parametrize(("exchange", "want"), [("binance", [10, 20]), ("bybit_spot", [10, 15, 20]), ("okx", [10, 20])])
def test_update_filters_by_exchange(spark, monkeypatch, exchange, want):
    """Ascending rows, all later rows, or archive by archive."""
    monkeypatch.setitem(jobs.FLOORS, exchange.split("_")[0], 0)
    master = spark.createDataFrame([("A", True, 0, 0)], "symbol string, is_trading boolean, list_time long, delivery_time long")
    incoming = spark.createDataFrame([("A", 10, 0, 0), ("A", 20, 1, 0), ("A", 15, 2, 1), ("A", 5, 3, 1)], f"{ROWS}, file_no int")
    found = jobs.update_bars(incoming, spark.createDataFrame([("A", 5)], "symbol string, ts long"), master, spark.createDataFrame([("A",)], "symbol string"), exchange, 10**12, times.HOUR)
    assert sorted(r["ts"] for r in found.new.collect()) == want


@pytest.mark.parametrize(("header", "n"), [("Name,Symbol", 2), ("symbol,available_since", 2), ("NAME,PRICE", 0)])
def test_symbols_files(spark, tmp_path, header, n):
    (tmp_path / "s.csv").write_text(f"{header}\na,b\nc,d\n")
    assert files.scan_symbols_file(spark, str(tmp_path / "s.csv")).count() == n


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 3.0)], "symbol string, open_time long, close double")
    sinks.append_store(rows, str(tmp_path / "store"))
    sinks.append_store(rows.where("symbol = 'A'").withColumn("open_time", F.lit(2).cast("long")), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    sinks.replace_partitions(rows.where("symbol = 'A'"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_update_job(spark):
    master = spark.createDataFrame([("A", True, 0, 0), ("B", False, 0, 0)], "symbol string, is_trading boolean, list_time long, delivery_time long")
    store = spark.createDataFrame([("A", 1), ("B", 1), ("Z", 1)], "symbol string, ts long")
    incoming = spark.createDataFrame([("A", 1, 0), ("A", 1_500_000_000_000, 1), ("B", 1_500_000_000_000, 2)], ROWS)
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    found = jobs.update_bars(incoming, store, master, wanted, "binance", 1_600_000_000_000, times.HOUR, delete_delisted=True)
    assert [r["symbol"] for r in found.new.collect()] == ["A"]
    assert [r["symbol"] for r in found.kept.collect()] == ["A"]


def test_funding_job(spark):
    store = spark.createDataFrame([("A", 1)], "symbol string, ts long")
    bulk = spark.createDataFrame([("A", 1, 0, 0), ("A", 2, 1, 0)], f"{ROWS}, file_no int")
    recent = spark.createDataFrame([("A", 2, 5), ("A", 3, 6)], ROWS)
    assert sorted(r["ts"] for r in jobs.update_funding(bulk, recent, store).collect()) == [2, 3]


LANDED = f"{ROWS}, size long, price double, note string"


def landing(spark, land):
    return lambda *rows: spark.createDataFrame([(*r, *([None, 0.1, None] if len(r) == 3 else [])) for r in rows], LANDED).coalesce(1).write.mode("append").parquet(land)


def states(spark, checkpoint) -> dict[str, int]:
    """The last time of each symbol as Spark's state store has it."""
    return {r["symbol"]: r["last_ts"] for r in spark.read.format("statestore").load(checkpoint).select("key.symbol", "value.groupState.last_ts").collect()}


def test_stream_appends_once(spark, tmp_path):
    land, store, check = (str(tmp_path / n) for n in ("land", "store", "check"))
    batch = landing(spark, land)
    batch(("A", 1, 0), ("A", 2, 1), ("A", 2, 2), (None, 1, 0), ("A", None, 3))
    run = lambda: stream_append(spark.readStream.schema(LANDED).parquet(land), store, check).awaitTermination()
    run()
    batch(("A", 3, 1), ("A", 2, 0), ("B", 1, 2, 2**53 + 1, None, "x, \"y\""))
    run()
    assert states(spark, check) == {"A": 3, "B": 1}
    batch(("A", 3, 0), ("B", 2, 1), ("A", 9, 2), ("A", 8, 3))
    run()
    run()
    assert states(spark, check) == {"A": 9, "B": 2}
    rows = sorted(map(tuple, spark.read.parquet(store).collect()))
    one = lambda s, t, p: (s, t, p, None, 0.1, None)
    assert rows == [one("A", 1, 0), one("A", 2, 1), one("A", 3, 1), one("A", 9, 2), ("B", 1, 2, 2**53 + 1, None, 'x, "y"'), one("B", 2, 1)]


def test_stream_restarts_after_a_failed_batch(spark, tmp_path):
    """A batch that fails half way is run again as a whole; symbols begin where their history ends."""
    land, store, check = (str(tmp_path / n) for n in ("land", "store", "check"))
    history = spark.createDataFrame([("A", 5), ("C", 1)], "symbol string, ts long")
    batch = landing(spark, land)
    batch(("A", 5, 0), ("A", 6, 1), ("B", 1, 2))
    source = lambda: spark.readStream.schema(LANDED).parquet(land)
    stream_append(source(), store, check, history=history).awaitTermination()
    batch(("A", 7, 0), ("B", 3, 1), ("C", 1, 2), ("C", 2, 3))
    broken = source().withColumn("ts", F.when(F.col("symbol") == "B", F.raise_error(F.lit("down")).cast("long")).otherwise(F.col("ts")))
    with pytest.raises(Exception, match="down"):
        stream_append(broken, store, check, history=history).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    stream_append(source(), store, check, history=history.withColumn("ts", F.lit(99).cast("long"))).awaitTermination()
    assert sorted((r["symbol"], r["ts"]) for r in spark.read.parquet(store).collect()) == [("A", 6), ("A", 7), ("B", 1), ("B", 3), ("C", 2)]


def test_stream_drops_repeats(spark, tmp_path):
    land = str(tmp_path / "land")
    spark.createDataFrame([("A", 1, 0), ("A", 1, 1), ("A", 2, 2)], ROWS).write.parquet(land)
    rows = stream_distinct(spark.readStream.schema(ROWS).parquet(land))
    query = rows.writeStream.format("memory").queryName("distinct_rows").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT count(*) FROM distinct_rows").first()[0] == 2
