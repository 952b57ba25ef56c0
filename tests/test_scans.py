"""Scans by header: files that fail are told, headers are kept, known files aren't read again."""

import os

import pytest
from pyspark.sql import functions as F

from barkeep.functions import lines
from barkeep.sources import files
from barkeep.sources.headers import HeaderRegistry

HEAD = "open_time,open,high,low,close,volume"


@pytest.fixture
def land(tmp_path):
    (tmp_path / "bars").mkdir()
    (tmp_path / "bars" / "A.csv").write_text(f"{HEAD}\n1,1,2,0.5,1.5,9\n")
    (tmp_path / "bars" / "B.csv").write_text(f"﻿close,x,{HEAD.replace(',close', '')}\r\n2.5,y,1,1,2,0.5,9\r\n\r\nbad,y,2,1,2,0.5,9\r\n2.5,y,2,1\r\n")
    (tmp_path / "bars" / "C.csv").write_text("open_time,open,high,low,close\n1,1,2,0.5,1.5\n")
    (tmp_path / "bars" / "D.csv").write_text('"open_time","open","high","low","close","volume","note"\n"3","1","2","0.5","1.5","9","a, ""b"""\n4,1,2,0.5,1.5,,\n')
    (tmp_path / "bars" / "E.csv.gz").write_bytes(b"not a gzip file")
    (tmp_path / "bars" / "F.csv").write_text("")
    return tmp_path / "bars"


def test_bad_files_are_told_and_stop_nothing(spark, land):
    scan = files.scan_bars(spark, str(land))
    found = sorted(((r["symbol"], r["open_time"], r["close"], r["volume"], r["is_corrupt"]) for r in scan.rows.collect()), key=str)
    assert found == [("A", 1, 1.5, 9.0, False), ("B", 1, 2.5, 9.0, False), ("B", 2, 2.5, None, True), ("B", 2, None, 9.0, True), ("D", 3, 1.5, 9.0, False), ("D", 4, 1.5, None, False)]
    assert {r["file"].rsplit("/", 1)[1]: r["reason"] for r in scan.failed.collect()} == {"C.csv": "no column volume", "E.csv.gz": "it can't be read"}
    assert {r["file"].rsplit("/", 1)[1]: r["n_corrupt"] for r in scan.corrupt().collect()} == {"B.csv": 2}
    with pytest.raises(ValueError, match=r"volume in .*C\.csv and 1 other"):
        files.scan_candles(spark, str(land))


def test_known_files_are_not_read_again(spark, land, tmp_path, monkeypatch):
    registry = HeaderRegistry(spark, str(tmp_path / "headers"))
    probed = []
    probe = HeaderRegistry._probe

    def watched(self, folder, since):
        rows = probe(self, folder, since)
        probed.append(sorted(r["file"].rsplit("/", 1)[1] for r in rows.collect()))
        return rows

    monkeypatch.setattr(HeaderRegistry, "_probe", watched)
    for i, name in enumerate(sorted(os.listdir(land))):
        os.utime(land / name, (1_600_000_000 + i, 1_600_000_000 + i))
    first = sorted(map(tuple, files.scan_bars(spark, str(land), registry=registry).rows.collect()), key=str)
    assert probed == [["A.csv", "B.csv", "C.csv", "D.csv"]] and registry.unknown(str(land)).isEmpty()
    assert sorted(map(tuple, files.scan_bars(spark, str(land), registry=registry).rows.collect()), key=str) == first and len(probed) == 1
    (land / "C.csv").write_text(f"{HEAD}\n7,1,2,0.5,1.5,9\n")  # mended, and of another time
    os.utime(land / "C.csv", (1_700_000_000, 1_700_000_000))
    scan = files.scan_bars(spark, str(land), registry=registry)
    assert [r["open_time"] for r in scan.rows.where("symbol = 'C'").collect()] == [7] and probed[1:] == [["C.csv"]]
    assert registry.rows().where("header is null").count() == 1


@pytest.mark.parametrize(("line", "wanted"), [("a,b", ["a", "b"]), ("a,", ["a", ""]), (",b", ["", "b"]), ("", [""]), ('"a,1",b,""', ["a,1", "b", ""]), ('"a ""x""",', ['a "x"', ""]), ('"",""', ["", ""])])
def test_csv_fields(spark, line, wanted):
    assert spark.createDataFrame([(line,)], "v string").select(lines.csv_fields(F.col("v"))).first()[0] == wanted


def test_only_wanted_archives_are_read(spark, tmp_path, monkeypatch):
    """An archive that the plan doesn't want can't be read, and isn't."""
    from barkeep.functions.times import DAY, MINUTE
    from barkeep.plans import fetch, jobs

    now = 1_700_000_000_000
    day = lambda n: now - n * DAY - (now - n * DAY) % DAY
    listed = [("daily", "A", day(9), True), ("daily", "A", day(3), False), ("daily", "A", day(2), False), ("monthly", "A", day(80), True), ("daily", "B", day(2), True), ("daily", "C", day(5), True), ("monthly", "C", day(70), False)]
    for kind, symbol, date, broken in listed:
        folder = tmp_path / "arch" / f"kind={kind}" / f"symbol={symbol}" / f"date_ts={date}"
        folder.mkdir(parents=True)
        if broken:
            (folder / "x.csv.gz").write_bytes(b"not a gzip file")
        else:
            (folder / "x.csv").write_text(f"{HEAD}\n" + "".join(f"{date + i * MINUTE},1,1,1,1,1\n" for i in (2, 1, 1)))
    manifest = spark.createDataFrame([r[:3] for r in listed], "kind string, symbol string, date_ts long")
    store = spark.createDataFrame([("A", day(3) + MINUTE), ("B", now)], "symbol string, ts long")
    master = spark.createDataFrame([(s, True, day(100), 0) for s in "AC"], "symbol string, is_trading boolean, list_time long, delivery_time long")
    recent = spark.createDataFrame([("A", day(2) + 2 * MINUTE, 1.0), ("A", now, 1.0), ("B", now + 1, 1.0)], "symbol string, ts long, open double").selectExpr("symbol", "ts", "open", "open AS high", "open AS low", "open AS close", "open AS volume")
    asked = spark.createDataFrame([("A",), ("C",)], "symbol string")
    found = jobs.update_from_archives(spark, str(tmp_path / "arch"), manifest, recent, store, master, asked, "okx", now, MINUTE, layout="bars_6")
    rows = sorted((r["symbol"], r["ts"]) for r in found.new.collect())
    one = lambda n: [day(n) + i * MINUTE for i in (1, 1, 2)]
    assert rows == [("A", day(3) + 2 * MINUTE), *[("A", t) for t in one(2)], ("A", now), *[("C", t) for t in one(70)]]
    assert {r["symbol"]: r["n_appended"] for r in found.counts.collect()} == {"A": 5, "C": 3}
    with pytest.raises(Exception, match="gzip|GZIP"):
        files.read_archives(spark, str(tmp_path / "arch"), manifest).collect()
    assert fetch.SPANS.keys() == set(jobs.KINDS)
