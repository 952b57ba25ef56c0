"""Golden cases of raw text, and properties of repair."""

import pytest
from pyspark.sql import functions as F

from barkeep.operators import verify
from barkeep.plans import jobs
from barkeep.plans.rules import LineRule
from barkeep.sources import files, sinks

SIX = LineRule(6, interval_ms=60_000)
HEAD = "open_time,open,high,low,close,volume"


def bar(i: int, close: float = 1.0) -> str:
    return f"{1_600_000_000_000 + i * 60_000},1,2,0.5,{close},0"


def landed(spark, tmp_path, text: str):
    (tmp_path / "X.csv").write_bytes(text.encode())
    return files.scan_raw_lines(spark, str(tmp_path))


def report(spark, tmp_path, lines: list[str], rule: LineRule = SIX) -> dict:
    raw = landed(spark, tmp_path, "\n".join([HEAD, *lines]) + "\n")
    return verify.file_report(raw, rule).first().asDict()


def counters(found: dict, **wanted: int) -> None:
    names = ("malformed", "salvaged", "duplicates", "out_of_order", "gaps", "missing_bars")
    assert {n: found[n] for n in names} == {n: wanted.get(n, 0) for n in names}


def test_clean(spark, tmp_path):
    found = report(spark, tmp_path, [bar(i) for i in range(5)])
    counters(found)
    assert found["total_records"] == 5 and not found["needs_repair"]


def test_glued_line(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(0), "16000" + bar(1) + "," + bar(1), bar(1)]), malformed=1)


def test_reappended(spark, tmp_path):
    rows = [bar(i) for i in (0, 1, 2, 0, 1, 2)]
    found = report(spark, tmp_path, rows)
    counters(found, duplicates=3, out_of_order=1)
    assert found["total_records"] == 6


def test_first_copy_wins(spark, tmp_path):
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(0, 1), bar(0, 9), bar(1)]) + "\n")
    assert [r["line"] for r in verify.repaired(raw, SIX).orderBy("line_no").collect()] == [HEAD, bar(0, 1), bar(1)]


def test_equal_neighbours(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(0), bar(0)]), duplicates=1)


def test_malformed_between_does_not_reset_the_order(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(3), "junk", bar(2)]), malformed=1, out_of_order=1)


def test_trailing_comma_is_salvaged(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(0) + ",", bar(1)]), salvaged=1)


@pytest.mark.parametrize(("salvage", "wanted"), [(True, {"salvaged": 1}), (False, {"malformed": 1})])
def test_seven_columns(spark, tmp_path, salvage, wanted):
    counters(report(spark, tmp_path, [bar(0), bar(1) + ",77"], LineRule(6, salvage=salvage, interval_ms=60_000)), **wanted)


def test_carriage_returns_and_blank_lines(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(0) + "\r", "", "\r", bar(1) + "\r"]))


@pytest.mark.parametrize("field", ["-5", "", "1" * 20, "9" * 19, "12.5", "abc", " 12", "+12"])
def test_bad_timestamps(spark, tmp_path, field):
    counters(report(spark, tmp_path, [bar(0), field + ",1,1,1,1,1"]), malformed=1)


def test_gap(spark, tmp_path):
    found = report(spark, tmp_path, [bar(0), bar(1), bar(4)])
    counters(found, gaps=1, missing_bars=2)
    assert found["first_gap_ts"] == 1_600_000_060_000


def test_short_delta(spark, tmp_path):
    rows = [f"{1_600_000_000_000 + t},1,1,1,1,1" for t in (0, 30_000, 60_000)]
    counters(report(spark, tmp_path, rows), gaps=2)


def test_gap_check_off(spark, tmp_path):
    counters(report(spark, tmp_path, [bar(0), bar(9)], LineRule(6, interval_ms=0)))


def test_wide_rows_are_kept_verbatim(spark, tmp_path):
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(0) + ",7,8,", bar(1) + ",7", bar(1) + ",7"]) + "\n")
    rule = LineRule(7, allow_more=True, interval_ms=60_000)
    lines = [r["line"] for r in verify.repaired(raw, rule).orderBy("line_no").collect()]
    assert lines == [HEAD, bar(0) + ",7,8,", bar(1) + ",7"]


def test_torn_tail(spark, tmp_path):
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(0), bar(1), bar(2)[:9]]))
    found = verify.torn_tails(raw, SIX, 7).first()
    assert (found["last_line"], found["resume_ts"], found["lines_cut"]) == (3, 1_600_000_060_000, 1)
    assert verify.trimmed(raw, SIX, 7).count() == 3


def test_complete_but_unterminated_line(spark, tmp_path):
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(0), bar(1)]))
    assert verify.resume_points(raw, SIX, 7).first()["resume_ts"] == 1_600_000_000_000
    assert verify.file_report(raw, SIX).first()["total_records"] == 2


def test_no_valid_record_keeps_the_header(spark, tmp_path):
    raw = landed(spark, tmp_path, HEAD + "\njunk\nmore junk\n")
    found = verify.torn_tails(raw, SIX, 7).first()
    assert (found["last_line"], found["resume_ts"], found["lines_cut"]) == (1, 7, 2)


def test_header_only_and_empty_files(spark, tmp_path):
    raw = landed(spark, tmp_path, HEAD + "\n")
    listed = spark.createDataFrame([(raw.first()["file"], False), ("empty.csv", False), ("locked.csv", True)], "file string, read_failed boolean")
    rows = {r["file"]: r for r in verify.file_report(raw, SIX, listed).collect()}
    assert all(r["total_records"] == 0 and not r["needs_repair"] for r in rows.values())
    assert verify.verdict(verify.file_report(raw, SIX, listed)).first()["any_unresolved"]
    assert verify.summary(verify.file_report(raw, SIX, listed)).first()["files_with_issues"] == 1


def test_repair_is_idempotent(spark, tmp_path):
    rows = [bar(3), bar(1) + ",", "junk", bar(2), bar(2), bar(9) + ",5"]
    rule = LineRule(6, salvage=True, interval_ms=60_000)
    raw = landed(spark, tmp_path, "\n".join([HEAD + ",turnover", *rows]) + "\n")
    fixed, told = jobs.repair_files(raw, rule)
    once = fixed.withColumnRenamed("line", "value")
    assert told.first()["repaired"] and told.first()["total_records"] == once.count() - 1 == 4
    assert not verify.file_report(once, rule).first()["needs_repair"]
    again, told = jobs.repair_files(once, rule)
    assert again.count() == 0 and not told.first()["repaired"]
    assert once.where("line_no = 1").first()["value"] == HEAD


def test_line_order_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("\n".join([HEAD, *[bar(i) for i in range(20_000)]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = files.scan_raw_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 1
        rows = found.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["value"] for r in rows] == [HEAD, *[bar(i) for i in range(20_000)]]


def test_written_lines_come_back(spark, tmp_path):
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(1), bar(0), bar(0)]) + "\n")
    fixed = verify.repaired(raw, SIX).withColumn("file", F.lit("X"))
    sinks.write_lines(fixed, str(tmp_path / "out"))
    written = [p.read_text() for p in (tmp_path / "out").rglob("part-*")]
    assert "".join(written) == "\n".join([HEAD, bar(0), bar(1)]) + "\n"


def test_only_dirty_files_are_swapped(spark, tmp_path):
    store = tmp_path / "store"
    lines = [("clean", HEAD), ("clean", bar(0)), ("clean", bar(1)), ("a dirty+one", HEAD), ("a dirty+one", bar(1)), ("a dirty+one", bar(0)), ("a dirty+one", bar(0))]
    sinks.write_lines(spark.createDataFrame([(f, i, v) for i, (f, v) in enumerate(lines)], "file string, line_no long, line string"), str(store))
    before = {p: p.stat().st_mtime_ns for p in store.rglob("part-*") if "clean" in str(p)}
    told = {r["file"]: r for r in jobs.repair_store(spark, str(store), SIX).collect()}
    assert told["a dirty+one"]["repaired"] and told["a dirty+one"]["total_records"] == 2 and not told["clean"]["repaired"]
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    report, _, verdict = jobs.verify_store(spark, str(store), SIX)
    assert report.count() == 2 and not verdict.first()["any_unresolved"]
    assert jobs.repair_store(spark, str(store), SIX).where("repaired").count() == 0


def test_unreadable_files_are_told(spark, tmp_path):
    """A file that is damaged is read_failed, a good one is not, and an empty one has no report."""
    (tmp_path / "good.csv").write_text("\n".join([HEAD, bar(0)]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.csv.gz").write_bytes(b"\x1f\x8b not gzip at all")
    report, summary, verdict = jobs.verify_store(spark, str(tmp_path), SIX)
    found = {r["file"].rsplit("/", 1)[1]: r for r in report.collect()}
    assert {f for f, r in found.items() if r["read_failed"]} == {"bad.csv.gz"} and len(found) == 2
    assert verdict.first()["any_unresolved"] and tuple(summary.first()) == (1, 1)


@pytest.mark.parametrize("block", [1, 2, 3, 500_000])
def test_order_across_blocks(spark, tmp_path, monkeypatch, block):
    """A line that goes back in time is found wherever its file is cut."""
    monkeypatch.setattr(verify, "BLOCK_LINES", block)
    raw = landed(spark, tmp_path, "\n".join([HEAD, bar(5), "junk", bar(3), bar(4), "junk", "junk", "junk", bar(2), bar(9)]) + "\n")
    rows = verify.out_of_order(verify.parsed(raw, SIX)).where("out_of_order").collect()
    assert sorted(r["line_no"] for r in rows) == [4, 9]
