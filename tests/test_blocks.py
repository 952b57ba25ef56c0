"""One key with all rows gives the same in blocks of any width."""

import random

import pytest
from pyspark.sql import functions as F

from barkeep.functions.times import MINUTE
from barkeep.operators import append, bars, blocks, verify
from barkeep.plans.rules import LineRule
from barkeep.sources import files, sinks

WIDTHS = [1, 7, 500_000]
RULE = LineRule(2, salvage=True, interval_ms=MINUTE)


@pytest.fixture(params=WIDTHS)
def width(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", request.param)
    monkeypatch.setattr(verify, "BLOCK_LINES", request.param)
    return request.param


def lines_of(rnd: random.Random, n: int) -> list[str]:
    """Bars of a minute with gaps, short deltas, repeats, torn and wide lines, not quite in order."""
    out, at = [], 0
    for i in range(n):
        at += rnd.choice([1, 1, 1, 1, 2, 9, 0]) * MINUTE + (rnd.choice([0] * 9 + [500]))
        out.append(rnd.choice([f"{at},{i}"] * 9 + [f"{at},{i},7", f"{at},{i},", f"{at}", "junk"]))
    for _ in range(n // 9):
        i = rnd.randrange(n - 1)
        out[i], out[i + 1] = out[i + 1], out[i]
    return out


def parse(lines: list[str]) -> list[tuple[int, str, bool]]:
    found = []
    for line in lines:
        fields = line.split(",")
        fields = fields[:-1] if fields[-1] == "" else fields
        if len(fields) >= 2 and fields[0].isdigit():
            found.append((int(fields[0]), ",".join(fields[:2]), line != ",".join(fields[:2])))
    return found


def test_report_gaps_and_repair(spark, width):
    rnd = random.Random(width)
    texts = {"all": lines_of(rnd, 300), "few": lines_of(rnd, 5), "none": []}
    raw = spark.createDataFrame([(f, i + 1, v) for f, body in texts.items() for i, v in enumerate(["open_time,close,x", *body])], "file string, line_no long, value string")
    report = {r["file"]: r.asDict() for r in verify.file_report(raw, RULE).collect()}
    unique = verify.with_duplicates(verify.parsed(raw, RULE)).where("is_first")
    stats = {r["file"]: r.asDict() for r in verify.gap_stats(unique, MINUTE).collect()}
    found = {(r["file"], r["prev_ts"], r["ts"], r["missing"]) for r in verify.gaps(unique, MINUTE).collect()}
    fixed = {}
    for r in verify.repaired(raw, RULE).orderBy("file", "line_no").collect():
        fixed.setdefault(r["file"], []).append((r["line_no"], r["line"]))
    wanted = set()
    for file, body in texts.items():
        good = parse(body)
        times = sorted({t for t, *_ in good})
        pairs = [(a, b) for a, b in zip(times, times[1:]) if b - a != MINUTE]
        wanted |= {(file, a, b, max(0, (b - a) // MINUTE - 1)) for a, b in pairs}
        own = report[file]
        assert own["total_records"] == len(good) and own["malformed"] == len(body) - len(good) and own["duplicates"] == len(good) - len(times)
        assert own["salvaged"] == sum(x[2] for x in good) and own["out_of_order"] == sum(b[0] < a[0] for a, b in zip(good, good[1:]))
        for counts in [own] + ([stats[file]] if times else []):
            assert counts["gaps"] == len(pairs) and counts["missing_bars"] == sum(max(0, (b - a) // MINUTE - 1) for a, b in pairs)
            assert counts["first_gap_ts"] == (pairs[0][0] if pairs else None)
        if own["needs_repair"]:
            first = {}
            for t, line, _ in good:
                first.setdefault(t, line)
            assert fixed[file] == list(enumerate(["open_time,close", *(first[t] for t in times)], 1))
        else:
            assert file not in fixed
    assert found == wanted


def test_without_an_interval_nothing_is_a_gap(spark, width):
    rows = spark.createDataFrame([("A", t) for t in (0, 5, 100 * MINUTE)], "file string, ts long")
    assert verify.gaps(rows, 0).collect() == []
    assert tuple(verify.gap_stats(rows, 0).first()) == ("A", 3, 0, 0, None)
    assert sorted(r["delta"] for r in verify.deltas(rows).collect()) == [5, 100 * MINUTE - 5]


def test_appends(spark, width):
    rnd = random.Random(width + 1)
    stored = spark.createDataFrame([("A", 20), ("B", 5)], "symbol string, ts long")
    rows = [(s, rnd.randrange(15, 90), p) for s, n in (("A", 200), ("B", 10), ("C", 3)) for p in range(n)]
    shuffled = rnd.sample(rows, len(rows))
    page = spark.createDataFrame(shuffled, "symbol string, ts long, pos long").repartition(4)
    wanted = []
    tops = {"A": 20, "B": 5}
    for s, t, p in rows:
        if t > tops.get(s, 0):
            tops[s] = t
            wanted.append((s, t, p))
    assert sorted(map(tuple, append.append_monotonic(page, stored).select("symbol", "ts", "pos").collect())) == sorted(wanted)
    pages = page.withColumn("page", F.expr("pos div 10").cast("int")).withColumn("pos", F.col("pos") % 10).withColumn("ts", F.when(F.rand(3) < 0, 0).otherwise(F.col("ts") + 10))
    known = {}
    for s, t, p in rows:
        known.setdefault(s, []).append((t + 10, p))
    last = {"A": 30, "B": 5}
    wanted = [(s, t) for s, own in known.items() for k, (t, p) in enumerate(own) if all(x > last.get(s, 0) for x, _ in own[: k + 1])]
    stored = spark.createDataFrame(list(last.items()), "symbol string, ts long")
    assert sorted((r["symbol"], r["ts"]) for r in append.take_until_known(pages, stored).collect()) == sorted(wanted)


def test_merged_batches(spark, width):
    rows = [("A", b, p) for b in (3, 1, 2) for p in range(9)] + [("B", 1, 0)]
    merged = append.merge_staged(spark.createDataFrame(rows, "symbol string, batch_no int, pos int").repartition(3))
    order = sorted((r for r in rows if r[0] == "A"), key=lambda r: (-r[1], r[2]))
    assert [(r["symbol"], r["batch_no"], r["pos"]) for r in merged.where("symbol = 'A'").orderBy("seq").collect()] == order
    assert sorted(r["seq"] for r in merged.where("symbol = 'A'").collect()) == list(range(1, 28))


@pytest.mark.parametrize("newest_first", [False, True])
def test_positions(spark, width, newest_first):
    times = random.Random(5).sample(range(0, 3000 * MINUTE, MINUTE), 400)
    rows = spark.createDataFrame([("A", t) for t in times] + [("B", 7)], "symbol string, open_time long")
    found = {(r["symbol"], r["open_time"]): r["rec_no"] for r in bars.positions(rows.repartition(5), "open_time", newest_first).collect()}
    assert found == {("A", t): i + 1 for i, t in enumerate(sorted(times, reverse=newest_first))} | {("B", 7): 1}


@pytest.fixture
def many_tasks(spark):
    """Small partitions stay apart, as large ones would."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_one_symbol_is_exported_by_several_tasks(spark, many_tasks):
    rows = spark.range(20_000).select(F.lit("A").alias("symbol"), (F.col("id") * MINUTE).alias("open_time"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    out = bars.t6_records(rows, MINUTE)
    parts = [[r["close_time"] for r in part] for part in out.rdd.glom().collect() if part]
    assert len(parts) > 1 and [t for part in parts for t in part] == [i * MINUTE for i in range(20_000, 0, -1)]
    assert bars.sorted_bars(rows).rdd.getNumPartitions() > 1


def test_one_file_is_written_by_several_tasks(spark, tmp_path, many_tasks):
    rows = [("a", i, f"line {i}") for i in range(1, 5001)] + [("b/c", 1, "x")]
    sinks.write_lines(spark.createDataFrame(rows, "file string, line_no long, line string").repartition(3), str(tmp_path / "lines"))
    assert len(list((tmp_path / "lines" / "file=a").glob("part-*"))) > 1
    back = files.scan_raw_lines(spark, str(tmp_path / "lines"), folders=True)
    assert sorted((r["file"], r["line_no"], r["value"]) for r in back.collect()) == sorted(rows)
    assert back.where("not terminated").count() == 0
    bars_of = spark.range(3000).select(F.lit("A").alias("symbol"), (F.col("id") * MINUTE).alias("open_time"), F.lit(1.5).alias("close"))
    sinks.write_csv(bars_of, str(tmp_path / "csv"), newest_first=True)
    parts = sorted((tmp_path / "csv" / "symbol=A").glob("part-*"))
    times = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and times == [i * MINUTE for i in range(2999, -1, -1)]
