"""Integrity of raw lines: report, repair, torn tails.

Input is (file, line_no, value) with the header at line 1. Order within a file matters; a file is cut into
blocks of lines or of time, and what crosses from one block to the next goes by a table of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barkeep.functions import lines
from barkeep.functions.times import minute_text
from barkeep.operators import blocks
from barkeep.plans.rules import LineRule

#: Lines of a file that one task orders.
BLOCK_LINES = 500_000


def clean_lines(raw: DataFrame) -> DataFrame:
    """(file, line_no, value) without carriage returns at the end and without empty lines; the header stays."""
    out = raw.select("file", "line_no", lines.cleaned(F.col("value")).alias("value"))
    return out.where("value <> '' or line_no = 1")


def split_fields(raw: DataFrame) -> DataFrame:
    return clean_lines(raw).withColumn("fields", lines.fields(F.col("value")))


def parsed(raw: DataFrame, rule: LineRule, skip_header: bool = True) -> DataFrame:
    """(file, line_no, value, fields, ts, accepted, salvaged, line) of the data lines; line is the canonical form of an accepted one."""
    rows = split_fields(raw)
    if skip_header:
        rows = rows.where("line_no > 1")
    n, size, ts = rule.n_fields, F.size("fields"), lines.timestamp(F.element_at("fields", 1))
    if rule.allow_more:
        fits, cut = size >= n, F.lit(False)
    else:
        fits = (size >= n) if rule.salvage else (size == n)
        cut = (size != n) | F.col("value").endswith(",")
    rows = rows.withColumns({"ts": ts, "accepted": F.coalesce(fits & ts.isNotNull(), F.lit(False))})
    rows = rows.withColumn("salvaged", F.col("accepted") & cut)
    return rows.withColumn("line", F.when(F.col("accepted"), F.when(F.col("salvaged"), lines.first_fields(F.col("fields"), n)).otherwise(F.col("value"))))


def out_of_order(rows: DataFrame) -> DataFrame:
    """Accepted lines with out_of_order: their time is before that of the accepted line above.

    Files are cut into blocks of BLOCK_LINES lines; the last line of a block is handed to the next
    one that has any, so no file is one task's burden.
    """
    rows = rows.where("accepted").withColumn("block", F.expr(f"line_no div {BLOCK_LINES}"))
    lasts = rows.groupBy("file", "block").agg(F.max_by("ts", "line_no").alias("last"))
    lasts = lasts.select("file", "block", F.lag("last").over(Window.partitionBy("file").orderBy("block")).alias("seam"))
    above = F.lag("ts").over(Window.partitionBy("file", "block").orderBy("line_no"))
    rows = rows.withColumn("above", above).join(lasts, ["file", "block"])
    return rows.withColumn("out_of_order", F.coalesce(F.col("ts") < F.coalesce("above", "seam"), F.lit(False))).drop("block", "above", "seam")


def _order_counts(rows: DataFrame) -> DataFrame:
    """(file, out_of_order): how many accepted lines ``out_of_order`` marks, in one pass."""
    rows = rows.where("accepted").select("file", "line_no", "ts", F.expr(f"line_no - pmod(line_no, {BLOCK_LINES})").alias("block"))
    above = F.lag("ts").over(Window.partitionBy("file", "block").orderBy("line_no"))
    ends = rows.withColumn("above", above).groupBy("file", "block")
    ends = ends.agg(F.count_if(F.col("ts") < F.col("above")).alias("n"), F.min_by("ts", "line_no").alias("first"), F.max_by("ts", "line_no").alias("last"))
    return blocks.seams(ends, "file").groupBy("file").agg((F.sum("n") + F.count_if(F.col("delta") < 0)).alias("out_of_order"))


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Accepted lines with is_first: the earliest line of each time of a file. First lines are aggregated before they are joined, so a time with very many lines is no task's burden."""
    rows = rows.where("accepted")
    firsts = rows.groupBy("file", "ts").agg(F.min("line_no").alias("first_line"))
    return rows.join(firsts, ["file", "ts"]).withColumn("is_first", F.col("line_no") == F.col("first_line")).drop("first_line")


def deltas(unique: DataFrame, interval_ms: int = 0, key: str = "file", ts: str = "ts") -> DataFrame:
    """(key, prev_ts, ts, delta) of all neighbours in time: those within a block, and those across two."""
    rows = blocks.neighbours(unique.select(key, ts), key, ts, interval_ms)
    ends = rows.groupBy(key, "block").agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    across = blocks.seams(ends, key).select(key, "prev_ts", F.col("first").alias(ts), "delta")
    return rows.select(key, "prev_ts", ts, "delta").unionByName(across).where("delta is not null")


def gaps(unique: DataFrame, interval_ms: int, key: str = "file", ts: str = "ts") -> DataFrame:
    """(key, prev_ts, ts, delta, missing) where neighbours are not one interval apart; a short delta misses nothing. Without an interval there are none."""
    rows = deltas(unique, interval_ms, key, ts).where(F.col("delta") != interval_ms if interval_ms else F.lit(False))
    return rows.withColumn("missing", F.greatest(F.expr(f"delta div {interval_ms or 1}") - 1, F.lit(0)))


def _gap(interval_ms: int) -> tuple[Column, Column]:
    """Whether delta is a gap, and the bars that it misses."""
    is_gap = (F.col("delta") != interval_ms) if interval_ms else F.lit(False)
    step = max(interval_ms, 1)
    return is_gap, F.when(is_gap & (F.col("delta") > step), F.expr(f"delta div {step}") - 1).otherwise(0)


def _gap_counts(times: DataFrame, interval_ms: int, key: str, ts: str, sums: dict[str, Column]) -> DataFrame:
    """(key, gaps, missing_bars, first_gap_ts, sums): of each block, then of the key, with the gaps between two blocks."""
    is_gap, missing = _gap(interval_ms)
    first_gap = F.when(is_gap, F.col("prev_ts"))
    rows = blocks.neighbours(times, key, ts, interval_ms)
    ends = rows.groupBy(key, "block").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_if(is_gap).alias("gaps"), F.sum(missing).alias("missing_bars"), F.min(first_gap).alias("first_gap_ts"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    both = [(F.sum("gaps") + F.count_if(is_gap)).alias("gaps"), (F.sum("missing_bars") + F.sum(missing)).alias("missing_bars"), F.min(F.least("first_gap_ts", first_gap)).alias("first_gap_ts")]
    return blocks.seams(ends, key).groupBy(key).agg(*both, *[F.sum(n).alias(n) for n in sums])


def gap_stats(unique: DataFrame, interval_ms: int, key: str = "file", ts: str = "ts") -> DataFrame:
    """(key, n_rows, gaps, missing_bars, first_gap_ts) for every key."""
    rows = _gap_counts(unique.select(key, ts), interval_ms, key, ts, {"n_rows": F.lit(1)})
    return rows.select(key, "n_rows", "gaps", "missing_bars", "first_gap_ts")


def file_report(raw: DataFrame, rule: LineRule, files: DataFrame | None = None) -> DataFrame:
    """One row for each file, or each of ``files`` (file[, read_failed]): counters, gaps and whether it needs repair.

    total_records counts accepted lines, repeats included.
    """
    rows = parsed(raw, rule, skip_header=False)
    is_data = F.col("line_no") > 1
    of_time = F.when(is_data & F.col("accepted"), F.col("ts"))
    times = rows.groupBy("file", of_time.alias("ts")).agg(F.count_if(is_data).alias("n"), F.count_if(is_data & F.col("salvaged")).alias("salvaged"))  # partial sums first, so many copies are no burden
    is_time = F.col("ts").isNotNull()
    sums = {"total_records": F.when(is_time, F.col("n")), "malformed": F.when(~is_time, F.col("n")), "salvaged": F.col("salvaged"), "duplicates": F.when(is_time, F.col("n") - 1)}
    counted = _gap_counts(times, rule.interval_ms, "file", "ts", sums)
    order = _order_counts(rows.where(is_data))
    out = (counted if files is None else files.join(counted, "file", "left")).join(order, "file", "left")
    counters = ["total_records", "malformed", "salvaged", "duplicates", "out_of_order", "gaps", "missing_bars"]
    failed = F.coalesce("read_failed", F.lit(False)) if "read_failed" in out.columns else F.lit(False)
    out = out.select("file", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters], "first_gap_ts", failed.alias("read_failed"))
    return out.withColumn("needs_repair", (F.col("malformed") + F.col("salvaged") + F.col("duplicates") + F.col("out_of_order")) > 0)


def after_repair(report: DataFrame) -> DataFrame:
    """The report with repaired, and total_records as they are after repair: one for each time."""
    total = F.when(F.col("needs_repair"), F.col("total_records") - F.col("duplicates")).otherwise(F.col("total_records"))
    return report.withColumns({"total_records": total, "repaired": F.col("needs_repair")})


def summary(report: DataFrame) -> DataFrame:
    """(files_ok, files_with_issues)."""
    issue = F.col("needs_repair") | (F.col("gaps") > 0) | F.col("read_failed")
    return report.agg(F.count_if(~issue).alias("files_ok"), F.count_if(issue).alias("files_with_issues"))


def verdict(report: DataFrame, repaired: bool = False) -> DataFrame:
    """(any_unresolved): gaps alone resolve themselves."""
    left = F.col("read_failed") if repaired else (F.col("read_failed") | F.col("needs_repair"))
    return report.agg(F.coalesce(F.bool_or(left), F.lit(False)).alias("any_unresolved"))


def report_text(report: DataFrame) -> DataFrame:
    """(file, text): the counters as a sentence, with the time of the first gap."""
    gap = F.when(F.col("gaps") > 0, F.concat(F.lit(" (first gap after "), minute_text(F.col("first_gap_ts")), F.lit(")"))).otherwise("")
    body = F.format_string("%d records, %d malformed, %d salvaged, %d duplicates, %d out of order, %d gaps, %d missing", "total_records", "malformed", "salvaged", "duplicates", "out_of_order", "gaps", "missing_bars")
    return report.select("file", F.concat(body, gap).alias("text"))


def canonical_header(raw: DataFrame, rule: LineRule) -> DataFrame:
    """(file, header): cut to the rule's fields, unless more are allowed."""
    names = lines.fields(F.col("value"))
    cut = F.when(F.size(names) > rule.n_fields, lines.first_fields(names, rule.n_fields)).otherwise(F.col("value"))
    return clean_lines(raw).where("line_no = 1").select("file", (F.col("value") if rule.allow_more else cut).alias("header"))


def repaired(raw: DataFrame, rule: LineRule, report: DataFrame | None = None) -> DataFrame:
    """(file, line_no, line) of the files that need repair, by their report if there is one: header, then one line per time in order of time."""
    dirty = (file_report(raw, rule) if report is None else report).where("needs_repair").select("file")
    raw = raw.join(dirty, "file", "left_semi")
    body = parsed(raw, rule).where("accepted").groupBy("file", "ts").agg(F.min_by("line", "line_no").alias("line"))
    head = canonical_header(raw, rule).select("file", F.lit(None).cast("long").alias("ts"), F.col("header").alias("line"))
    rows = head.unionByName(body).withColumn("block", blocks.of_time(F.col("ts"), rule.interval_ms))
    return blocks.numbered(rows, "file", ["block"], [F.col("ts").asc_nulls_first()], "line_no", counted="line").select("file", "line_no", "line")


def torn_tails(raw: DataFrame, rule: LineRule, floor: int) -> DataFrame:
    """(file, last_line, resume_ts, lines_cut): where each file ends well.

    The last line that is valid and terminated; without one only the header stays and the file
    resumes at the floor. A first line that is valid counts, and nothing is salvaged here. ``raw``
    has terminated besides.
    """
    strict = LineRule(rule.n_fields, rule.allow_more, False, rule.interval_ms)
    good = parsed(raw.where("terminated"), strict, skip_header=False).where("accepted")
    last = good.groupBy("file").agg(F.max(F.struct("line_no", "ts")).alias("last"))
    files = raw.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    rows = files.join(last, "file", "left")
    kept = F.coalesce("last.line_no", F.lit(1))
    return rows.select("file", kept.alias("last_line"), F.coalesce("last.ts", F.lit(floor)).alias("resume_ts"), (F.col("n_lines") - kept).alias("lines_cut"))


def trimmed(raw: DataFrame, rule: LineRule, floor: int) -> DataFrame:
    """The lines up to the last good one."""
    ends = torn_tails(raw, rule, floor).select("file", "last_line")
    return raw.join(ends, "file").where("line_no <= last_line").drop("last_line")


def resume_points(raw: DataFrame, rule: LineRule, floor: int) -> DataFrame:
    """(file, resume_ts): the time of the last valid line by position, or the floor."""
    return torn_tails(raw, rule, floor).select("file", "resume_ts")
