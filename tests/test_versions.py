"""Versions switch at once, whatever fails between two writes; staged runs are merged once."""

import pytest
from pyspark.sql import functions as F

from barkeep.operators import universe
from barkeep.plans import jobs
from barkeep.plans.rules import LineRule
from barkeep.sources.staging import Staging
from barkeep.sources.versions import Conflict, VersionedTable

ROWS = "symbol string, ts long, close double"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"))


def test_versions(spark, table):
    make = lambda *r: spark.createDataFrame(list(r), ROWS)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.version() == 0 and table.keys().collect() == []
    assert table.append(make(("A", 0, 0.0)).limit(0)) == 1 and table.read().collect() == [] and table.keys().collect() == []
    table._fs.delete(table._at("commits"), True)
    assert table.append(make(("A", 1, 1.0), ("001", 1, 1.0))) == 1
    assert table.append(make(("A", 2, 2.0), ("C/ d%", 5, 1.0))) == 2
    assert table.replace(make(("A", 9, 9.0))) == 3
    assert table.remove(make(("001", 0, 0.0)).select("symbol")) == 4
    assert rows_of(table.read(1)) == [("001", 1, 1.0), ("A", 1, 1.0)]
    assert rows_of(table.read(2)) == [("001", 1, 1.0), ("A", 1, 1.0), ("A", 2, 2.0), ("C/ d%", 5, 1.0)]
    assert rows_of(table.read(3)) == [("001", 1, 1.0), ("A", 9, 9.0), ("C/ d%", 5, 1.0)]
    assert rows_of(table.read()) == [("A", 9, 9.0), ("C/ d%", 5, 1.0)]
    assert sorted(r[0] for r in table.keys().collect()) == ["A", "C/ d%"]
    with pytest.raises(ValueError, match="columns"):
        table.append(make(("A", 1, 1.0)).drop("close"))
    for none in (None, ""):
        with pytest.raises(Exception, match="a row without symbol"):
            table.append(make((none, 1, 1.0)))
    assert table.append(make(("A", 1, 1.0)).limit(0)) == 5 and rows_of(table.read()) == [("A", 9, 9.0), ("C/ d%", 5, 1.0)]


def test_a_token_is_committed_once(spark, table):
    rows = spark.createDataFrame([("A", 1, 1.0)], ROWS)
    assert [table.append(rows, token="x"), table.append(rows, token="x"), table.append(rows, token="y")] == [1, 1, 2]
    assert table.read().count() == 2


@pytest.mark.parametrize("step", ["data", "manifest", "commit"])
def test_a_failure_leaves_the_old_version(spark, table, monkeypatch, step):
    """The job dies after the data, after the manifest, or before the commit file has its name."""
    old, new = spark.createDataFrame([("A", 1, 1.0)], ROWS), spark.createDataFrame([("A", 2, 2.0), ("B", 2, 2.0)], ROWS)
    table.append(old)
    with monkeypatch.context() as patch:
        if step == "data":
            patch.setattr(VersionedTable, "_any_folder", lambda *a: 1 / 0)
        elif step == "manifest":
            patch.setattr(VersionedTable, "_publish", lambda *a: 1 / 0)
        else:
            patch.setattr(VersionedTable, "_rename", lambda *a: 1 / 0)
        try:
            table.replace(new)
        except ZeroDivisionError:
            pass
    assert rows_of(table.read()) == [("A", 1, 1.0)]
    assert table.replace(new) == 2 and rows_of(table.read()) == [("A", 2, 2.0), ("B", 2, 2.0)]
    before = len(table.expire(min_age_s=3600))
    assert before == 0 and table.expire(keep=2, min_age_s=0)
    assert rows_of(table.read()) == [("A", 2, 2.0), ("B", 2, 2.0)] and rows_of(table.read(1)) == [("A", 1, 1.0)]


def test_of_two_writers_one_fails(spark, table, monkeypatch):
    rows = spark.createDataFrame([("A", 1, 1.0)], ROWS)
    other = VersionedTable(spark, table.path)
    publish = VersionedTable._publish

    def late(self, *args):
        monkeypatch.setattr(VersionedTable, "_publish", publish)
        other.append(rows.withColumn("ts", F.lit(7).cast("long")))
        publish(self, *args)

    monkeypatch.setattr(VersionedTable, "_publish", late)
    with pytest.raises(Conflict):
        table.append(rows)
    assert rows_of(table.read()) == [("A", 7, 1.0)]


def test_compaction_and_expiry(spark, table):
    table.append(spark.createDataFrame([("A", 1, 1.0), ("B", 1, 1.0)], ROWS))
    table.remove(spark.createDataFrame([("B",)], "symbol string"))
    table.compact()
    assert table.expire(keep=1, min_age_s=0)
    assert len(table._names("data")) == 1 and rows_of(table.read()) == [("A", 1, 1.0)]


def test_folders_of_dead_keys_are_not_read(spark, table):
    """Of a generation with many keys only those that live are read."""
    table.append(spark.range(40).select(F.col("id").cast("string").alias("symbol"), F.col("id").alias("ts"), F.lit(1.0).alias("close")))
    table.remove(spark.range(1, 40).select(F.col("id").cast("string").alias("symbol")))
    out = table.read()
    assert out.collect()[0]["symbol"] == "0"
    plan = out._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString().lower()


def test_repair_and_purge(spark, tmp_path):
    lines = {"X": ["open_time,close", "60000,1", "0,1", "0,1"], "Y": ["open_time,close", "0,1"], "Z": ["open_time,close", "junk"]}
    raw = spark.createDataFrame([(f, i + 1, v) for f, own in lines.items() for i, v in enumerate(own)], "file string, line_no long, value string")
    table = VersionedTable(spark, str(tmp_path / "lines"), "file")
    jobs.load_lines(raw, table)
    rule = LineRule(2, interval_ms=60_000)
    report = {r["file"]: r["repaired"] for r in jobs.repair_table(table, rule).collect()}
    assert report == {"X": True, "Y": False, "Z": True} and table.version() == 2
    assert [r["value"] for r in table.read().where("file = 'X'").orderBy("line_no").collect()] == ["open_time,close", "0,1", "60000,1"]
    assert table.read(1).count() == 8 and table.read().count() == 6
    assert not any(r["repaired"] for r in jobs.repair_table(table, rule).collect()) and table.version() == 2
    assert jobs.purge_table(table, spark.createDataFrame([("X", False), ("Y", True)], "symbol string, is_trading boolean")) == 3
    assert [r[0] for r in table.keys().collect()] == ["Y"]


def test_an_update_is_committed_once(spark, table):
    master = spark.createDataFrame([("A", True, 0, 0), ("B", False, 0, 0)], "symbol string, is_trading boolean, list_time long, delivery_time long")
    wanted = spark.createDataFrame([("A",)], "symbol string")
    table.append(spark.createDataFrame([("A", 1), ("B", 1), ("Z", 1)], "symbol string, ts long"))
    incoming = spark.createDataFrame([("A", 1, 0), ("A", 1_500_000_000_000, 1)], "symbol string, ts long, pos long")
    store = table.read()
    update = jobs.update_bars(incoming, store, master, wanted, "binance", 1_600_000_000_000, 3_600_000, delete_delisted=True)
    gone = universe.delete_set(master, table.keys())
    assert [jobs.apply_update(update, table, gone, "monday"), jobs.apply_update(update, table, gone, "monday")] == [3, 3]
    assert rows_of(table.read()) == [("A", 1), ("A", 1_500_000_000_000)]


@pytest.fixture
def staged(spark, tmp_path):
    """Two runs: one staged batch by batch, the last of them torn, and one at once."""
    stage = Staging(spark, str(tmp_path / "staging"))
    page = lambda s, *times: spark.createDataFrame([(s, t, p) for p, t in enumerate(times)], "symbol string, ts long, pos int")
    stage.stage(page("A", 8, 9), "one", 1)
    stage.stage(page("A", 6, 7), "one", 2)
    stage.stage(page("A", 1), "one", 4)
    stage.stage(page("A", 0), "one", 5)
    (tmp_path / "staging" / "run=one" / "batch_00005" / "_SUCCESS").unlink()
    stage.stage_all(page("B", 1, 2).withColumn("batch_no", F.lit(2)).unionByName(page("B", 3).withColumn("batch_no", F.lit(1))), "two")
    return stage


WANTED = [("A", 1, 1), ("A", 6, 2), ("A", 7, 3), ("A", 8, 4), ("A", 9, 5), ("B", 1, 1), ("B", 2, 2), ("B", 3, 3)]


def test_staged_runs_are_merged_once(staged, table):
    assert tuple(staged.left("one").first()) == ("A", 4, 3, "3")
    assert staged.recover(table) == ["one", "two"]
    assert rows_of(table.read().select("symbol", "ts", "seq")) == WANTED
    assert staged.runs() == [] and staged.recover(table) == []


@pytest.mark.parametrize("after_commit", [False, True])
def test_a_killed_merge_is_recovered(staged, table, monkeypatch, after_commit):
    """Killed between staging and commit, or between the commit and the end of the run: no row is lost or repeated."""
    with monkeypatch.context() as patch, pytest.raises(ZeroDivisionError):
        patch.setattr(*((Staging, "drop", lambda *a: 1 / 0) if after_commit else (VersionedTable, "_publish", lambda *a: 1 / 0)))
        staged.merge("one", table)
    assert staged.runs() == ["one", "two"]
    staged.recover(table)
    staged.recover(table)
    assert rows_of(table.read().select("symbol", "ts", "seq")) == WANTED
