"""Pages that arrive newest first, staged in numbered batches until their run is complete.

A run is a folder of batches. A batch counts once Spark has marked it as written. A run is merged into a
versioned table by one commit that bears the run's name, so a run that was killed before or after that
commit is merged by ``recover`` exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.functions.lines import batch_name, batch_number
from barkeep.operators.append import merge_staged, recoverable
from barkeep.sources.versions import VersionedTable


class Staging:
    """Staged batches of (symbol, pos, ...) below a folder; pos orders the rows of a batch in time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def stage(self, rows: DataFrame, run: str, number: int) -> None:
        """Writes a batch, in place of what a failed try may have left; 1 is the newest."""
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}/batch_{number:05d}")

    def stage_all(self, rows: DataFrame, run: str) -> None:
        """Stages the rows of many batches at once, by their column batch_no."""
        name = batch_name(F.col("batch_no"))
        at = f"{self.path}/run={run}"
        rows.withColumn("batch_name", name).drop("batch_no").hint("rebalance", "batch_name").write.mode("overwrite").partitionBy("batch_name").parquet(f"{at}/all")

    def runs(self) -> list[str]:
        return [n.removeprefix("run=") for n in self._names("") if n.startswith("run=")]

    def batches(self, run: str) -> DataFrame | None:
        """The rows of all whole batches of a run, with batch_no; None if there is none. Symbols lack batches that only others have."""
        at = f"{self.path}/run={run}"
        done = [n for n in self._names(f"/run={run}") if "_SUCCESS" in self._names(f"/run={run}/{n}")]
        single = [f"{at}/{n}" for n in done if n.startswith("batch_")]
        parts = []
        if single:
            parts.append(self.spark.read.parquet(*single).withColumn("batch_no", batch_number(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))))
        if "all" in done and any("=" in n for n in self._names(f"/run={run}/all")):
            parts.append(self.spark.read.parquet(f"{at}/all").withColumn("batch_no", batch_number(F.col("batch_name"))).drop("batch_name"))
        return (parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]) if parts else None

    def merge(self, run: str, table: VersionedTable) -> int:
        """Commits a run to the table, in order of time by the column seq, and drops it; nothing is added if a commit bears its name. The table's version."""
        rows = self.batches(run)
        version = table.version() if rows is None else table.append(merge_staged(rows).drop("batch_no", "pos"), token=f"staged {run}")
        self.drop(run)
        return version

    def drop(self, run: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run={run}"), True)

    def left(self, run: str) -> DataFrame | None:
        """(symbol, last_batch, n_batches, missing) of a run that was left staged."""
        rows = self.batches(run)
        return None if rows is None else recoverable(rows, self.spark.createDataFrame([], "symbol string"))

    def recover(self, table: VersionedTable) -> list[str]:
        """Merges what earlier runs have left, each run once; the names of the runs."""
        found = self.runs()
        for run in found:
            self.merge(run, table)
        return found
