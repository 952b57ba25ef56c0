"""A Parquet table of many keys whose versions switch at once.

``data/gen=<id>/<key>=<value>`` has the rows that one commit wrote, ``manifests`` the live (key, gen) pairs, and
``commits/<number>`` says which generations and manifests the version has: an append adds one of each, a replacement or
removal writes the manifest anew. A commit file gets its name in one step, if no other
has that name, after all else is written; so readers see the version before or after a commit, never one between, and of two
writers one fails. What a failed try leaves is in no manifest; ``expire`` deletes it with old generations.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barkeep.sources.sinks import FILE_ROWS


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class VersionedTable:
    """Rows by ``key``, a column of strings; a null or empty one is an error. A commit adds rows, replaces or removes whole keys."""

    def __init__(self, spark: SparkSession, path: str, key: str = "symbol"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # Versions

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change) of what a folder has; one entry for each commit or generation."""
        at = self._at(folder)
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n) for n, _ in self._names("commits") if n.isdigit()]

    def _record(self, number: int) -> dict | None:
        """What a commit file says; None for version 0."""
        return json.loads(self.spark.read.text(f"{self.path}/commits/{number:08d}", wholetext=True).first()[0]) if number else None

    def _latest(self) -> tuple[int, dict | None]:
        number = max(self._numbers(), default=0)
        return number, self._record(number)

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return self._latest()[0]

    def committed(self, token: str) -> bool:
        """Whether a commit bears this token."""
        if not self._numbers():
            return False
        said = self.spark.read.text(f"{self.path}/commits").select(F.get_json_object("value", "$.token").alias("token"))
        return not said.where(F.col("token") == token).isEmpty()

    # Reading

    def _manifest(self, record: dict | None) -> DataFrame:
        schema = f"`{self.key}` string, gen string"
        names = record["manifests"] if record else []
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/manifests/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _generations(self, record: dict, names: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(record["schema"])
        return self.spark.read.schema(schema.add("gen", "string")).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/gen={g}" for g in names])

    def keys(self, version: int | None = None) -> DataFrame:
        """The distinct keys; no data is read."""
        number, record = self._latest() if version is None else (version, self._record(version))
        return self._manifest(record).select(self.key).distinct()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named. Generations of which all keys live are read as they are, the others through the manifest, by which Spark prunes their folders."""
        number, record = self._latest() if version is None else (version, self._record(version))
        if record is None:
            raise ValueError(f"{self.path} has no version {number or 'yet'}")
        whole, partly = ([g for g, w in record["gens"].items() if w is wanted] for wanted in (True, False))
        parts = [self._generations(record, whole)] if whole else []
        if partly:
            parts.append(self._generations(record, partly).join(self._manifest(record).where(F.col("gen").isin(partly)), [self.key, "gen"], "left_semi"))
        rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else self.spark.createDataFrame([], T.StructType.fromJson(record["schema"]))
        return rows.select(*[f for f in T.StructType.fromJson(record["schema"]).names])

    # Writing

    def append(self, rows: DataFrame, token: str | None = None) -> int:
        """Adds rows; with a token nothing happens if a commit bears it already. The number of the version."""
        return self._commit(rows, None, token)

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """Puts ``rows`` in place of all rows of the keys that they have; other keys aren't touched."""
        return self._commit(rows, "rows", token)

    def remove(self, keys: DataFrame, token: str | None = None) -> int:
        """Takes the keys in the first column of ``keys`` out; only a manifest is written."""
        return self._commit(None, keys, token)

    def _commit(self, rows: DataFrame | None, gone: DataFrame | str | None, token: str | None) -> int:
        number, record = self._latest()
        if token is not None and self.committed(token):
            return number
        gen = uuid.uuid4().hex
        gens, manifests = (dict(record["gens"]), list(record["manifests"])) if record else ({}, [])
        schema = T.StructType.fromJson(record["schema"]) if record else None
        own = None
        if rows is not None:
            if schema is not None and set(schema.names) != set(rows.columns):
                raise ValueError(f"the table has the columns {', '.join(schema.names)}")
            schema = schema or rows.schema
            key = F.col(self.key).cast("string")
            named = F.when(key.isNull() | (key == ""), F.raise_error(F.lit(f"a row without {self.key}")).cast("string")).otherwise(key)
            spread = rows.select(*schema.names).withColumn(self.key, named).hint("rebalance", self.key)
            spread.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(self.key).parquet(f"{self.path}/data/gen={gen}")
            if self._any_folder(gen):
                own = self._generations({"schema": schema.jsonValue()}, [gen]).select(self.key, "gen").distinct()
                gens[gen] = True
        taken = own if isinstance(gone, str) else gone
        if taken is not None:  # else the other keys stay as they are, and only the new pairs are written
            rest = self._manifest(record).join(taken.select(F.col(taken.columns[0]).alias(self.key)), self.key, "left_anti").select(self.key, "gen")
            (rest if own is None else rest.unionByName(own)).write.parquet(f"{self.path}/manifests/{gen}")
            live = {r.gen for r in self.spark.read.parquet(f"{self.path}/manifests/{gen}").select("gen").distinct().collect()}  # one row for each generation
            gens, manifests = {g: w and g == gen for g, w in gens.items() if g in live}, [gen]
        elif own is not None:
            own.write.parquet(f"{self.path}/manifests/{gen}")
            manifests.append(gen)
        self._publish(number + 1, {"id": gen, "manifests": manifests, "gens": gens, "schema": (schema or T.StructType()).jsonValue(), "token": token})
        return number + 1

    def _any_folder(self, gen: str) -> bool:
        found = self._fs.listStatusIterator(self._at(f"data/gen={gen}"))
        while found.hasNext():  # the first folder ends it
            if "=" in found.next().getPath().getName():
                return True
        return False

    def _publish(self, number: int, record: dict) -> None:
        """The switch: gives the written commit file its name, in one step and only if there is none of that name."""
        half, final = self._at(f"commits/.{record['id']}"), self._at(f"commits/{number:08d}")
        out = self._fs.create(half)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._rename(half, final)

    def _rename(self, half, final) -> None:
        hadoop, sc = self._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        how = sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(half, final, how)
        except Exception as e:
            self._fs.delete(half, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{final} is there") from e
            raise

    def compact(self) -> int:
        """Writes all rows as one generation, so that keys which were removed or replaced can be deleted from disk."""
        return self.replace(self.read())

    def expire(self, keep: int = 2, min_age_s: float = 86_400) -> list[str]:
        """Deletes the generations and manifests that the last ``keep`` versions don't need, if they are older than ``min_age_s``; commit files stay. The deleted names."""
        kept = [self._record(n) for n in sorted(self._numbers())[-keep:]]
        live = {f"gen={g}" for r in kept for g in r["gens"]} | {m for r in kept for m in r["manifests"]}
        old = (time.time() - min_age_s) * 1000
        dead = [f"{folder}/{n}" for folder in ("data", "manifests") for n, changed in self._names(folder) if n not in live and changed <= old]
        for name in dead:
            self._fs.delete(self._at(name), True)
        return dead
