"""Exact duplicates by a tree of merges over sorted runs of digests.

Every row becomes a record of fixed width: two digests of its normalised text, its length, its id and its
number in the table. A task sorts its records into runs and keeps one record for each text, with the count
of rows behind it. Then the runs are merged in rounds: there are FAN ** rounds nodes, a node cuts its runs
at the next digit of the digest and sends each part to the partner with that digit, and the FAN parts that
meet are merged into one run. After the last round each node has its own range of digests, with every text
once. A record crosses the network once a round, a copy is dropped at the first node where it meets
another one, so a text that a third of all rows share is one record in each run and no node's burden.

The short digest orders a run; records are only merged if their SHA-256 is equal too, at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barkeep.llm._util import hot_keys, spread_join, written

#: Records of a run, and about as many of a node after the last round.
RUN_ROWS = 16_384
#: Parts that a run is cut into in a round, and runs that are merged at least.
FAN = 8
RECORD = np.dtype([("digest", "<u8"), ("sha", "<u8", 4), ("n_chars", "<i8"), ("no_id", "<i8"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])
_RUN = "node long, run binary"
_DIGIT = FAN.bit_length() - 1


def normalised(text: Column) -> Column:
    """The text without spaces and U+0009 to U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_chars, digest, sha) of every row; row numbers the rows, sha is the SHA-256 of the normalised text as hexadecimal digits."""
    plain = normalised(F.col(f"`{text_col}`"))
    length = F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), length.alias("n_chars"), plain.alias("plain"))
    return rows.select("row", "id", "n_chars", F.xxhash64("plain").alias("digest"), F.sha2("plain", 256).alias("sha"))


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """One run of all records; of those of one text the longest stays, then that with the smallest id (none comes last), then the first row."""
    rows = np.concatenate(runs)
    rows = rows[np.lexsort((rows["row"], rows["id"], rows["no_id"], -rows["n_chars"], *rows["sha"].T[::-1], rows["digest"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["digest"][1:] != rows["digest"][:-1]) | (rows["sha"][1:] != rows["sha"][:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    out = rows[starts]
    if len(starts):
        out["count"] = np.add.reduceat(rows["count"], starts)
    return out


def _cut(run: np.ndarray, node: int, level: int) -> Iterator[tuple[int, bytes]]:
    """The parts of a node's run by the digit of this level, each with the node that it goes to."""
    shift = np.uint64(64 - _DIGIT * (level + 1))
    digit = (run["digest"] >> shift) & np.uint64(FAN - 1)
    own = node - (node // FAN**level % FAN) * FAN**level
    for d in range(FAN):
        part = run[digit == d]
        if len(part):
            yield own + d * FAN**level, part.tobytes()


def _as_batch(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"node": pa.array([n for n, _ in parts], pa.int64()), "run": pa.array([r for _, r in parts], pa.binary())})


def _sorted_runs(n_nodes: int):
    """A task's records as sorted runs, cut for the first round."""

    def records(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, RECORD)
        ids = batch.column("id")
        for name in ("digest", "n_chars", "row"):
            out[name] = batch.column(name).to_numpy(zero_copy_only=False)
        out["id"], out["no_id"], out["count"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), 1
        out["sha"] = np.frombuffer(bytes.fromhex("".join(batch.column("sha").to_pylist())), ">u8").reshape(-1, 4)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            node = (int(held[0]["row"][0] >> 33) + number) % n_nodes  # the partition's number is in a row's number
            return _as_batch(list(_cut(merged(held), node, 0)))

        for batch in batches:
            if batch.num_rows:
                held.append(records(batch))
                n += batch.num_rows
            if n >= RUN_ROWS:
                yield flush()
                held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def _merge(level: int, last: bool):
    """Merges the runs that met at a node after round ``level``, and cuts the result for the next one."""

    def run(node: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = node[0].as_py()
        whole, held, n = None, [], 0
        for batch in batches:
            for x in batch.column("run"):
                held.append(np.frombuffer(x.as_buffer(), RECORD))
                n += len(held[-1])
                if n >= 4 * RUN_ROWS:  # so that copies go before all runs are there
                    held, n = [merged(held)], 0
        whole = merged(held)
        yield _as_batch([(at, whole.tobytes())] if last else list(_cut(whole, at, level + 1)))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, keep_id, keep_row, group_size) of the merged runs."""
    for batch in batches:
        for x in batch.column("run"):
            rows = np.frombuffer(x.as_buffer(), RECORD)
            shas, wide = rows["sha"].astype(">u8").tobytes().hex(), 64
            ids = pa.array(rows["id"], pa.int64(), mask=rows["no_id"] != 0)
            yield pa.record_batch({"sha": pa.array([shas[i : i + wide] for i in range(0, len(shas), wide)]), "keep_id": ids, "keep_row": pa.array(rows["row"]), "group_size": pa.array(rows["count"])})


def distinct_texts(rows: DataFrame, n_rows: int) -> DataFrame:
    """(sha, keep_id, keep_row, group_size) of every distinct text of ``rows``, as ``digests`` gives them; n_rows settles how many rounds there are."""
    rounds = 1
    while FAN**rounds * RUN_ROWS < n_rows and rounds < 60 // _DIGIT:
        rounds += 1
    runs = rows.mapInArrow(_sorted_runs(FAN**rounds), _RUN)
    for level in range(rounds):
        runs = runs.groupBy("node").applyInArrow(_merge(level, level == rounds - 1), _RUN)
    return runs.mapInArrow(_texts, "sha string, keep_id long, keep_row long, group_size long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for every row of ``docs``.

    Texts are equal when they are the same after every space and U+0009 to U+000D is deleted; null and
    empty texts are one group with those that have nothing else. Of a group the row with the most code
    points stays, then that with the smallest id; a row without an id comes after those with one, and of
    repeated rows exactly one stays. Ids are whole numbers; other columns don't matter. An empty table
    gives no rows.
    """
    rows = written(digests(docs, id_col, text_col), "digests", compression="zstd")
    n_rows = rows.count()
    texts = written(distinct_texts(rows, n_rows), "texts", compression="zstd")
    hot = hot_keys(texts, "sha", "group_size", n_rows)
    out = spread_join(rows.select("row", "id", "sha"), texts, "sha", hot, by=["row"])
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
