"""Sharding by minimax contiguous partition of ordered atomic groups.

Rows with equal text form one group, which is never split. Groups are ordered by the SHA-256
of their text; the smallest capacity is sought for which cutting greedily along that order
needs no more than the wanted number of shards. So the largest shard is as small as it can be. The
cuts are then made where the shards' sizes come nearest to equal without any going beyond
that capacity, so the last one isn't left with what greedy cuts leave over.

How it runs: only digests and sizes are shuffled, never texts. One table of groups (digest,
offset of its first byte in the order) is written. The search tests PROBES capacities at a
time; a greedy step of all of them reads a narrow part of that table. As the shards are
ranges of digests, a row finds its shard by comparing its digest with the cuts, without a join.
Slots are numbered in cells of (shard, hash of the id), so a shard with most of the rows is
numbered by many tasks.

Defined results: a null text has size OVERHEAD and belongs to the group of the empty text;
repeated rows are kept, each with its own slot; an empty table gives no rows; a group larger than a
share, or fewer groups than shards, leave some shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barkeep.llm._util import long_table, utf8_size, written

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Groups are dealt into so many ranges of digests for the running sums.
RANGE_BITS = 12
#: Capacities tested at once, and groups among which the driver ends the search.
PROBES, WINDOW_GROUPS = 256, 20_000
#: Edges of groups on either side of an even share that are tried as its cut.
EDGES = 6
#: Rows of a shard that one task numbers, about.
CELL_ROWS = 50_000


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _range_of(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, RANGE_BITS // 4), 16, 10).cast("int")


def ordered_groups(rows: DataFrame) -> tuple[DataFrame, dict[int, int], int, int]:
    """From (digest, size): the written table (range, digest, start, size), the start of each range, total and largest size.

    The ranges are 2**RANGE_BITS at most, so their sums are a bounded table for the driver.
    """
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn("range", _range_of(F.col("digest")))
    within = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).repartitionByRange("range").sortWithinPartitions("digest"), "groups")
    sums = sorted(groups.groupBy("range").agg(F.sum("size"), F.max("size")).collect())
    starts, total, largest = {}, 0, 0
    for at, size, most in sums:
        starts[at], total, largest = total, total + size, max(largest, most)
    offsets = long_table(rows.sparkSession, range=list(starts), offset=list(starts.values()))
    groups = groups.join(F.broadcast(offsets.withColumn("range", F.col("range").cast("int"))), "range")
    groups = groups.select("range", "digest", (F.col("inner") + F.col("offset")).alias("start"), "size")
    return written(groups, "ordered-groups"), starts, total, largest


def _holding(groups: DataFrame, starts: dict[int, int], targets: list[int]) -> list[tuple[int, int]]:
    """For each target the start and the end of the group that holds that byte."""
    ranges, edges = list(starts), list(starts.values())
    at = sorted({ranges[bisect_right(edges, t) - 1] for t in targets})
    wanted = F.split(F.lit(" ".join(map(str, sorted({*targets})))), " ")
    held = F.filter(F.transform(wanted, lambda t: t.cast("long")), lambda t: (F.col("start") <= t) & (t < F.col("start") + F.col("size")))
    near = groups.where(F.col("range").between(at[0], at[-1]) & (F.col("start") <= max(targets)) & (F.col("start") + F.col("size") > min(targets)))
    found = {t: (first, first + size) for t, first, size in near.select(F.explode(held).alias("target"), "start", "size").collect()}
    return [found[t] for t in targets]


def _paths(lookup: Callable[[list[int]], list[int]], capacities: list[int], total: int, n_shards: int) -> list[list[int]]:
    """The greedy cuts of each capacity, all taking a step at a time; more than n_shards - 1 of them if it is too small."""
    paths: list[list[int]] = [[] for _ in capacities]
    for _ in range(n_shards):
        inside = [i for i, c in enumerate(capacities) if (paths[i][-1] if paths[i] else 0) + c < total]
        if not inside:
            break
        targets = [(paths[i][-1] if paths[i] else 0) + capacities[i] for i in inside]
        for i, cut in zip(inside, lookup(targets), strict=True):
            paths[i].append(cut)
    return paths


def smallest_capacity(groups: DataFrame, starts: dict[int, int], total: int, largest: int, n_shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the offsets at which shards 1, 2, ... begin.

    A cut never moves back as the capacity grows, so cut k of the answer lies between cut k of
    a capacity that is too small and of one that suffices. PROBES capacities at a time narrow
    these windows until they hold at most WINDOW_GROUPS groups, among which the search ends.
    """
    low, high = max(largest, -(-total // n_shards)), largest + -(-total // n_shards)  # high always suffices
    windows = [(max(0, k * (low - largest)), min(total, k * high)) for k in range(1, n_shards)]
    while True:
        inside = F.lit(False)
        for first, last in windows:
            inside = inside | F.col("start").between(first, last)
        ranges, edges = list(starts), list(starts.values())
        span = (ranges[bisect_right(edges, windows[0][0]) - 1], ranges[-1]) if windows else (0, 0)
        near = groups.where(F.col("range").between(*span) & inside)
        if near.count() <= WINDOW_GROUPS:
            known = sorted(r[0] for r in near.select("start").collect())
            at = lambda targets: [known[bisect_right(known, t) - 1] for t in targets]
            while low < high:
                middle = (low + high) // 2
                if len(_paths(at, [middle], total, n_shards)[0]) < n_shards:
                    high = middle
                else:
                    low = middle + 1
            return low, _paths(at, [low], total, n_shards)[0]
        tried = sorted({*range(low, high, -(-(high - low + 1) // PROBES)), high})
        paths = _paths(lambda targets: [first for first, _ in _holding(groups, starts, targets)], tried, total, n_shards)
        best = next(i for i, p in enumerate(paths) if len(p) < n_shards)
        before = paths[best - 1] if best else [w[0] for w in windows]
        low, high = tried[best - 1] + 1 if best else low, tried[best]
        if low == high:
            return high, paths[best]
        padded = lambda p: [*p, *[total] * n_shards][: n_shards - 1]
        windows = list(zip(padded(before), padded(paths[best]), strict=True))


def near_equal_cuts(holding: Callable[[list[int]], list[tuple[int, int]]], capacity: int, total: int, n_shards: int) -> list[int]:
    """The offsets at which shards 1, 2, ... begin, such that none is larger than ``capacity`` and the smallest is as large as can be.

    Each cut is sought among the EDGES edges of groups on either side of its even share. Where these
    don't do, as with groups larger than a share, each cut is taken as near to its share as its feasible
    window allows: not before the first edge from which the shards behind it suffice, nor past the
    capacity of the shard that it ends. That takes a lookup for each shard.
    """
    aims = [k * total // n_shards for k in range(1, n_shards)]
    if not aims:
        return []
    down, up = map(list, zip(*holding(aims), strict=True))
    near = [{*x} for x in zip(down, up, strict=True)]
    for _ in range(EDGES - 1):
        below, above = [k for k, edge in enumerate(down) if edge > 0], [k for k, edge in enumerate(up) if edge < total]
        found = holding([down[k] - 1 for k in below] + [up[k] for k in above]) if below or above else []
        for k, (first, _) in zip(below, found, strict=False):
            down[k] = first
        for k, (_, last) in zip(above, found[len(below) :], strict=True):
            up[k] = last
        for own, *ends in zip(near, down, up, strict=True):
            own.update(ends)
    return _widest(near, capacity, total) or _feasible(holding, aims, near, capacity, total)


def _widest(near: list[set[int]], capacity: int, total: int) -> list[int]:
    """One of the edges near each aim, so that the smallest shard is as large as can be; none if no choice keeps the capacity."""
    best: dict[int, tuple[int, list[int]]] = {0: (total, [])}  # of each last cut: the smallest shard so far and the cuts
    for edges in [*near, {total}]:
        grown = {}
        for edge in edges:
            paths = [(min(least, edge - last), cuts) for last, (least, cuts) in best.items() if 0 <= edge - last <= capacity]
            if paths:
                least, cuts = max(paths)
                grown[edge] = (least, [*cuts, edge])
        best = grown
    return best[total][1][:-1] if best else []


def _feasible(holding: Callable[[list[int]], list[tuple[int, int]]], aims: list[int], near: list[set[int]], capacity: int, total: int) -> list[int]:
    earliest, at = [], total
    for _ in aims:
        if at > capacity:
            first, last = holding([at - capacity])[0]
            at = first if first == at - capacity else last
        else:
            at = 0
        earliest.insert(0, at)
    cuts, before = [], 0
    for low, aim, edges in zip(earliest, aims, near, strict=True):
        cut = min(edges, key=lambda edge: (abs(edge - aim), edge))
        if cut > before + capacity:
            cut = holding([before + capacity])[0][0]
        cuts.append(max(cut, low))
        before = cuts[-1]
    return cuts


def shard_of(digest: Column, cut_digests: list[str]) -> Column:
    """The number of cuts at or before a digest."""
    if not cut_digests:
        return F.lit(0)
    cuts = F.split(F.lit(" ".join(cut_digests)), " ")
    return F.size(F.filter(cuts, lambda c: c <= digest))


def minimax_shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        _digest(F.col(text)).alias("digest"),
        (utf8_size(F.col(text)) + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    )
    groups, starts, total, largest = ordered_groups(rows.select("digest", "size"))
    cut_digests: list[str] = []
    if total:
        capacity, _ = smallest_capacity(groups, starts, total, largest, n_shards)
        cuts = near_equal_cuts(lambda targets: _holding(groups, starts, targets), capacity, total, n_shards)
        at = F.broadcast(long_table(docs.sparkSession, cut=cuts))
        cut_digests = sorted(r[0] for r in groups.join(at, F.col("start") == F.col("cut")).select("digest").collect())
    placed = rows.withColumn("shard", shard_of(F.col("digest"), cut_digests)).drop("digest")
    return slotted(written(placed, "placed"))


def slotted(placed: DataFrame) -> DataFrame:
    """``placed`` with the column slot, gapless from 0 in each shard."""
    n_rows = placed.groupBy("shard").count()
    salts = {r["shard"]: 1 + r["count"] // CELL_ROWS for r in n_rows.collect()}  # as many rows as shards
    by = long_table(placed.sparkSession, shard=list(salts), salts=list(salts.values())).withColumn("shard", F.col("shard").cast("int"))
    cells = placed.join(F.broadcast(by), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.groupBy("shard", "salt").count().select("shard", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inner = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    return cells.withColumn("inner", inner).join(firsts, ["shard", "salt"]).withColumn("slot", F.col("inner") + F.col("first")).drop("salt", "inner", "first")
