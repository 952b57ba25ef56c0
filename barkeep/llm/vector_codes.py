"""Codes of vectors by product quantisation, with the codebooks of an exact integer Lloyd iteration over two trees.

The components of a vector become whole numbers and are cut into PARTS equal parts; each part position has
its codebook. Tasks gather vectors into blocks of BLOCK and keep, for each part position, the parts of a
block in the order of a tree: a node is a range of that order, cut in halves along its widest component. The
blocks are written once and read in every round. A round grows a tree over the entries of each codebook and
walks both trees together, level by level. A pair of nodes goes on as long as the entries below it may be
nearest to some of the parts: not if the least distance of the two boxes is above the largest distance of
another one, nor if an entry is farther than another one in every corner of the box of parts. A node with one
entry left is assigned as a whole, by the sums that the order's running totals give; the parts of leaves with
several entries left are compared one by one. Bounds and distances are whole numbers of 64 bits, so nothing
is lost by rounding. A task sends one sum for each entry; only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barkeep.llm._util import hot_keys, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one tree, and parts of a leaf.
BLOCK, LEAF = 4_096, 64


def _fits(vector: Column) -> Column:
    """Whether a vector can be coded: a multiple of PARTS long, without nulls, and finite. (An error of larger components would not fit a long.)"""
    limit = F.sqrt(F.lit(2.0**60) / F.size(vector)) / SCALE - 1
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= limit))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & ~odd, F.lit(False))


class Tree:
    """A tree over the rows of ``points``, which are in its order already; cut down to nodes of ``leaf`` rows.

    ``levels`` has the edges of the nodes of each level, ``boxes`` their least and largest components.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points.astype(np.int64)
        self.levels = [np.array([0, len(points)])]
        while np.diff(self.levels[-1]).max() > leaf:
            self.levels.append(_halved(self.levels[-1]))
        self.boxes = [(np.minimum.reduceat(self.points, e[:-1]), np.maximum.reduceat(self.points, e[:-1])) for e in self.levels]
        self.totals = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=self.totals[1:])

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The first child of each node of a level, and how many it has."""
        at = np.searchsorted(self.levels[level + 1], self.levels[level])
        return at[:-1], np.diff(at)


def _halved(edges: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order in which ``Tree`` takes the rows of ``points``."""
    order, edges = np.arange(len(points)), np.array([0, len(points)])
    while np.diff(edges).max() > leaf:
        rows, node = points[order], np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        widest = (np.maximum.reduceat(rows, edges[:-1]) - np.minimum.reduceat(rows, edges[:-1])).argmax(axis=1)
        order = order[np.lexsort((rows[np.arange(len(rows)), widest[node]], node))]
        edges = _halved(edges)
    return order


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + count[i] - 1, for each i in turn."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _groups(q: np.ndarray) -> np.ndarray:
    """Where a new number begins in a sorted list."""
    return np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)


def assign(tree: Tree, entries: Tree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of every row of ``tree``, ties to the lowest number: (starts, ends, numbers) of ranges with one entry.

    ``entries`` goes down to single entries; ``number`` has the number of each one in its order.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q = e = np.zeros(1, np.int64)
    a = b = 0
    while len(q):
        (low, high), (e_low, e_high) = (x[q] for x in tree.boxes[a]), (x[e] for x in entries.boxes[b])
        near = np.maximum(np.maximum(e_low - high, low - e_high), 0)
        far = np.maximum(high - e_low, e_high - low)
        near, far = (near * near).sum(axis=1), (far * far).sum(axis=1)
        at = _groups(q)
        size = np.diff(np.append(at, len(q)))
        keep = near <= np.repeat(np.minimum.reduceat(far, at), size)
        if b == len(entries.levels) - 1:
            best = at + [x.argmin() for x in np.split(far, at[1:])]
            other, best = entries.points[e], np.repeat(e[best], size)
            apart = other - entries.points[best]
            least = (other * other).sum(axis=1) - (entries.points[best] ** 2).sum(axis=1) - 2 * np.maximum(low * apart, high * apart).sum(axis=1)
            keep &= (least < 0) | ((least == 0) & (number[e] <= number[best]))
            q, e = q[keep], e[keep]
            at = _groups(q)
            alone = np.repeat(np.diff(np.append(at, len(q))) == 1, np.diff(np.append(at, len(q))))
            edges = tree.levels[a]
            found.append((edges[q[alone]], edges[q[alone] + 1], number[e[alone]]))
            q, e = q[~alone], e[~alone]
            if a == len(tree.levels) - 1:
                break
        else:
            q, e = q[keep], e[keep]
        for which in range(2):
            levels, level = ((tree.levels, a), (entries.levels, b))[which]
            if level < len(levels) - 1:
                first, count = (tree, entries)[which].children(level)
                if which:
                    q, e = np.repeat(q, count[e]), _spread(first[e], count[e])
                else:  # the pairs of a node's first child go before those of its next one
                    at = _groups(q)
                    size, nodes = np.diff(np.append(at, len(q))), q[at]
                    again = np.repeat(at, count[nodes])
                    q, e = np.repeat(_spread(first[nodes], count[nodes]), np.repeat(size, count[nodes])), e[_spread(again, np.repeat(size, count[nodes]))]
        a, b = min(a + 1, len(tree.levels) - 1), min(b + 1, len(entries.levels) - 1)
    found.append(_compared(tree, entries, number, q, e))
    return tuple(np.concatenate(x) for x in zip(*found))


def _compared(tree: Tree, entries: Tree, number: np.ndarray, q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the leaves q, each compared with all entries e that its leaf has left."""
    edges, at = tree.levels[-1], _groups(q)
    squares = (entries.points * entries.points).sum(axis=1)
    leaves, codes = q[at], [np.zeros(0, np.int64)]
    for leaf, left in zip(leaves, np.split(e, at[1:])):
        left = left[np.argsort(number[left])]  # the first of several minima is the lowest number
        apart = squares[left] - 2 * (tree.points[edges[leaf] : edges[leaf + 1]] @ entries.points[left].T)  # less the square of the part, which is the same for all
        codes.append(number[left[apart.argmin(axis=1)]])
    rows = _spread(edges[leaves], edges[leaves + 1] - edges[leaves])
    return rows, rows + 1, np.concatenate(codes)


def _blocks(width: int, label_type: pa.DataType):
    """Vectors as blocks with the order of each part position's tree."""

    def block(batch: pa.Table) -> pa.RecordBatch:
        parts = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in batch.column("vector").chunks]).astype(np.int32).reshape(-1, PARTS, width // PARTS)
        orders = [tree_order(parts[:, k], LEAF).astype(np.int32) for k in range(PARTS)]
        lists = {c: pa.array([batch.column(c).to_pylist()], pa.list_(t)) for c, t in (("ids", pa.int64()), ("labels", label_type))}
        return pa.record_batch(lists | {"orders": pa.array([[o.tobytes() for o in orders]]), "parts": pa.array([[parts[o, k].tobytes() for k, o in enumerate(orders)]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK))
                held, n = rows.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _trees(codebooks: np.ndarray) -> list[tuple[Tree, np.ndarray]]:
    orders = [tree_order(book, 1) for book in codebooks]
    return [(Tree(book[order], 1), order) for book, order in zip(codebooks, orders, strict=True)]


def _parts(batch: pa.RecordBatch, row: int, k: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column("parts")[row][k].as_buffer(), np.int32).reshape(-1, width // PARTS)


def _sums(codebooks: np.ndarray):
    """(part, entry, n, sums) of the parts of a task that are nearest to each entry."""
    _, n_entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _trees(codebooks)
        sums, n = np.zeros((PARTS, n_entries, width), np.int64), np.zeros((PARTS, n_entries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for k, (entries, number) in enumerate(books):
                    tree = Tree(_parts(batch, row, k, PARTS * width), LEAF)
                    starts, ends, code = assign(tree, entries, number)
                    np.add.at(sums[k], code, tree.totals[ends] - tree.totals[starts])
                    np.add.at(n[k], code, ends - starts)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry]), "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    return run


def _codes(codebooks: np.ndarray):
    """(vec_id, label, code, error) of every vector."""
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _trees(codebooks)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes, errors = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, (entries, number) in enumerate(books):
                    tree = Tree(_parts(batch, row, k, PARTS * width), LEAF)
                    starts, ends, code = assign(tree, entries, number)
                    near = np.zeros(len(ids), np.int64)
                    near[_spread(starts, ends - starts)] = np.repeat(code, ends - starts)
                    order = np.frombuffer(batch.column("orders")[row][k].as_buffer(), np.int32)
                    codes[order, k] = near
                    errors[order] += ((tree.points - codebooks[k][near]) ** 2).sum(axis=1)
                digits = codes.tobytes().hex()
                yield pa.record_batch({"vec_id": ids, "label": labels, "code": pa.array([digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)], pa.string()), "error": pa.array(errors)})

    return run


def refined(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the mean of its parts, rounded down; unused ones stay."""
    sums = blocks.select("parts").mapInArrow(_sums(codebooks), "part int, entry int, n long, sums array<long>")
    totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(codebooks.shape[2])]).alias("sums"))
    out = codebooks.copy()
    for r in totals.collect():  # one row for each entry
        out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of the vectors that can be coded, written to the shared folder; see ``codes``."""
    spark = vectors.sparkSession
    own = [F.col(f"`{c}`") for c in (id_col, label_col, vector_col)]
    rows = vectors.select(own[0].cast("long").alias("ids"), own[1].alias("labels"), own[2].alias("vector")).where(_fits(F.col("vector")))
    first = rows.select("ids", F.size("vector").alias("size")).orderBy(F.asc_nulls_last("ids"), "size").first()
    schema = vectors.select(own[1].alias("label")).schema
    if first is None:
        return spark.createDataFrame([], f"vec_id long, label {schema['label'].dataType.simpleString()}, code string, error long"), np.zeros((PARTS, 0, 0), np.int64)
    width = first["size"]
    rows = rows.where(F.size("vector") == width).withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("int")))
    seeds = np.array([r.vector for r in rows.orderBy(F.asc_nulls_last("ids"), "vector").limit(ENTRIES).select("vector").collect()], np.int64)
    codebooks = seeds.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    label = schema["label"].dataType.simpleString()
    blocks = written(rows.mapInArrow(_blocks(width, to_arrow_type(schema["label"].dataType)), f"ids array<long>, labels array<{label}>, orders array<binary>, parts array<binary>"), "vector-blocks")
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks)
    return written(blocks.mapInArrow(_codes(codebooks), f"vec_id long, label {label}, code string, error long"), "vector-codes"), codebooks


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each vector that can be coded.

    A component x becomes floor(SCALE * x). The codebooks begin with the parts of the ENTRIES smallest ids
    (equal ids by their vectors, no id last; fewer entries where there are fewer vectors), see four rounds of
    Lloyd's iteration, and then all parts are assigned again, ties to the lowest entry. ``code`` has two hexadecimal digits for each
    part's entry, ``error`` is the squared distance, ``label_error`` its sum over rows of the same label, nulls
    together. Left out are vectors that are null or empty, hold null or non-finite components or some beyond
    ±131,000 (for 64 of them; so that errors fit a long), can't be cut into PARTS equal parts, or aren't as long as that of the
    smallest id. Ids are whole numbers and may be null or repeat; other columns don't matter. An empty table gives no rows.
    """
    rows, codebooks = encoded(vectors, id_col, vector_col, label_col, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = rows.withColumn("key", key)
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hot = hot_keys(sums, "key", "n", rows.count())
    out = spread_join(rows, sums.drop("n"), "key", hot, by=["vec_id", "code", "error"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
