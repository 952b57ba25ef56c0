"""Near duplicates among embeddings: tiles in the order of the principal components.

Vectors are scaled to length 1 and turned so that the leading dimensions hold most of the
variance (the second moments are summed over all vectors; a matrix of dimension squared reaches
the driver). Vectors of a label are sorted along the first dimension and cut into tiles. Two
tiles are compared only if their bounding boxes in the leading dimensions are near enough for
the wanted cosine. In a comparison the products are accumulated block by block of dimensions;
the rest of a product is bounded by the product of the suffix norms, and rows, columns and
finally single pairs drop out as soon as their cosine cannot reach the threshold any more.
Pairs within a rounding error of it are decided by the cosine of the vectors as given.

Equal vectors of a label are first grouped, and one of each group is compared, with the group's
size as weight. A comparison returns for each vector the weight it links to, and a spanning
forest of its links, never all pairs.

Defined results: vectors that are null, zero, or hold a null or a value that is not finite
link with nothing, and neither do those without a label; vectors of different lengths never
link; repeated ids are compared each on its own, but share one id in the result's components;
an empty table gives no rows. Ids are integers of up to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barkeep.llm._util import hot_keys, small_batches, spread_join, written
from barkeep.llm.components import components, forest

THRESHOLD = 0.98
#: Vectors in a tile, leading dimensions of its bounding box, dimensions added at a time.
TILE, BOX, BLOCK = 1024, 6, 8
#: Matrices that are added in one task.
SUMMED = 32
#: How far rounding may move a cosine of the turned vectors, which are kept in single precision.
SLACK = 2e-5
#: Quantile ranges of a label's leading coordinate, the most.
RANGES = 64


def _can_link() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(given & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """Of (vec_id, label, embedding): the rows that can link, as (vec_id, same, values): same is equal for equal vectors of a label.

    Vectors are told apart by 128 bits of hashes, so that they need not travel to be grouped.
    """
    plain = F.transform("embedding", lambda x: F.when(x == 0, x * 0 + 0).otherwise(x))  # -0.0 equals 0.0
    rows = vectors.where(_can_link()).select("vec_id", "label", plain.cast(vectors.schema["embedding"].dataType).alias("values"))
    same = F.struct("label", F.xxhash64(F.lit(1), "values").alias("h1"), F.xxhash64(F.lit(2), "values").alias("h2"))
    return rows.select("vec_id", same.alias("same"), "values")


def _unit(given: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1."""
    scaled = given / np.abs(given).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _given(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a column, filled up with zeros to one width."""
    lengths = np.diff(column.offsets.to_numpy())
    given = np.zeros((len(column), width))
    given[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return given


def basis(groups: DataFrame, width: int) -> np.ndarray:
    """Principal directions of the scaled vectors, strongest first, as columns.

    A task sends one matrix in one row; SUMMED tasks' matrices at a time are added before the rest meet.
    """
    upper = np.triu_indices(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            if batch.num_rows:
                unit, seen = _unit(_given(batch.column(0), width)), True
                total += unit.T @ unit
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // SUMMED], pa.int64()), pa.array([total[upper].tobytes()])], ["part", "total"])

    def added(part: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]))
        for batch in batches:
            for x in batch.column("total"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([part[0].as_py() // SUMMED], pa.int64()), pa.array([total.tobytes()])], ["part", "total"])

    sums = groups.select("values").mapInArrow(moments, "part long, total binary")
    tasks = sums.rdd.getNumPartitions()
    while tasks > 1:
        sums, tasks = sums.groupBy("part").applyInArrow(added, "part long, total binary"), -(-tasks // SUMMED)
    matrix = np.zeros((width, width))
    for row in sums.collect():  # one at the most
        matrix[upper] += np.frombuffer(row.total)
    matrix = np.round(matrix + np.triu(matrix, 1).T, 9)  # sums come in any order; the basis should not depend on it
    return np.linalg.eigh(matrix)[1][:, ::-1].copy()


def _led(groups: DataFrame, directions: Broadcast) -> DataFrame:
    """Adds lead, the leading coordinate of the turned vector, and packs values as bytes."""
    names = [c for c in groups.columns if c != "values"]
    kind = _number(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(len(names))
                lead = _unit(_given(column, len(directions.value))) @ directions.value[:, 0]
                values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(np.diff(column.offsets.to_numpy()))
                packed = [v.tobytes() for v in np.split(values, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lead), pa.array(packed, pa.binary())], [*names, "lead", "given"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields if f.name in names)
    return groups.select(*names, "values").mapInArrow(run, f"{kinds}, lead double, given binary")


def _number(groups: DataFrame) -> np.dtype:
    """The type in which vectors travel: single precision if they come so."""
    return np.dtype("<f4" if groups.schema["values"].dataType.elementType.simpleString() == "float" else "<f8")


def close_pairs(x: np.ndarray, y: np.ndarray, given_x: np.ndarray, given_y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs with cosine of at least the threshold. x and y are turned and of length 1."""
    suffix = [np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in (x, y)]
    rows, columns = np.arange(len(x)), np.arange(len(y))
    sums = np.zeros((len(x), len(y)))
    width = x.shape[1]
    for at in range(0, width, BLOCK):
        to = min(at + BLOCK, width)
        sums += x[rows, at:to] @ y[columns, at:to].T
        if to == width:
            alive = sums >= threshold - SLACK
        else:
            alive = sums + suffix[0][rows, to, None] * suffix[1][None, columns, to] >= threshold - SLACK
        i, j = np.nonzero(alive)
        if not len(i) or to == width:
            break
        if len(i) * 8 < sums.size:  # few are left: go on pair by pair
            i, j, part = rows[i], columns[j], sums[i, j]
            for at2 in range(to, width, BLOCK):
                to2 = min(at2 + BLOCK, width)
                part = part + np.einsum("ij,ij->i", x[i, at2:to2], y[j, at2:to2])
                bound = suffix[0][i, to2] * suffix[1][j, to2] if to2 < width else 0.0
                left = part + bound >= threshold - SLACK
                i, j, part = i[left], j[left], part[left]
            return _decided(i, j, part, given_x, given_y, threshold)
        own_rows, own_columns = alive.any(axis=1), alive.any(axis=0)
        rows, columns, sums = rows[own_rows], columns[own_columns], sums[np.ix_(own_rows, own_columns)]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _decided(rows[i], columns[j], sums[i, j], given_x, given_y, threshold)


def _decided(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, given_x: np.ndarray, given_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    near = np.flatnonzero(np.abs(cosine - threshold) <= SLACK)
    if len(near):
        a, b = given_x[i[near]], given_y[j[near]]
        cosine = cosine.copy()
        cosine[near] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    return i[cosine >= threshold], j[cosine >= threshold]


def tiles(groups: DataFrame, directions: Broadcast, number: np.dtype) -> DataFrame:
    """One row for each TILE vectors, or fewer, of a label and length, in the order of the leading coordinate.

    A label's vectors fall into up to RANGES quantile ranges, and those of a very large label
    into equal steps of a range, which are sorted and cut on their own: no label is one task's burden.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    sizes = groups.groupBy("label", "width").agg(F.count("*").alias("n"), F.percentile_approx("lead", shares, 10_000).alias("cuts"))
    rows = groups.join(sizes, ["label", "width"])
    quantile = F.size(F.filter("cuts", lambda c: c <= F.col("lead")))
    edges = F.concat(F.array(F.lit(-1.0)), F.col("cuts"), F.array(F.lit(1.0)))
    lo, hi = F.element_at(edges, F.col("quantile") + 1), F.element_at(edges, F.col("quantile") + 2)
    steps = F.ceil(F.col("n") / (8 * RANGES * TILE))
    step = F.floor((F.col("lead") - lo) / F.greatest(hi - lo, F.lit(1e-12)) * steps)
    n_ranges = F.least(F.lit(RANGES), F.ceil(F.col("n") / TILE))
    rows = rows.withColumn("quantile", quantile)
    rows = rows.withColumns({"step": F.least(F.greatest(step, F.lit(0)), steps - 1), "range": F.floor(F.col("quantile") * n_ranges / RANGES)}).drop("cuts", "n", "quantile")
    order = Window.partitionBy("label", "width", "range", "step").orderBy("lead", "rep")
    rows = rows.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        given = b"".join(group["given"])
        turned = _unit(np.frombuffer(given, number).reshape(len(group), -1).astype(np.float64)) @ _axes(directions.value, int(group["width"].iloc[0]))
        head = turned[:, :BOX]
        rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(axis=1)))
        own = group.iloc[:1][["label", "width", "range", "step", "tile"]].reset_index(drop=True)
        blobs = {"reps": group["rep"].to_numpy(np.int64).tobytes(), "weights": group["weight"].to_numpy(np.int64).tobytes(), "given": given}
        return own.assign(low=[head.min(axis=0).tolist()], high=[head.max(axis=0).tolist()], rest_low=rest.min(), rest_high=rest.max(), **{k: [v] for k, v in blobs.items()})

    kind = rows.schema["label"].dataType.simpleString()
    schema = f"label {kind}, width int, range long, step long, tile long, low array<double>, high array<double>, rest_low double, rest_high double, reps binary, weights binary, given binary"
    out = rows.groupBy("label", "width", "range", "step", "tile").applyInPandas(packed, schema)
    return out.withColumn("tile_id", F.struct("label", "width", "range", "step", "tile"))


def near_tiles(made: DataFrame, threshold: float) -> DataFrame:
    """(a, b): tiles of a label whose boxes may hold a pair with the wanted cosine, each pair once.

    |x - y|**2 = 2 - 2 * cosine, and the boxes bound the left side from below.
    """
    reach = (2 - 2 * threshold) ** 0.5 + 1e-4
    boxes = made.select("tile_id", "label", "width", "low", "high", "rest_low", "rest_high")
    cell = lambda x: F.floor(x / reach)
    a = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))))
    b = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("low")[0] - reach), cell(F.col("high")[0] + reach))))
    a, b = (x.select("label", "width", "cell", F.struct(*[c for c in x.columns if c not in ("label", "width", "cell")]).alias(n)) for x, n in ((a, "a"), (b, "b")))
    gaps = F.zip_with(F.zip_with("a.low", "b.high", lambda l, h: l - h), F.zip_with("b.low", "a.high", lambda l, h: l - h), lambda g, h: F.greatest(g, h, F.lit(0.0)))
    rest = F.greatest(F.col("a.rest_low") - F.col("b.rest_high"), F.col("b.rest_low") - F.col("a.rest_high"), F.lit(0.0))
    apart = F.aggregate(gaps, rest * rest, lambda total, g: total + g * g)
    pairs = a.join(b, ["label", "width", "cell"]).where((F.col("a.tile_id") <= F.col("b.tile_id")) & (apart <= reach * reach))
    return pairs.select(F.col("a.tile_id").alias("a"), F.col("b.tile_id").alias("b")).distinct()


def _axes(directions: np.ndarray, width: int) -> np.ndarray:
    """The directions for vectors of a width that were filled up with zeros."""
    return directions[:width]


def compared(made: DataFrame, directions: Broadcast, number: np.dtype, threshold: float = THRESHOLD) -> DataFrame:
    """(id, weight, to): the weight that a vector links to in one comparison, and links of a spanning forest (weight 0).

    Only the vectors as given travel; they are turned where they are compared.
    """
    blobs = lambda end: made.select(F.col("tile_id").alias(end), F.struct("width", "reps", "weights", "given").alias(f"tile_{end}"))
    pairs = near_tiles(made, threshold).join(blobs("a"), "a").join(blobs("b"), "b")
    pairs = pairs.select((F.col("a") == F.col("b")).alias("same"), "tile_a", "tile_b")

    def unpacked(tile: dict) -> tuple[np.ndarray, ...]:
        reps, weights = np.frombuffer(tile["reps"], np.int64), np.frombuffer(tile["weights"], np.int64)
        given = np.frombuffer(tile["given"], number).reshape(len(reps), -1).astype(np.float64)
        return reps, weights, (_unit(given) @ _axes(directions.value, tile["width"])).astype(np.float32), given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, tile_a, tile_b = (batch.column(c)[row].as_py() for c in range(3))
                (reps_a, weights_a, x, given_x), (reps_b, weights_b, y, given_y) = unpacked(tile_a), unpacked(tile_b)
                i, j = close_pairs(x, y, given_x, given_y, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                to_a, to_b = np.bincount(i, weights_b[j], len(reps_a)), np.bincount(j, weights_a[i], len(reps_b))
                a, b = np.flatnonzero(to_a), np.flatnonzero(to_b)
                child, root = forest(reps_a[i], reps_b[j])
                ids = np.concatenate([reps_a[a], reps_b[b], child])
                weights = np.concatenate([to_a[a], to_b[b], np.zeros(len(child))]).astype(np.int64)
                to = pa.concat_arrays([pa.nulls(len(a) + len(b), pa.int64()), pa.array(root, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(weights), to], ["id", "weight", "to"])

    return pairs.mapInArrow(run, "id long, weight long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    small_batches(vectors.sparkSession)
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = usable(vectors)
    groups = rows.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min_by("values", "vec_id").alias("values"))
    groups = written(groups.select("same", "same.label", "rep", "weight", F.size("values").alias("width"), "values"), "vector-groups")
    n_rows, width = groups.agg(F.sum("weight"), F.max("width")).first()
    directions = vectors.sparkSession.sparkContext.broadcast(basis(groups, width or 1))  # dimension squared
    number = _number(groups)
    made = written(tiles(_led(groups.select("label", "rep", "weight", "width", "values"), directions), directions, number), "tiles")
    found = written(compared(made, directions, number, threshold), "vector-links")
    linked = found.groupBy("id").agg(F.sum("weight").alias("linked"))
    joined = components(found.where("to is not null"), "id", "to")
    own = groups.select("same", "rep", "weight").join(linked, F.col("rep") == F.col("id"), "left").drop("id").join(joined, F.col("rep") == F.col("id"), "left")
    own = own.select("same", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    hot = hot_keys(groups, "same", "weight", n_rows or 0)
    linked_rows = spread_join(rows.select("vec_id", "same"), own, "same", hot, ["vec_id"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
