"""Vector codes against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from barkeep.llm import vector_codes as vc


@pytest.mark.parametrize("seed", range(12))
def test_two_trees_find_the_nearest(seed):
    """Small whole numbers, so distances often tie; repeated parts and entries; leaves of one part and more."""
    rnd = np.random.default_rng(seed)
    n, m, width, top = rnd.integers(1, 400), rnd.integers(1, 60), rnd.integers(1, 6), rnd.choice([1, 3, 50, 1 << 26])
    points, entries = rnd.integers(-top, top + 1, (n, width)), rnd.integers(-top, top + 1, (m, width))
    points[: n // 3] = points[0]
    order, number = vc.tree_order(points, vc.LEAF), vc.tree_order(entries, 1)
    tree = vc.Tree(points[order], vc.LEAF)
    starts, ends, code = vc.assign(tree, vc.Tree(entries[number], 1), number)
    found = np.full(n, -1)
    for s, e, c in zip(starts, ends, code, strict=True):
        assert (found[s:e] == -1).all()
        found[s:e] = c
    wanted = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (found == wanted).all()
    assert (np.add.reduce(tree.totals[ends] - tree.totals[starts]) == points.sum(axis=0)).all()


def brute(rows):
    """{position in rows: (code, error, label_error)} and the digest of the codebooks; of the rows that hold a vector of the first one's length."""
    good = [(r[0] is None, r[0] or 0, r[1], i) for i, r in enumerate(rows) if r[1] and len(r[1]) % 4 == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda g: (g[0], g[1], g[2]))
    good = [g for g in good if len(g[2]) == len(good[0][2])]
    x = np.floor(np.array([g[2] for g in good], np.float32).astype(float) * 1024).astype(np.int64).reshape(len(good), 4, -1)
    books = x[:256].copy()
    for last in [False] * 4 + [True]:
        apart = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        code = apart.argmin(axis=1)
        if not last:
            for k in range(4):
                for e in np.unique(code[:, k]):
                    own = x[code[:, k] == e, k]
                    books[e, k] = own.sum(axis=0) // len(own)
    errors = np.take_along_axis(apart, code[:, None], 1).sum(axis=(1, 2))
    by_label = defaultdict(int)
    for g, e in zip(good, errors):
        by_label[rows[g[3]][2]] += int(e)
    text = ",".join(map(str, books.transpose(1, 0, 2).ravel().tolist()))
    return [(rows[g[3]][0], bytes(c.astype(np.uint8)).hex(), int(e), by_label[rows[g[3]][2]]) for g, c, e in zip(good, code, errors)], hashlib.sha256(text.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


def check(df, rows):
    wanted, digest = brute(rows)
    found = df.collect()
    assert {r.codebooks_sha256 for r in found} == {digest}
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=str) == sorted(wanted, key=str)


def vectors(n, width, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(9, width))
    rows = [(int(i), (centres[i % 9] + rnd.normal(size=width) * rnd.choice([0.01, 0.3])).astype(np.float32).tolist(), int(i % 5)) for i in rnd.permutation(n)]
    return [(i, rows[0][1] if i % 3 == 0 else v, None if label == 4 else label) for i, v, label in rows]


def test_codes(spark):
    """A third of the vectors are equal and a fifth has no label; odd vectors go."""
    rows = vectors(900, 16)
    odd = [(1001, None, 1), (1002, [], 1), (1003, [None] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] + [0.0] * 15, 1), (1006, [0.5] * 12, 1), (1007, [0.5] * 15, 1)]
    ties = [(1010, [0.0] * 16, 1), (1011, [0.0] * 16, None), (None, rows[5][1], 2), rows[7], rows[7]]
    check(vc.codes(spark.createDataFrame(rows + odd + ties, VECTORS).repartition(5)), rows + odd + ties)


def test_few_and_none(spark):
    rows = vectors(7, 4)
    frame = spark.createDataFrame(rows, VECTORS)
    check(vc.codes(frame), rows)
    clash = frame.selectExpr("vec_id AS ids", "embedding AS parts", "label AS key", "1 AS code", "2 AS n")
    check(vc.codes(clash, "ids", "parts", "key"), rows)
    for none in (frame.limit(0), frame.selectExpr("vec_id", "cast(null AS array<float>) AS embedding", "label")):
        out = vc.codes(none)
        assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
