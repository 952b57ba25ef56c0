"""Connected components of a table of links, by alternating large-star and small-star rounds.

Both operations are one grouping and a join back each; the number of rounds grows with the
logarithm of a component's size. The links of a node that holds many of them are dealt to
several tasks for the join. Every round is written to the shared folder, so a lost executor costs
one round at most. Links never reach the driver: only whether they are flat does, and the ids of
nodes that hold more than one in 256 of all links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barkeep.llm._util import hot_keys, spread_join, written


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with the smallest neighbour of a, from the cached least(a, least, n)."""
    hot = hot_keys(least, "a", "n", least.agg(F.sum("n")).first()[0] or 0)
    return spread_join(links, least.drop("n"), "a", hot, ["b"])


def _large_star(links: DataFrame, cached: list[DataFrame]) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it, itself included."""
    around = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cached.append(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count("*").alias("n")).persist())
    out = _with_least(around, cached[-1]).where("b > a")
    return out.select(F.greatest("b", "least").alias("a"), F.least("b", "least").alias("b")).where("a <> b")


def _small_star(links: DataFrame, cached: list[DataFrame]) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these."""
    cached.append(links.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).persist())
    out = _with_least(links, cached[-1]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.union(cached[-1].select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def _is_flat(links: DataFrame) -> bool:
    """Whether every node with a link down has one only, and it leads to a node without any."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every node that has a link; component_id is the smallest id reachable.

    Links of a node to itself and null ends are ignored; without links there are no rows.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b")
    now = written(now.distinct(), "links")
    while not _is_flat(now):
        cached: list[DataFrame] = []
        cached.append(_large_star(now, cached).persist())
        now = written(_small_star(cached[-1], cached), "links")
        for df in cached:
            df.unpersist()
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component, for links a[k]-b[k]."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
