"""Connected components: in numpy within a task, by star operations across tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


class Union:
    """Disjoint sets of 0..n-1, united by arrays of pairs; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def unite(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.find(u), self.find(v)
            self.parent[u], self.parent[v] = np.minimum(self.parent[u], a), np.minimum(self.parent[v], b)
            apart = a != b
            u, v = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, v, u)

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) reduced to (node, smallest node reachable), one per other node."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    sets = Union(len(nodes))
    sets.unite(index[: len(u)], index[len(u) :])
    roots = sets.roots()
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


#: Rounds take the logarithm of the number of nodes; more than these mean an error.
MOST_ROUNDS = 60
#: Links that a task reduces at a time.
TASK_LINKS = 2_000_000


def contract(links: DataFrame) -> DataFrame:
    """The same components by at most one link per node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u = np.concatenate([u, batch.column(0).to_numpy()])
            v = np.concatenate([v, batch.column(1).to_numpy()])
            if len(u) > TASK_LINKS:
                u, v = forest(u, v)
                if len(u) > TASK_LINKS // 2:  # nearly all are needed: pass them on
                    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])
                    u, v = u[:0], v[:0]
        u, v = forest(u, v)
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v: distinct longs).

    ``component`` is the smallest node reachable.  Alternates two steps until
    nothing changes, in about log(n) rounds: every node points its larger
    neighbours to the smallest of its neighbourhood, then its smaller ones.
    Minima are combined before they shuffle, and the joins that follow may be
    split, so a hub costs no more than its links.
    """
    now = scratch.write(contract(links), "links-0")
    size = 2 * now.count()
    mark = None
    for turn in range(1, MOST_ROUNDS + 1):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct(), f"large-{turn}", size)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.write(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), f"links-{turn}", size)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"large-{turn}")
        scratch.drop(f"links-{turn - 1}")
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"links have not settled after {MOST_ROUNDS} rounds")
    # A fixed point is a star around every smallest node.
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionAll(hubs)
