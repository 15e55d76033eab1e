"""Embedding near-dedup by collision-counting projections.

Unit vectors within the wanted cosine differ by a known distance at most, so
their values on a random line differ by a normal deviate of that scale.  A
window of WIDTH of its standard deviations around a query's value therefore
holds its neighbours with known probability on every line.

In a shard, members are sorted along one line, each query's window there gives
its candidates, collisions are counted on the other lines, and pairs that reach
the calibrated count are verified by their cosine.

Where there are more vectors than a shard holds, several trees deal them: each
cuts the sorted values of one line per level where few lie, grown on a bounded
sample, and does not cut through dense groups.  A pair at the threshold may be
parted in one tree, so there are as many trees as the wanted recall needs,
measured on pairs made from the sample.  A vector is in one shard per tree, and
their number grows with about the sixth root of the table.  (One tree that sends
vectors near a cut to both sides needs far more copies: half of all values lie
within a window of a cut.)

A pair is counted in the first tree that holds it together.  Shards return
counts and links to the smallest member of each component, not pairs.  Equal
vectors are one class from the start; vectors of each length are compared among
themselves.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .arrow import arrow_map
from .components import Union, components
from .scratch import Scratch, sampled, table

#: Half a window, in standard deviations of a pair at the threshold.
WIDTH = 2.6
#: Lines on which collisions are counted.
LINES = 16
#: The share of pairs at the threshold that shards are to hold; closer pairs are held more often.
RECALL = 0.98
#: Vectors that the trees of one vector length are grown on at most, and numbers in all of them.
SAMPLE, SAMPLE_VALUES = 100_000, 16_000_000
#: The share of a node's vectors that may lie near its cut.
MOST_NEAR = 0.25
MOST_TREES = 64
#: Vectors of a shard, and of a block of a crowded one, of which two meet in a task.
SHARD_ROWS = 2_000
MAX_SHARDS = 65_536
#: Pairs of a block that are looked at together, and vectors that are verified at a time.
BLOCK, CHUNK, VERIFIED = 128, 4_096, 8_192


def counting_lines(dimension: int, seed: int) -> np.ndarray:
    """Random directions that count collisions."""
    return np.random.default_rng([seed, dimension]).standard_normal((LINES, dimension))


def most_misses(recall: float = 0.9995) -> int:
    """Lines out of LINES that a pair at the threshold may miss and still be verified."""
    miss = math.erfc(WIDTH / math.sqrt(2))
    reached = 0.0
    for misses in range(LINES + 1):
        reached += math.comb(LINES, misses) * miss**misses * (1 - miss) ** (LINES - misses)
        if reached >= recall:
            return misses
    return LINES


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


class Tree:
    """Shards of the unit vectors of one length: each node cuts its level's line where few vectors lie."""

    def __init__(self, sample: np.ndarray, lines: np.ndarray, least: int, reach: float):
        """Grown on ``sample``: leaves hold about ``least`` of it; ``reach`` is how far pairs lie apart on a line."""
        self.lines = lines
        values = sample @ lines.T
        nodes: list[list] = []  # cut, left, right; a leaf is -1 - its number
        sizes: list[int] = []
        todo = [(np.arange(len(sample)), 0, None)]
        while todo:
            own, level, where = todo.pop()
            cut = quiet_cut(values[own, level], reach) if len(own) > 1.5 * least and level < len(lines) else None
            if cut is None:
                number = -1 - len(sizes)
                sizes.append(len(own))
            else:
                number = len(nodes)
                nodes.append([cut, 0, 0])
                left = values[own, level] <= cut
                todo += [(own[left], level + 1, (number, 1)), (own[~left], level + 1, (number, 2))]
            if where:
                nodes[where[0]][where[1]] = number
        self.cut = np.array([n[0] for n in nodes])
        self.child = np.array([n[1:] for n in nodes], np.int64).reshape(-1, 2)
        self.share = np.array(sizes) / max(1, len(sample))

    def leaves(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.full(len(units), 0 if len(self.cut) else -1)
        for line in self.lines:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                break
            x = units[inner] @ line
            node[inner] = self.child[node[inner], (x > self.cut[node[inner]]).astype(np.int64)]
        return -1 - node


def quiet_cut(values: np.ndarray, reach: float) -> float | None:
    """Where few values lie within ``reach`` either way, not far from the middle; None if a cut would part a dense group."""
    ordered = np.sort(values)
    n = len(ordered)
    for low, high in ((0.3, 0.7), (0.05, 0.95)):
        at = np.unique((np.linspace(low, high, 41) * (n - 1)).astype(np.int64))
        cuts = (ordered[at] + ordered[np.minimum(at + 1, n - 1)]) / 2
        near = np.searchsorted(ordered, cuts + reach) - np.searchsorted(ordered, cuts - reach)
        near = np.where((cuts < ordered[0]) | (cuts >= ordered[-1]), n, near)
        best = int(np.lexsort((np.abs(at - n / 2), near))[0])
        if near[best] <= MOST_NEAR * n:
            return float(cuts[best])
    return None


def shard_pairs(units: np.ndarray, queries: np.ndarray, members: np.ndarray, directions: np.ndarray, window: float, cosine: float):
    """Yield (query row, member row) of pairs with at least ``cosine``; all rows index ``units``."""
    allowed = most_misses()
    values = (units @ directions.T).astype(np.float32)
    order = members[np.argsort(values[members, 0], kind="stable")]
    placed = np.ascontiguousarray(values[order].T)  # lines x members, along the first line
    asked = queries[np.argsort(values[queries, 0], kind="stable")]
    own = np.ascontiguousarray(values[asked].T)
    width = np.float32(window)
    for first in range(0, len(asked), BLOCK):
        block = np.arange(first, min(first + BLOCK, len(asked)))
        low = np.searchsorted(placed[0], own[0, block[0]] - width, side="left")
        high = np.searchsorted(placed[0], own[0, block[-1]] + width, side="right")
        for start in range(low, high, CHUNK):
            stop = min(high, start + CHUNK)
            misses = np.zeros((len(block), stop - start), np.uint8)
            for line in range(5):
                misses += np.abs(own[line, block][:, None] - placed[line, start:stop][None, :]) > width
            q, m = np.nonzero(misses <= allowed)
            missed, q, m = misses[q, m], block[q], m + start
            for line in range(5, LINES):
                missed = missed + (np.abs(own[line, q] - placed[line, m]) > width)
                kept = missed <= allowed
                missed, q, m = missed[kept], q[kept], m[kept]
            q, m = asked[q], order[m]
            kept = q != m
            q, m = q[kept], m[kept]
            if len(q) > VERIFIED:  # dense: all products of the block at once
                rows, columns = np.unique(q), np.unique(m)
                near = (units[rows] @ units[columns].T)[np.searchsorted(rows, q), np.searchsorted(columns, m)] >= cosine
            else:
                near = np.einsum("ij,ij->i", units[q], units[m]) >= cosine
            if near.any():
                yield q[near], m[near]


class Dealer:
    """Deals the unit vectors of one length to shards, one in each of its trees."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, seed: int):
        shards = min(MAX_SHARDS, -(-rows // SHARD_ROWS))
        self.trees: list[Tree] = []
        self.blocks = [_blocks(np.ones(1), rows)]
        if shards < 2:
            return
        draw = np.random.default_rng([seed + 1, sample.shape[1]])
        levels, reach = 2 * math.ceil(math.log2(shards)) + 2, math.sqrt(max(0.0, 2 - 2 * cosine)) / 2
        # Vectors at the threshold from some of the sample tell how many pairs the trees hold.
        one = sample[: min(len(sample), 4_000)]
        aside = draw.standard_normal(one.shape)
        aside = aside - (aside * one).sum(1, keepdims=True) * one
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        other = cosine * one + math.sqrt(max(0.0, 1 - cosine**2)) * aside / np.where(length > 0, length, 1)
        met = np.zeros(len(one), bool)
        while met.mean() < RECALL and len(self.trees) < MOST_TREES:
            tree = Tree(sample, draw.standard_normal((levels, sample.shape[1])), max(1, len(sample) // shards), reach)
            met |= tree.leaves(one) == tree.leaves(other)
            self.trees.append(tree)
        if met.mean() < RECALL:  # no trees hold enough: all are one shard, of which every block meets every other
            self.trees = []
        else:
            self.blocks = [_blocks(t.share, rows) for t in self.trees]

    def leaves(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: rows x trees."""
        return np.stack([t.leaves(units) for t in self.trees], 1)


def _blocks(share: np.ndarray, rows: int) -> np.ndarray:
    """Blocks of shards that hold so much of all rows, as the sample has it.  Two blocks, or one and itself, meet in a task."""
    return np.clip(np.ceil(share * rows / SHARD_ROWS), 1, 1 << _PART_BITS - 1).astype(np.int64)


#: Numbers a block within its shard, two of which name a task, and a shard within its tree.
_PART_BITS, _LEAF_BITS = 16, 24
_BLOCK_BITS = 2 * _PART_BITS
_ROUTED = "dimension long, shard long, second boolean, leaves array<int>, e array<{0}>, rep long, n long"


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 29) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Links join rows whose cosine, in double precision, is at least ``cosine``.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing; those of different lengths do not link.  Rows that repeat are
    vectors of their own; those with a null vec_id count as links but name no
    component.  Empty tables give no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = "float" if vectors.select(F.element_at("embedding", 1).alias("x")).schema["x"].dataType == FloatType() else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    valid = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, e).alias("e"))
    rows = rows.withColumn("h", F.when(F.col("e").isNotNull(), F.xxhash64("e"))).withColumn("g", F.hash("e"))
    classes = rows.filter("e is not null").groupBy("h", "g", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.write(classes.filter("rep is not null").withColumn("dimension", F.size("e").cast("long")), "classes")
    total = classes.count()
    window = WIDTH * math.sqrt(max(0.0, 2 - 2 * cosine))
    dealers: dict[int, Dealer] = {}
    # Lengths of which there is more than a shard; few, as each has so many vectors.
    for dimension, n in classes.groupBy("dimension").count().filter(F.col("count") > SHARD_ROWS).collect():
        own = classes.filter(F.col("dimension") == dimension).select("e", "h")
        drawn = sampled(own, F.xxhash64("h", F.lit(seed)), min(SAMPLE, SAMPLE_VALUES // dimension, 64 * -(-n // SHARD_ROWS)), n).select("e").toArrow()
        drawn = drawn.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dimension)
        dealers[dimension] = Dealer(unit(drawn), n, cosine, seed)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(dealers))  # by value: executors have no copy of this package

    def router():
        dealers = pickle.loads(sent.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dimensions = batch.column("dimension").to_numpy()
            out = []
            for dimension in np.unique(dimensions).tolist():
                own = batch.take(pa.array(np.flatnonzero(dimensions == dimension)))
                dealer, n = dealers.get(dimension), own.num_rows
                trees = dealer.trees if dealer else []
                leaves = dealer.leaves(unit(own.column("e").flatten().to_numpy().reshape(n, dimension))) if trees else np.zeros((n, 0), np.int64)
                hashes = own.column("h").to_numpy()
                for tree in range(max(1, len(trees))):
                    leaf = leaves[:, tree] if trees else np.zeros(n, np.int64)
                    blocks = dealer.blocks[tree][leaf] if dealer else np.ones(n, np.int64)
                    row = np.repeat(np.arange(n), blocks)  # once with each block of its shard
                    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    block = hashes[row] % blocks[row]
                    task = (np.minimum(block, other) << _PART_BITS) + np.maximum(block, other)
                    shard = ((tree + bool(trees) << _LEAF_BITS) + leaf[row] << _BLOCK_BITS) + task
                    out.append(_routed(own, row, shard, block > other, leaves[row]))
            return pa.concat_batches(out)

        return each

    def counted(shard: pa.Table) -> pa.Table:
        dimension, number = shard.column("dimension")[0].as_py(), shard.column("shard")[0].as_py()
        tree = max(0, (number >> _BLOCK_BITS + _LEAF_BITS) - 1)
        reps = shard.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        shard = shard.take(pa.array(order))
        reps, n, second = reps[order], shard.column("n").to_numpy(), shard.column("second").to_numpy(zero_copy_only=False)
        units = unit(shard.column("e").combine_chunks().flatten().to_numpy().reshape(-1, dimension))
        leaves = shard.column("leaves").combine_chunks().flatten().to_numpy().reshape(len(reps), -1)[:, :tree]
        links, sets = np.zeros(len(reps), np.int64), Union(len(reps))
        one = number >> _PART_BITS & (1 << _PART_BITS) - 1 == number & (1 << _PART_BITS) - 1
        queries = np.flatnonzero(~second)
        members = queries if one else np.flatnonzero(second)
        for q, m in shard_pairs(units, queries, members, counting_lines(dimension, seed), window, cosine):
            new = ~(leaves[q] == leaves[m]).any(1)  # earlier trees count the others
            q, m = q[new], m[new]
            np.add.at(links, q, n[m])
            if not one:  # within a block each is the other's query
                np.add.at(links, m, n[q])
            sets.unite(q, m)
        roots = sets.roots()
        told = np.flatnonzero((links > 0) | (roots != np.arange(len(roots))))
        return pa.table({"rep": reps[told], "links": links[told], "root": reps[roots[told]]})

    routed = arrow_map(classes, router, _ROUTED.format(kind))
    found = scratch.write(routed.groupBy("dimension", "shard").applyInArrow(counted, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = components(found.filter("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    known = (
        classes.select("h", "g", "rep", "n")
        .join(links, "rep", "left")
        .join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    known = scratch.write(known, "known", total)
    scratch.keep("known")
    joined = rows.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _routed(own: pa.RecordBatch, row: np.ndarray, shard: np.ndarray, second: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
    """Rows of ``own``, each for a shard."""
    sent = own.take(pa.array(row))
    ends = np.arange(len(row) + 1, dtype=np.int32) * leaves.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves.ravel().astype(np.int32)))
    names = ["dimension", "shard", "second", "leaves", "e", "rep", "n"]
    return pa.record_batch([sent.column("dimension"), pa.array(shard), pa.array(second), lists, *(sent.column(c) for c in ("e", "rep", "n"))], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all rows of ``embeddings``, whatever their labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs and their closure: for small tables only.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS c FROM embeddings UNION SELECT l.u, r.c FROM l JOIN r ON l.w = r.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT r.u AS vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(r.c) AS component_id, r.u = min(r.c) AS kept
FROM r LEFT JOIN n ON n.u = r.u GROUP BY r.u
"""
