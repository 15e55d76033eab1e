"""SimHash near-dedup with vantage-point trees over Hamming distance.

Fingerprints within ``near`` of 64 bits differ by near // parts bits at most in
one of ``parts`` equal parts: by one bit at most in one half for a distance of
3.  Each part has a vantage-point tree whose query radius is that number: a
node holds a vantage point and a radius, points within it go inside, others
outside.  By the triangle inequality a pair across the boundary has its outer
point within the query radius of it; such boundary points visit the inside as
well, and every other branch is pruned.  (With the whole 64 bits and radius 3,
three in five points would visit both sides at every level.)

The tree's upper part is grown on a bounded sample and broadcast; its leaves
are the shards.  A shard splits further by trees of its own and compares what
is left exactly, on all 64 bits.  It returns a spanning forest of its links, so
a dense group gives one link per member.

``near_duplicates`` links fingerprints.  ``similar_documents`` uses wider
distances to find candidates, and links those whose word shingles agree; what
fingerprints miss is found by the shingles that texts share.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map
from .components import Union, components
from .identity import documents
from .overlap import overlapping
from .scratch import Scratch, sampled, small, table, temporary, without

SEED = 42
#: Bits in which linked fingerprints differ at most.
NEAR = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints, of one half, that the shard trees are grown on at most.
SAMPLE = 500_000
#: Fingerprints of a shard while there are no more than FEW_SHARDS; beyond, they grow to MOST_ROWS first.
#: Each level of a shard tree makes copies of boundary points, which are shuffled; those that a task's own trees make are not.
SHARD_ROWS, FEW_SHARDS, MOST_ROWS = 4096, 64, 65_536
MAX_SHARDS = 32_768
#: Times the mean from which a shard is cut by other bits as well.
CROWDED = 8
#: Fingerprints that are compared without further splits, and those that a task cuts by other bits where no radius splits them.
LEAF, CUT = 384, 4096


def shingle_hashes(text: bytes, words_in_shingle: int) -> np.ndarray:
    """XXH64 of each lower-cased word shingle, repeats included; a shorter text is one shingle."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_in_shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; 0 without any."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # the bits of very long texts in parts
        part = hashes[at : at + 65_536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words_in_shingle: int = 3) -> int:
    return majority(shingle_hashes(text, words_in_shingle))


def remixed(hashes: np.ndarray, signature: int) -> np.ndarray:
    """Hashes for a further, independent fingerprint of the same shingles."""
    if not signature:
        return hashes
    out = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * signature)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _signer(words_in_shingle: int, signatures: int):
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", words_in_shingle)
                prints += [majority(remixed(hashes, s)) for s in range(signatures)]
            n = batch.num_rows
            row = np.repeat(np.arange(n), signatures)
            arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(np.tile(np.arange(signatures), n)), pa.array(np.array(prints, np.uint64).view(np.int64))]
            return pa.record_batch(arrays, names=["doc_id", "signature", "print"])

        return each

    return make


def sign(docs: DataFrame, words_in_shingle: int = 3, signatures: int = 1) -> DataFrame:
    """doc_id, signature and print, the fingerprint as a signed long; ``signatures`` per row."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(light, _signer(words_in_shingle, signatures), "doc_id long, signature long, print long", "text")


def part_of(prints: np.ndarray, part: int, parts: int) -> np.ndarray:
    """One of ``parts`` equal parts of the bits."""
    width = 64 // parts
    return (prints.view(np.uint64) >> np.uint64(part * width) & np.uint64((1 << width) - 1)).astype(np.uint32)


def split(values: np.ndarray, reach: int) -> tuple[np.uint32, int] | None:
    """A vantage point and radius that halve ``values``; None if none would."""
    spread = [values[0], values[len(values) // 2], values[-1], ~values[0]]
    best = None
    for vantage in spread:
        distance = np.bitwise_count(values ^ vantage)
        inside = np.cumsum(np.bincount(distance, minlength=33 + reach))
        # The larger side, its visitors included, for every radius.
        cost = np.maximum(inside[reach : 32 + reach], len(values) - inside[:32])
        radius = int(cost.argmin())
        if best is None or cost[radius] < best[0]:
            best = (cost[radius], vantage, radius)
    return best[1:] if best[0] < 0.95 * len(values) else None


def grow(values: np.ndarray, leaves: int, reach: int = 1) -> list[tuple[int, int, int, int]]:
    """A shard tree with about ``leaves`` leaves: nodes (vantage, radius, inside, outside).

    Children are node numbers, or -1 - shard.  The sample's largest leaf is split first.
    """
    import heapq

    nodes: list[list[int]] = []
    heap = [(-len(values), 0, values, None)]
    done, serial = [], 1
    while heap:
        _, _, own, where = heapq.heappop(heap)
        found = split(own, reach) if len(heap) + len(done) + 1 < leaves and len(own) >= 8 else None
        if found is None:
            done.append(where)
            continue
        vantage, radius = found
        distance = np.bitwise_count(own ^ vantage)
        if where:
            nodes[where[0]][where[1]] = len(nodes)
        for side, part in ((2, own[distance <= radius + reach]), (3, own[distance > radius])):
            heapq.heappush(heap, (-len(part), serial, part, (len(nodes), side)))
            serial += 1
        nodes.append([int(vantage), radius, 0, 0])
    for shard, where in enumerate(done):
        if where:
            nodes[where[0]][where[1]] = -1 - shard
    return [tuple(n) for n in nodes]


def route(values: np.ndarray, tree: list[tuple[int, int, int, int]], reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) pairs: each value's own shard, and those its boundary visits reach."""
    if not tree:
        return np.arange(len(values)), np.zeros(len(values), np.int64)
    rows, shards, todo = [], [], [(0, np.arange(len(values)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            rows.append(own)
            shards.append(np.full(len(own), -1 - node))
            continue
        vantage, radius, inside, outside = tree[node]
        distance = np.bitwise_count(values[own] ^ np.uint32(vantage))
        todo += [(inside, own[distance <= radius + reach]), (outside, own[distance > radius])]
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, int), np.zeros(0, int))


def spanning(u: np.ndarray, v: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which links (u < v) form a spanning forest of least distances."""
    nodes, named = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = named[: len(u)], named[len(u) :]
    sets, chosen = Union(len(nodes)), []
    for step in np.unique(distance):
        left = np.flatnonzero(distance == step)
        while len(left):
            a, b = sets.find(u[left]), sets.find(v[left])
            apart = a != b
            left, low, high = left[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            # Each component takes one link to a component with a smaller root: no cycles.
            _, first = np.unique(high, return_index=True)
            chosen.append(left[first])
            sets.unite(low[first], high[first])
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def shard_count(n: int) -> int:
    """Shards for ``n`` fingerprints of one signature."""
    return int(min(MAX_SHARDS, max(1, min(n // SHARD_ROWS, FEW_SHARDS), n // MOST_ROWS)))


def is_crowded(filled: np.ndarray, n: int, shards: int) -> np.ndarray:
    """Which shards hold too many of ``n`` fingerprints, by how many each is filled with."""
    return filled > CROWDED * max(SHARD_ROWS, n / shards)


def shard_links(prints: np.ndarray, part: int, parts: int, near: int, forests: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``forests`` spanning forests without common links, by least distances, of the links among one shard's prints."""
    values, wide, reach = part_of(prints, part, parts), prints.view(np.uint64), near // parts
    n, held, size = len(prints), [np.zeros((3, 0), np.int64)], 0

    def reduced(links: np.ndarray) -> np.ndarray:
        links = np.unique(links, axis=1)  # trees meet a pair in several leaves
        kept = []
        for _ in range(forests):
            own = spanning(*links)
            kept.append(links[:, own])
            links = np.delete(links, own, axis=1)
        return np.concatenate(kept, 1)

    todo, final = [np.arange(n)], [False]
    while todo:
        own, cut = todo.pop(), final.pop()
        found = split(values[own], reach) if len(own) > LEAF and not cut else None
        if found:
            distance = np.bitwise_count(values[own] ^ found[0])
            todo += [own[distance <= found[1] + reach], own[distance > found[1]]]
            final += [False, False]
            continue
        if len(own) > CUT and not cut:
            for name in pieces(prints[own], part, parts, near):
                order = np.argsort(name, kind="stable")
                groups = np.split(own[order], np.flatnonzero(np.diff(name[order])) + 1)
                todo += [g for g in groups if len(g) > 1]
            final += [True] * (len(todo) - len(final))
            continue
        for at in range(0, len(own), LEAF):  # the rows of a leaf in blocks, against the later ones
            block = own[at : at + LEAF]
            for to in range(at, len(own), 1024):
                later = own[to : to + 1024]
                distance = np.bitwise_count(wide[block][:, None] ^ wide[later][None, :])
                a, b = np.nonzero(distance <= near)
                links = np.stack([block[a], later[b], distance[a, b]]).astype(np.int64)
                links = links[:, links[0] != links[1]]
                links[:2].sort(axis=0)
                if links.shape[1]:
                    held.append(reduced(links) if links.shape[1] > LEAF else links)
                    size += held[-1].shape[1]
                if size > 4 * forests * n + 10_000:
                    held = [reduced(np.concatenate(held, 1))]
                    size = held[0].shape[1]
    u, v, _ = reduced(np.concatenate(held, 1))
    return u, v


#: Bits that number the parts of a crowded shard.
_PIECE_BITS = 20


def pieces(prints: np.ndarray, part: int, parts: int, near: int) -> np.ndarray:
    """(near + 1) x rows: parts of a crowded shard.

    The bits outside ``part`` are cut into near + 1 pieces, of which prints within
    ``near`` bits have one in common: it and its value name a part.
    """
    wide, width = prints.view(np.uint64), 64 // parts
    out, bits = [], [b for b in range(64) if b // width != part]
    for piece, own in enumerate(np.array_split(bits, near + 1)):
        value = np.zeros(len(wide), np.uint64)
        for k, bit in enumerate(own.tolist()):
            value |= (wide >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
        out.append(value.astype(np.int64) * (near + 1) + piece + 1)
    return np.stack(out)


def print_links(distinct: DataFrame, near: int, parts: int, scratch: Scratch, forests: int = 1) -> DataFrame:
    """(u, v): links among the distinct prints (signature, print, rep), by their reps.

    Prints of one signature within ``near`` bits are connected by these links,
    along paths of the least distances, and ``forests`` times over where they can be.
    """
    spark = distinct.sparkSession
    reach = near // parts
    n = distinct.filter("signature = 0").count()
    shards = shard_count(n)
    # A bounded sample of fingerprints grows the shard trees; all rows are routed by them.
    drawn = np.zeros(0, np.int64)
    if shards > 1:
        sample = sampled(distinct.filter("signature = 0").select("print"), F.xxhash64("print"), min(SAMPLE, 64 * shards), n)
        drawn = sample.toArrow().column(0).to_numpy()
    trees, crowded = [], []
    for p in range(parts):
        tree = grow(part_of(drawn, p, parts), shards, reach) if shards > 1 else []
        # Where no radius parts an eighth of all, or shards have grown too few, they are cut by other bits too.
        filled = np.bincount(route(part_of(drawn, p, parts), tree, reach)[1], minlength=1) * (n / max(1, len(drawn)))
        trees.append(tree)
        crowded.append(is_crowded(filled, n, shards))
    sent = spark.sparkContext.broadcast((trees, crowded))

    def router():
        trees, crowded = sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            prints, signature = batch.column("print").to_numpy(), batch.column("signature").to_numpy()
            for part in range(parts):
                row, shard = route(part_of(prints, part, parts), trees[part], reach)
                full = crowded[part][np.minimum(shard, len(crowded[part]) - 1)] if len(crowded[part]) else np.zeros(len(row), bool)
                named = ((shard * parts + part) * 16 + signature[row]) << _PIECE_BITS
                cut = (named[full] + pieces(prints[row[full]], part, parts, near)).ravel()
                row, named = np.concatenate([row[~full], np.tile(row[full], near + 1)]), np.concatenate([named[~full], cut])
                own = batch.take(pa.array(row))
                out.append(pa.record_batch([pa.array(named), own.column("print"), own.column("rep")], names=["shard", "print", "rep"]))
            return pa.concat_batches(out)

        return each

    def linked(shard: pa.Table) -> pa.Table:
        part = (shard.column("shard")[0].as_py() >> _PIECE_BITS) // 16 % parts
        reps = shard.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        u, v = shard_links(shard.column("print").to_numpy()[order], part, parts, near, forests)
        return pa.table({"u": reps[order][v], "v": reps[order][u]})

    routed = arrow_map(distinct, router, "shard long, print long, rep long")
    links = routed.groupBy("shard").applyInArrow(linked, "u long, v long").filter("u != v")
    return scratch.write(links, "links", 8 * forests * distinct.count())


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, its own included.
    Null texts count as empty; texts without words have fingerprint 0 and link
    like any others; a text of one or two words is one shingle.  Rows with a
    null doc_id name no component but get that of their fingerprint, if any.
    Rows that repeat get equal results; empty tables give no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    n = docs.count()
    rows = scratch.write(sign(docs, words_in_shingle), "rows", n, texts=True)
    distinct = rows.groupBy("signature", "print").agg(F.min("doc_id").alias("rep")).filter("rep is not null")
    distinct = scratch.write(distinct, "distinct", n)
    found = components(print_links(distinct, NEAR, 2, scratch), scratch).withColumnRenamed("node", "rep")
    classes = distinct.join(found, "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    classes = scratch.write(classes, "classes", n)
    scratch.keep("rows", "classes")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(classes, "print", "left").select("doc_id", hexed, "component_id")


#: Bits, parts and signatures of the candidate search for similar documents, and spanning forests of each.
#: A pair of similarity 0.8 is within 7 bits of one signature in two; six signatures miss one in forty.
WIDE, WIDE_PARTS, SIGNATURES, FORESTS = 7, 4, 6, 2
#: Documents with candidates that are named in a broadcast; more are joined by a shuffle.
SENT_IDS = 500_000


#: Distinct shingles of texts whose candidates are found exactly.
FEW = 14


def _shortener(words_in_shingle: int, least: float):
    """Keys of short texts: a hash for every part of the shingle set that a similar set may share with it.

    Similar sets share a part that lacks at most 1 - least of either.  Of all
    sets with a key the smallest is similar to each one that is similar to any
    other by that part, so pairs with it suffice.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = np.unique(shingle_hashes(text or b"", words_in_shingle))
                if len(own) > FEW:
                    continue
                for gone in range(int((1 - least) * len(own) + 1e-9) + 1):
                    for left in itertools.combinations(range(len(own)), len(own) - gone):
                        out.append((xxhash.xxh3_64_intdigest(own[list(left)].tobytes()), doc_id, len(own)))
            if not out:
                return None
            key, doc, n = zip(*out)
            return pa.record_batch([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(n, pa.int64())], names=["key", "doc_id", "n"])

        return each

    return make


def short_candidates(light: DataFrame, words_in_shingle: int, least: float, scratch: Scratch, n: int) -> DataFrame:
    """(u, v): each short text with the smallest of those that share a key; ``n`` rows."""
    keyed = scratch.write(arrow_map(light, _shortener(words_in_shingle, least), "key long, doc_id long, n long", "text"), "short", n, texts=True)
    heads = keyed.groupBy("key").agg(F.min(F.struct("n", "doc_id")).alias("head"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return keyed.join(heads, "key").select(F.col("doc_id").alias("u"), F.col("head.doc_id").alias("v"))


def _shingler(words_in_shingle: int):
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t or b"", words_in_shingle)).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            return pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "shingles"])

        return each

    return make


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones it is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _verifier(least: float):
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = batch.column("a"), batch.column("b")
            kept = [similarity(a[i].values.to_numpy(), b[i].values.to_numpy()) >= least for i in range(batch.num_rows)]
            return batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

        return each

    return make


#: Candidates of one document that meet its shingles in one task.
SALT_ROWS = 2_000


def verified(candidates: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of ``candidates`` (u, v) those whose shingle sets are similar.

    A document that many others have as their candidate meets them in several
    tasks, each with its shingles.
    """
    hot = candidates.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")).filter("salts > 1")
    hot = small(hot)
    salts = F.coalesce("salts", F.lit(1))
    left = candidates.join(hot, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), salts).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")).join(hot, "v", "left")
    right = right.select("v", "b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return arrow_map(left.join(right, ["v", "salt"]).select("u", "v", "a", "b"), _verifier(least), "u long, v long")


def similar_documents(docs: DataFrame, words_in_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents whose shingle sets are similar.

    First candidates are the spanning links, FORESTS times over, of fingerprints over
    three words within WIDE bits, for SIGNATURES fingerprints each, and documents
    with equal prints and the first of them; of texts with FEW shingles all
    similar ones are connected.  Then all pairs of different components that share a
    shingle of their prefixes (``overlap``) are candidates, so that no similar pair is
    left unconnected.  Every one is verified: links have a
    Jaccard similarity of ``words_in_shingle``-word shingles of at least
    ``least``.  Documents without links are not returned.  Null texts count as
    empty, texts without words are similar to each other; rows with a null doc_id
    link with nothing; rows that repeat doc_id and text are one document, with
    another text one of their own; empty tables give no rows; further columns are
    ignored.
    """
    found, _, named = _similar(docs, words_in_shingle, least)
    return named(found, "doc_id", "component_id")


def _similar(docs: DataFrame, words_in_shingle: int, least: float) -> tuple[DataFrame, int, Callable[..., DataFrame]]:
    """The result of ``similar_documents`` by nodes, a bound on its rows, and the function that names nodes."""
    scratch = Scratch(docs.sparkSession, "similar")
    light, repeated, named = documents(docs, scratch)
    light = light.withColumnRenamed("node", "doc_id")
    n = SIGNATURES * docs.count()
    rows = scratch.write(sign(light, 3, SIGNATURES), "rows", n, texts=True)
    distinct = rows.groupBy("signature", "print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    distinct = scratch.write(distinct, "distinct", n)
    wide = print_links(distinct.drop("n"), WIDE, WIDE_PARTS, scratch, FORESTS)
    equal = rows.join(distinct.filter("n > 1"), ["signature", "print"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    candidates = wide.unionAll(equal).unionAll(short_candidates(light, words_in_shingle, least, scratch, n // SIGNATURES)).filter("u != v")
    candidates = scratch.write(candidates.distinct(), "candidates", n)

    def similar(candidates: DataFrame, name: str) -> DataFrame:
        nodes = candidates.select("u").unionAll(candidates.select("v")).distinct().withColumnRenamed("u", "doc_id")
        nodes = scratch.write(nodes, f"{name}-named", n)
        sets = arrow_map(light.join(small(nodes, limit=SENT_IDS), "doc_id", "left_semi"), _shingler(words_in_shingle), "doc_id long, shingles array<long>", "text")
        sets = scratch.write(sets.dropDuplicates(["doc_id"]) if repeated else sets, f"{name}-sets")
        links = scratch.write(verified(candidates, sets, least), name, 8 * n)
        scratch.drop(f"{name}-sets")
        return links

    first = components(similar(candidates, "verified"), scratch)
    first = scratch.write(first.withColumnRenamed("node", "doc_id"), "first", n)
    marked = light.join(small(first, limit=SENT_IDS), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    missed = overlapping(marked, functools.partial(shingle_hashes, words_in_shingle=words_in_shingle), least)
    more = similar(scratch.write(missed.distinct(), "missed"), "more")
    stars = first.filter("doc_id != component").toDF("u", "v")
    found = components(stars.unionAll(more), Scratch(docs.sparkSession, "connected"))
    return found.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id"), n, named


def keep_representatives(docs: DataFrame, words_in_shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each similar group, in their own columns.

    Rows that repeat doc_id and text stay or go together; of those with another
    text each is a document, and which of a group stays is settled by a hash.
    Nulls, empty texts and empty tables are as in ``similar_documents``.
    """
    scratch = Scratch(docs.sparkSession, "near")
    with temporary():
        found, n, named = _similar(docs, words_in_shingle, least)
        gone = found.filter("doc_id != component_id").select("doc_id", F.col("doc_id").alias("node"))
        gone = scratch.write(named(gone, "doc_id"), "gone", n)
    kept = without(docs, gone.filter("doc_id = node").select("doc_id"), doc_id=F.col("doc_id").cast("long"))
    hashed = gone.filter("doc_id != node").select("node")
    return kept if hashed.isEmpty() else without(kept, hashed, node=F.xxhash64(F.col("doc_id").cast("long"), "text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: three-word shingles over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
