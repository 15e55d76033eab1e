"""The prefix trie of conversations, without growing it from the top.

A node is a distinct sequence of first turns, and belongs to the smallest
conversation that begins with it.  Whoever owns a node owns all that follow in its
own turns, so a conversation's first owned depth is found by binary search: every
round joins one prefix digest per conversation against the smallest conversation
of each digest.  From there on its turns are a chain of nodes, which hangs from the
node above its first.  Chains form the tree: their sums rise by doubling steps, so
rounds are the logarithm of its height, and run along each chain from its end.

Prefixes are known by two 64-bit lanes, each the exclusive or of hashes of (depth,
SHA-256 of the turn).  Such a digest is the same in whatever parts it is computed,
so a conversation of any length is worked on in blocks of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch, shuffle_partitions, small, table
from .sql import CRC_TABLE, crc32

#: Turns of one conversation that meet in a task, and conversations or turns that a range holds on average.
BLOCK, RANGE_ROWS = 4_096, 20_000
#: Conversations of a query's group, and one more than the most turns that they share.
GROUP, SHARED = 5, 9
_NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, sha, bytes) of every turn, and (conv_id, length) of every conversation.

    Turns are ordered by turn, null first, then by their digest.  They are dealt
    by ranges, so that a conversation of any length is ordered in several tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    light = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes")
    ).filter("conv_id is not null")
    parts = max(shuffle_partitions(scratch.spark), conversations.count() // RANGE_ROWS)
    in_order = [F.col("turn").asc_nulls_first(), F.col("sha")]
    dealt = light.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", *in_order, "tie")
    dealt = scratch.write(dealt.drop("tie").withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.write(counts.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))), "counts")
    # Only conversations on the border of ranges are in several: at most two rows a range.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.filter("parts > 1").select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*in_order)) - 1
    turns = dealt.withColumn("nth", nth).join(small(offsets), ["conv_id", "part"], "left")
    turns = turns.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("pos"), "sha", "bytes")
    return scratch.write(turns, "turns"), counts.groupBy("conv_id").agg(F.sum("n").alias("length"))


def rebuilt(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, length, sha, bytes) and (conv_id, length) of conversations that share their first turns.

    Conversation c takes its first h turns, h = crc32(c) % SHARED, from c - c % GROUP (the
    remainder's sign is that of c), and its own behind the first h.
    """
    hashed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    planned = convs.select("conv_id", F.col("length").alias("own"), hashed.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("_base"))
    planned = planned.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("_base", F.lit(0))))
    planned = planned.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("_base")
    planned = scratch.write(planned, "planned")
    own = turns.join(planned, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "length", "sha", "bytes")
    shared = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv_id", "base")
    shared = shared.join(planned, "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "sha", "bytes")
    return own.unionAll(shared), planned.select("conv_id", "length")


def _prefixes(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """``sequences`` with the digest (a, z) of the turns up to each, and their block."""
    rows = sequences.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK).cast("long"))
    rows = rows.select("conv_id", "depth", "length", "block", "bytes", *(F.xxhash64(F.lit(lane), "depth", "sha").alias(c) for lane, c in enumerate("az")))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.filter(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("z").alias("z"))
    blocks = blocks.select("conv_id", "block", *(F.bit_xor(c).over(before).alias(f"{c}0") for c in "az"))
    blocks = small(scratch.write(blocks, "blocks"))
    rows = rows.select("conv_id", "depth", "length", "block", "bytes", *(F.bit_xor(c).over(inside).alias(c) for c in "az"))
    rows = rows.join(blocks, ["conv_id", "block"], "left")
    whole = [F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0).cast("long"))).alias(c) for c in "az"]
    return scratch.write(rows.select("conv_id", "depth", "length", "block", "bytes", *whole), "prefixes")


def _first_owned(prefixes: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, first, above) of conversations with turns.

    ``first`` is the least depth that the conversation owns, null where it owns
    none; ``above`` owns the node before it, or the last node; null is the root.
    """
    digests = F.sort_array(F.collect_list(F.struct("depth", "a", "z"))).alias("digests")
    state = prefixes.groupBy("conv_id", "block").agg(digests, F.min("depth").alias("lo"), F.max("depth").alias("last"))
    state = state.select("conv_id", "digests", F.col("lo").alias("begin"), "lo", (F.col("last") + 1).alias("hi"), "last", F.lit(None).cast("long").alias("failed"), F.lit(None).cast("long").alias("above"))
    owners = minima.select(F.col("depth").alias("_depth"), F.col("a").alias("_a"), F.col("z").alias("_z"), "owner")
    done, turn = [], 0
    kept = ["conv_id", "lo", "last", "failed", "above"]
    while True:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
        asks = state.withColumn("mid", middle)
        asks = asks.withColumn("ask", F.element_at("digests", (F.col("mid") - F.col("begin") + 1).cast("int")))
        asks = asks.join(owners, (F.col("mid") == F.col("_depth")) & (F.col("ask.a") == F.col("_a")) & (F.col("ask.z") == F.col("_z")))
        owned = F.col("owner") == F.col("conv_id")
        moved = asks.select(
            "conv_id",
            "digests",
            "begin",
            F.when(owned, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"),
            F.when(owned, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
            "last",
            F.when(owned, F.col("failed")).otherwise(F.col("mid")).alias("failed"),
            F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"),
        )
        moved = scratch.write(moved, f"search-{turn}")
        done.append(moved.filter("lo >= hi").select(*kept))
        state, turn = moved.filter("lo < hi"), turn + 1
        if state.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    # Blocks search by themselves.  What is not owned lies before what is, so the deepest failure is the node above.
    first = F.min(F.when(F.col("lo") <= F.col("last"), F.col("lo"))).alias("first")
    return found.groupBy("conv_id").agg(first, F.max_by("above", "failed").alias("above"))


def _risen(chains: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv_id, leaves, saved) summed over each chain and all that hang from it, however far below.

    After k rounds a sum holds what is less than 2^k chains below, and ``up`` is the
    chain 2^k above; none where that is above the root's.
    """
    now, turn = chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), 0
    while True:
        now = scratch.write(now, f"risen-{turn}")
        rising = now.filter("up is not null")
        if rising.isEmpty():
            return now
        added = rising.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        # Nothing is above the root's chain, from which most may hang.
        ups = now.filter(F.col("up").isNotNull()).select(F.col("conv_id").alias("_up"), F.col("up").alias("_next"))
        asked = F.when(F.col("up") != root, F.col("up"))
        moved = now.join(added, "conv_id", "left").withColumn("_asked", F.coalesce(asked, -F.col("conv_id") - 1))
        moved = moved.join(ups, (asked.isNotNull()) & (F.col("_asked") == F.col("_up")), "left")
        now = moved.select(
            "conv_id", F.when(asked.isNotNull(), F.col("_next")).alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))
        )
        turn += 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, whose parts follow one another in order."""
    key, sha = None, None

    def told(rows: list) -> pa.RecordBatch:
        owner, depth, digest = zip(*rows)
        return pa.record_batch([pa.array(owner, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest)], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        out = []
        for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids"))):
            if (owner, depth) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (owner, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield told(out)
    if key is not None:
        yield told([(*key, sha.hexdigest())])


def _ends(convs: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations (conv_id, owner, length) end.

    Ids are joined within ranges first; a node's parts then pass through one hash in
    order, which holds none of them.
    """
    spark = scratch.spark
    dealt = convs.repartitionByRange(max(shuffle_partitions(spark), n // RANGE_ROWS), "conv_id").withColumn("part", F.spark_partition_id())
    dealt = scratch.write(dealt, "ends")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    parts = dealt.groupBy("owner", F.col("length").alias("depth"), "part").agg(ids)
    parts = parts.repartition(shuffle_partitions(spark), "owner", "depth").sortWithinPartitions("owner", "depth", "part")
    return parts.select("owner", "depth", "ids").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node of the trie of ``sequences`` (conv_id, depth from 1, length, sha, bytes) of ``convs`` (conv_id, length)."""
    convs = scratch.write(convs, "convs")
    n, root = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    prefixes = _prefixes(sequences, scratch)
    minima = prefixes.groupBy("depth", "a", "z").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    minima = scratch.write(minima, "minima")
    found = _first_owned(prefixes, minima, scratch)
    is_root = F.col("conv_id") == F.lit(root)
    above = F.coalesce("above", F.lit(root).cast("long"))
    owns = is_root | F.col("first").isNotNull()
    convs = convs.join(found, "conv_id", "left").select(
        "conv_id",
        "length",
        F.when(is_root, F.lit(0).cast("long")).otherwise(F.col("first")).alias("first"),
        F.when(~is_root, above).alias("above"),
        F.when(owns, F.col("conv_id")).otherwise(above).alias("owner"),
    )
    convs = scratch.write(convs, "owners")
    chains = convs.filter("first is not null").select("conv_id", "first", "length", F.col("above").alias("parent"), (F.col("first") - 1).alias("at"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    top = convs.filter(is_root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("own"))
    nodes = nodes.unionAll(top)

    # Sums of whole chains, from those that hang lowest up to the root's.
    hung = chains.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("length")).agg(F.lit(True).alias("hung")).distinct()
    own = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"))
    sums = chains.join(own, "conv_id").join(hung, ["conv_id", "length"], "left")
    sums = sums.select("conv_id", "parent", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    risen = _risen(sums, root, scratch)
    hanging = chains.filter("parent is not null").join(risen, "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth"))
    hanging = hanging.agg(F.count(F.lit(1)).alias("n_hung"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))

    # Sums of nodes, along their chains from the end.
    nodes = nodes.join(chains, "conv_id").join(hanging, ["conv_id", "depth"], "left")
    n_hung = F.coalesce("n_hung", F.lit(0))
    nodes = nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (n_hung + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        (F.coalesce("_leaves", F.lit(0)) + F.when((F.col("depth") == F.col("length")) & F.col("n_hung").isNull(), 1).otherwise(0)).alias("leaves"),
        (F.col("own") + F.coalesce("_saved", F.lit(0))).alias("saved"),
        F.floor(F.col("depth") / BLOCK).cast("long").alias("block"),
        (F.floor(F.col("length") / BLOCK) > F.floor(F.col("first") / BLOCK)).alias("spread"),
    )
    nodes = scratch.write(nodes, "nodes")
    later = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.filter("spread").groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    blocks = small(scratch.write(blocks.select("conv_id", "block", F.sum("leaves").over(later).alias("_leaves"), F.sum("saved").over(later).alias("_saved")), "later"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({c: F.sum(c).over(inside) for c in ("leaves", "saved")}).join(blocks, ["conv_id", "block"], "left")
    ends = _ends(convs.select("conv_id", "owner", "length"), scratch, n)
    return nodes.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, share: bool = False) -> DataFrame:
    """One row per node of the prefix trie of ``conversations`` (conv_id, turn, role, text).

    Returns conv_id (of the smallest conversation that begins with the node's
    turns), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.  With ``share`` conversations are rebuilt first to
    share their first turns.  Null roles and texts are empty ones; a null turn comes
    first and equal turns are ordered by their digest; rows that repeat are turns
    each; rows with a null conv_id belong to no conversation; empty tables have no
    nodes, not even a root; further columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = ordered_turns(conversations, scratch)
    if share:
        return prefix_trie(*rebuilt(turns, convs, scratch), scratch)
    sequences = turns.join(convs, "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "sha", "bytes")
    return prefix_trie(sequences, convs, scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of all conversations, rebuilt to share turns."""
    return conversation_trie(table(spark, sf_dir, "conversations"), share=True)


#: A node is the string of its turns' digests; its subtree are the nodes whose strings begin with it.
ORACLE = f"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, sha, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) - 1 AS pos FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
u AS (SELECT c.conv_id, 0 AS own, t.pos, t.sha, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL
  SELECT c.conv_id, 1, t.pos, t.sha, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (SELECT conv_id, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY own, pos) AS path, bytes FROM u UNION ALL SELECT conv_id, '', 0 FROM c),
n AS (SELECT path, length(path) // 64 AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE path <> '' GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, length(path)) AS path FROM p GROUP BY 1) GROUP BY 1),
s AS (SELECT n.path, sum((b.n_convs - 1) * b.bytes) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
  FROM n JOIN n b ON starts_with(b.path, n.path) LEFT JOIN k ON k.path = b.path GROUP BY 1)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN a.conv_id END AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path LEFT JOIN n a ON n.path <> '' AND a.path = left(n.path, greatest(length(n.path) - 64, 0))
"""
