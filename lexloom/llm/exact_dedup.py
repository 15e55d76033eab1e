"""Exact dedup: counting quotient filters find repeats, bytes confirm them.

1. One pass over the texts writes a digest row per document: fingerprint,
   SHA-256 of the text without white space, and length.  No text is kept.
2. Every partition builds counting quotient filters of its fingerprints, one
   per shard of the fingerprint space; a shard's filters merge losslessly.
   However often a text repeats, a partition sends one counter for it.
3. Texts whose fingerprint counts above one are read again and grouped by their
   bytes, combined on the map side first, so a third of all rows with one text
   send one row per partition.
4. Digest rows look up their group; all others are groups of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quotient
from .arrow import arrow_map
from .scratch import Scratch, packed, shuffle_partitions, small, table, temporary, without

#: The bytes that normalisation deletes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Fingerprints that a shard of the filter holds on average.
SHARD_ROWS = 500_000
#: Repeated fingerprints (8 bytes each) that are broadcast; more are joined by a shuffle.
SENT_PRINTS = 1_000_000


def normalised(texts: pa.Array) -> list[bytes]:
    """UTF-8 texts without white space; null counts as empty."""
    return [b"" if t is None else t.translate(None, SPACE) for t in texts.cast(pa.binary()).to_pylist()]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))


def _digest():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = normalised(batch.column("text"))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("raw"),
                pa.array(fingerprints(texts).view(np.int64)),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pc.utf8_length(batch.column("text")).fill_null(0).cast(pa.int64()),
            ],
            names=["doc_id", "raw", "print", "sha", "n_points"],
        )

    return each


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, raw (a hash of the text as it is), print, sha and n_points per row."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    return arrow_map(light, _digest, "doc_id long, raw long, print long, sha binary, n_points long", "text")


def shard_bits(rows: int, partitions: int) -> int:
    return max(1, int(np.ceil(np.log2(max(partitions, rows / SHARD_ROWS)))))


def repeated_prints(prints: DataFrame, bits: int) -> DataFrame:
    """(print, n) of fingerprints that occur more than once; ``bits`` name the shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Distinct fingerprints and counts of a partition, 16 bytes each: runs of like size merge, so each is merged few times.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True))
            while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                held[-2:] = [quotient.merge(held[-2:])]
        if not held:
            return
        found, n = quotient.merge(held)
        shards = found >> np.uint64(64 - bits)
        for shard in np.unique(shards).tolist():
            a, b = np.searchsorted(shards, [shard, shard + 1], side="left")
            data = quotient.build(found[a:b], n[a:b], bits)
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["shard", "filter"])

    def merged(filters: pa.Table) -> pa.Table:
        shard = filters.column("shard")[0].as_py()
        whole = quotient.merge_filters(filters.column("filter").to_pylist(), shard, bits)
        found, n = quotient.read(whole, shard, bits)
        often = n > 1
        return pa.table({"print": found[often].view(np.int64), "n": n[often]})

    filters = prints.mapInArrow(build, "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(merged, "print long, n long")


def _bodies():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = normalised(batch.column("text"))
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(fingerprints(texts).view(np.int64)),
                pa.array(texts, pa.binary()),
                pc.utf8_length(batch.column("text")).fill_null(0).cast(pa.int64()),
            ],
            names=["doc_id", "print", "body", "n_points"],
        )

    return each


def verified_groups(docs: DataFrame, often: DataFrame) -> DataFrame:
    """Groups of equal bytes among texts with a repeated fingerprint.

    Returns print, sha, keep_id, group_size and most (code points of what stays).  The row that stays has the most
    code points, then the smallest doc_id (nulls last): one decimal orders both,
    which keeps the aggregation in place in Spark's hash map.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = arrow_map(light, _bodies, "doc_id long, print long, body binary, n_points long", "text")
    rows = rows.join(small(often.select("print"), limit=SENT_PRINTS), "print", "left_semi")
    exact = lambda c: c.cast("decimal(38,0)")
    step, last = exact(F.lit(Decimal(2**64))), exact(F.lit(Decimal(2**63 - 1)))
    behind = last - exact(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)))
    rows = rows.withColumn("best", exact(exact(F.col("n_points")) * step + behind))
    groups = rows.groupBy("print", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("best").alias("best"))
    keep = (last - F.col("best") % step).cast("long")
    return groups.filter("group_size > 1").select(
        "print",
        F.unhex(F.sha2("body", 256)).alias("sha"),
        F.when(keep < 2**63 - 1, keep).alias("keep_id"),
        "group_size",
        F.try_divide(F.col("best") - F.col("best") % step, step).cast("long").alias("most"),
    )


def dedup_exact(docs: DataFrame) -> DataFrame:
    """Which rows of ``docs`` (doc_id, text) repeat another's text.

    Texts are equal when they are identical without white space.  Returns, for
    every row: doc_id, keep_id, group_size, kept, text_sha256 and raw (a hash of
    the text as it is).  Null texts count as empty, and empty texts equal each
    other.  Of rows with one doc_id and as many code points the text with the
    smallest ``raw`` is kept; rows that repeat both doc_id and text share one
    decision.  A null doc_id is kept only where nothing else can be.  Empty
    tables give no rows; further columns are ignored.
    """
    return _decided(docs)[0]


def _decided(docs: DataFrame) -> tuple[DataFrame, int]:
    """The result of ``dedup_exact``, and the number of rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    n = docs.count()
    rows = scratch.write(digests(docs), "digests", n, texts=True)
    bits = shard_bits(n, shuffle_partitions(spark))
    often = scratch.write(repeated_prints(rows.select("print"), bits), "often", n)
    groups = scratch.write(verified_groups(docs, often), "groups", n)
    joined = rows.join(small(groups), ["print", "sha"], "left")
    # Where rows repeat a doc_id, several texts may be the one that stays: that with the least hash does.
    may_stay = F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))
    tied = joined.filter(may_stay).groupBy("print", "sha").agg(F.min("raw").alias("only"), F.max("raw").alias("_most"))
    tied = scratch.write(tied.filter("only != _most").drop("_most"), "tied", n)
    if tied.isEmpty():
        stays = may_stay
    else:
        joined = joined.join(small(tied), ["print", "sha"], "left")
        stays = may_stay & F.coalesce(F.col("raw") == F.col("only"), F.lit(True))
    scratch.drop("often")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    decided = joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | stays).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "raw",
    )
    return decided, n


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``dedup_exact`` drops, in their own columns.

    Of rows that repeat both doc_id and text one is kept, whatever their further
    columns hold.  Nulls, empty texts and empty tables are as in ``dedup_exact``.
    """
    scratch = Scratch(docs.sparkSession, "dropped")
    with temporary():
        decided, n = _decided(docs)
        repeated = decided.filter("group_size > 1")
        known = repeated.groupBy("doc_id", "raw").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        known = scratch.write(known, "known", n)
    dropped, again = known.filter("not kept").select("doc_id", "raw"), known.filter("kept and n > 1").select("doc_id", "raw")
    keys = {"doc_id": F.col("doc_id").cast("long"), "raw": F.xxhash64("text")}
    if again.isEmpty():
        return without(docs, dropped, **keys)
    rows, marks = packed(docs, **keys), small(again)
    same = [rows[k].eqNullSafe(marks[k]) for k in keys]
    one = rows.join(marks, same, "left_semi").groupBy("doc_id", "raw").agg(F.first("row").alias("row")).select("row.*")
    return without(docs, dropped.unionAll(again), **keys).unionAll(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per document, dropped ones too."""
    return dedup_exact(table(spark, sf_dir, "documents")).drop("raw")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents),
g AS (
  SELECT doc_id, n, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
FROM g
"""
