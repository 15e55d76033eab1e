"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Every source's rows are shuffled by a seeded hash and ranked; rank r of n gets
the fraction (r + 1/2) / n.  Sorting all rows by that fraction interleaves the
sources in proportion, and cutting the order at equal row counts gives shards
that each hold every source's share, within one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import bucket_count, rank_in_buckets
from .scratch import Scratch, packed, shuffle_partitions, table

#: Bytes a stored document takes besides its text.
ROW_OVERHEAD = 8


def source_key(column: str):
    """A grouping key in which a null source differs from every string."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def _identity() -> dict[str, Column]:
    """What a row is known by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long")
    return {"doc_id": F.col("doc_id"), "size": size, "text_crc32": F.crc32(text.cast("binary"))}


#: Bits of a seeded hash.
HASH_BITS = 52


def seeded(seed: int, *columns) -> Column:
    """A hash of columns below 2 ** HASH_BITS, as a long that other engines compute alike."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def light_rows(docs: DataFrame, seed: int) -> DataFrame:
    """Everything that sharding needs of a row; no text travels further."""
    rows = docs.select(source_key("source").alias("src"), *(c.alias(n) for n, c in _identity().items()))
    return rows.withColumn("key", seeded(seed, "doc_id", "text_crc32", "size"))


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """Deal ``docs`` (doc_id, text, source) to ``n_shards`` shards.

    Returns doc_id, src, size, text_crc32, shard and slot.  Shard sizes differ
    by one row at most, slots run gapless from 0 in each shard, and reruns
    agree.  Null texts count as no bytes, null sources are one source, rows
    that repeat entirely are dealt like any others, an empty table gives no
    rows, and further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.write(light_rows(docs, seed), "rows")
    total = rows.count()
    buckets = bucket_count(total, shuffle_partitions(spark))
    # The hash's upper 31 bits, read as a fraction of 2^31, pick the bucket.
    bucketed = rows.withColumn("bucket", F.shiftright(F.shiftright("key", HASH_BITS - 31) * buckets, 31))
    order = [F.col("key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = rank_in_buckets(bucketed, ["src"], "bucket", order, "rank")
    sizes = rows.groupBy("src").agg(F.count(F.lit(1)).alias("of"))
    fraction = (F.col("rank") + 0.5) / F.col("of")
    ranked = scratch.write(
        ranked.join(sizes, "src")
        .withColumn("fraction", fraction)
        .withColumn("bucket", F.floor(F.col("fraction") * buckets))
        .drop("rank", "of"),
        "ranked",
    )
    scratch.keep("ranked")
    order = [F.col("fraction"), F.col("src"), *order]
    placed = rank_in_buckets(ranked, [], "bucket", order, "place")
    # Shard s starts at the first place p with p * n_shards // total == s.
    shard = F.expr(f"place * {n_shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - start)
        .select("doc_id", "src", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 11) -> None:
    """Write whole rows as one folder per shard, their files sorted by slot.

    Every row is written once, in a shard that ``shard_documents`` deals one like
    it to.  Rows meet their place on doc_id, size and checksum; where rows repeat
    these, the rows are written aside first, to be told apart.  The folders are
    named by ``shard``, or by that name behind underscores where ``docs`` has it.
    Nulls and empty tables are as in ``shard_documents``.
    """
    scratch = Scratch(docs.sparkSession, "write-shards")
    name = "shard"
    while name.lower() in [c.lower() for c in docs.columns]:
        name = "_" + name
    keys = ["doc_id", "text_crc32", "size"]
    placed = scratch.write(shard_documents(docs, n_shards, seed).select(*keys, "shard", "slot"), "placed")
    rows = packed(docs, **_identity())
    again = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():
        rows = scratch.write(rows.withColumn("ord", F.monotonically_increasing_id()), "rows")
        order = {"ord": rows, "slot": placed.withColumn("ord", F.monotonically_increasing_id())}
        order["slot"] = scratch.write(order["slot"], "ordered")
        # The n-th of equal rows takes the n-th of their places; tasks count them, so that they need not meet.
        nth = [
            rank_in_buckets(df.withColumn("task", F.shiftright("ord", 33)), keys, "task", [F.col("ord")], "nth", nulls=True).drop("task", "ord")
            for df in order.values()
        ]
        rows, placed = nth
        keys = [*keys, "nth"]
    same = [rows[k].eqNullSafe(placed[k]) for k in keys]
    dealt = rows.join(placed, same).select(F.col("shard").alias(name), "slot", "row")
    files = max(n_shards, shuffle_partitions(docs.sparkSession))
    dealt = dealt.repartitionByRange(files, name, "slot").sortWithinPartitions(name, "slot")
    dealt.select(name, "row.*").write.partitionBy(name).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the law is ``rows`` (counts at most one apart)."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Checksums in SQL: the table's 256 entries by rule, then a step per byte.
ORACLE = r"""
WITH bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
h AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, src, length(x) // 2 AS n,
    list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS l FROM h),
d AS (SELECT doc_id, src, n + 8 AS size, xor(list_reduce(l, lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) AS text_crc32 FROM b, bits),
k AS (SELECT *, CAST('0x' || substr(md5('11|' || doc_id || '|' || text_crc32 || '|' || size), 1, 13) AS BIGINT) AS key FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY key, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY src) AS fraction FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, src, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, place * 24 // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
