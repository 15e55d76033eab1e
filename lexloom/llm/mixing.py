"""Mixing sources to target weights by Efraimidis-Spirakis sampling, natively.

Targets: sources in code-point order weigh 5, 2, 1 and so on, share the whole
corpus size, and stop at ``MOST`` times their own size; what exceeds that is
shared again by weight.  That fixed point is min(cap, level * weight) for one
level, which a sort by cap / weight finds without iterating.

Selection: a source first gives as many whole epochs as fit its target.  For
the rest each document draws an exponential key -ln(u) / quality, and documents
are taken in key order while they fit; one later document, of the size nearest
to what is then missing, fills the gap.  Rows that repeat entirely have one key:
they are one entry, of which so many are taken as fit.
Only the cut key of each source is looked for: bucket totals locate the bucket
in which the budget runs out, and only that bucket's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import bucket_count, rank_in_buckets
from .scratch import Scratch, packed, shuffle_partitions, small, table
from .sharding import HASH_BITS, seeded, source_key

WEIGHTS = (5.0, 2.0, 1.0)
#: Times its size that a source, and so a document, is taken at most.
MOST = 3
#: Words between white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Quality weights lie between these; the upper bound keeps buckets even.
LEAST_QUALITY, MOST_QUALITY = 1.0, 4.0


def quality_weight(n_chars: Column, n_blanks: Column) -> Column:
    """A weight from the mean length of what blanks part: near five letters weighs most."""
    mean = (n_chars - n_blanks) / (n_blanks + 1)
    return F.lit(LEAST_QUALITY) + (MOST_QUALITY - LEAST_QUALITY) / (1 + F.abs(mean - 5))


def keyed(docs: DataFrame, seed: int, quality: Column | None = None) -> DataFrame:
    """doc_id, src, draw (a hash of the row), key (smaller: taken earlier), text and the whole row.

    Nothing here takes a text apart, as the key is made again for whole rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n_chars = F.length(text).cast("long")
    n_blanks = n_chars - F.length(F.replace(text, F.lit(" "), F.lit("")))
    draw = seeded(seed, "doc_id", n_chars)
    light = packed(
        docs, doc_id=F.col("doc_id"), src=source_key("source"), text=text, draw=draw, n_chars=n_chars, n_blanks=n_blanks,
        quality=F.lit(None) if quality is None else quality,
    )
    uniform = (F.col("draw") + 0.5) * 2.0**-HASH_BITS
    # Bounded, so that keys fill their buckets evenly.
    weight = quality_weight(F.col("n_chars"), F.col("n_blanks")) if quality is None else F.greatest(F.least("quality", F.lit(MOST_QUALITY)), F.lit(LEAST_QUALITY))
    key = -F.log(uniform) / weight
    return light.select("doc_id", "src", "text", "draw", key.alias("key"), "row")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size) -> with target, in words; one row per source."""
    null_last = F.when(F.col("src") == "n", 1).otherwise(0)
    turn = (F.row_number().over(Window.orderBy(null_last, "src")) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)
    cap = F.col("source_size") * float(MOST)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("place", F.row_number().over(filled))
        .withColumn("level", left / weights_left)
    )
    # The first source that its cap does not bind, in this order, sets the level.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    return leveled.withColumn("level", F.min(free).over(everything).getField("level")).select(
        "src", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def mixture(docs: DataFrame, seed: int = 5, quality: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, src, size, draw, key, ord) and each source's plan.

    A plan has src, source_size, target, epochs, buckets, cut and some: rows
    whose (bucket, key, draw) is at most the cut are taken once more than
    ``epochs``, and of the rows with a (key, draw) of ``some`` so many.  Reruns agree.
    ``quality`` weighs documents instead of ``quality_weight``.
    Null texts have no words, null sources are one source that comes last, rows
    that repeat entirely are taken one by one, empty tables give no rows, and
    further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    n = docs.count()
    rows = keyed(docs, seed, quality).select("doc_id", "src", n_words(F.col("text")).alias("size"), "draw", "key")
    rows = scratch.write(rows.withColumn("ord", F.monotonically_increasing_id()), "rows", n, texts=True)
    buckets = bucket_count(n, 4 * shuffle_partitions(spark))
    # Rows that repeat entirely share their key: they are one entry, however many, and so are any of one key and size.
    entries = rows.groupBy("src", "key", "draw", "size").agg(F.count(F.lit(1)).alias("n"))
    entries = entries.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets)).withColumn("all", F.col("size") * F.col("n"))
    entries = scratch.write(entries, "entries", n)
    sums = scratch.write(entries.groupBy("src", "bucket").agg(F.sum("all").alias("all")), "sums", n)
    plan = targets(sums.groupBy("src").agg(F.sum("all").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST)))
    plan = plan.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    plan = scratch.write(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")
    # The buckets into which a source's remaining budget reaches last.
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
    last = (
        running.join(plan.select("src", "rest"), "src")
        .filter(F.col("before") < F.col("rest"))
        .groupBy("src")
        .agg(F.max_by(F.struct("bucket", "before", "rest"), "bucket").alias("at"))
        .select("src", "at.bucket", "at.before", "at.rest")
    )
    inside = Window.partitionBy("src", "bucket").orderBy("key", "draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = entries.join(last, ["src", "bucket"]).withColumn("through", F.col("before") + F.sum("all").over(inside))
    taken = (
        reached.filter(F.col("through") <= F.col("rest"))
        .groupBy("src")
        .agg(F.max(F.struct("bucket", "key", "draw")).alias("cut"), F.max("through").alias("through"))
    )
    # Without any row of its last bucket, a source is cut where that bucket starts: keys are positive.
    start = F.struct(F.col("bucket"), F.lit(-1.0).alias("key"), F.lit(0).cast("long").alias("draw"))
    cuts = last.join(taken, "src", "left").select(
        "src",
        F.coalesce("cut", start).alias("cut"),
        (F.col("rest") - F.coalesce("through", "before")).alias("gap"),
    )
    cuts = scratch.write(cuts, "cuts")
    # Of the entry behind the cut so many rows as fit; then one later row whose size comes nearest to what is still missing.
    later = with_plan(entries, cuts).filter((F.struct("bucket", "key", "draw") > F.col("cut")) & (F.col("size") > 0))
    next_ = later.groupBy("src").agg(F.min(F.struct("key", "draw", "size", "n", "gap")).alias("e")).select("src", "e.*")
    fits = F.floor(F.col("gap") / F.col("size"))
    part = scratch.write(next_.select("src", "key", "draw", F.least("n", fits).alias("times"), (F.col("gap") - F.least("n", fits) * F.col("size")).alias("left")), "part")
    gap = F.col("left")
    nearness = F.struct(F.abs(gap - F.col("size")).alias("off"), "key", "draw")
    own = (F.col("key") == F.col("part_key")) & (F.col("draw") == F.col("part_draw"))
    rest = part.select("src", F.col("key").alias("part_key"), F.col("draw").alias("part_draw"), F.col("times").alias("part_times"), "left")
    free = later.drop("gap", "cut").join(small(rest), "src").filter((F.col("n") > F.when(own, F.col("part_times")).otherwise(0)) & (F.abs(gap - F.col("size")) < gap))
    filler = free.groupBy("src").agg(F.min(nearness).alias("e")).select("src", "e.key", "e.draw", F.lit(1).cast("long").alias("times"))
    some = part.filter("times > 0").select("src", "key", "draw", "times").unionAll(filler).groupBy("src", "key", "draw").agg(F.sum("times").alias("times"))
    some = some.groupBy("src").agg(F.collect_list(F.struct("key", "draw", "times")).alias("some"))  # two at most
    plan = plan.drop("rest").join(cuts.drop("gap"), "src", "left").join(some, "src", "left").withColumn("buckets", F.lit(buckets))
    plan = scratch.write(plan, "final")
    scratch.keep("rows", "final")
    return rows, plan


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows beside their source's plan; sources are few, which is checked."""
    return rows.join(small(plan), "src")


def in_part(key: str = "key", draw: str = "draw") -> Column:
    """How many rows of a row's entry are taken once more, where not all or none of them are; else null."""
    own = F.filter("some", lambda e: (e["key"] == F.col(key)) & (e["draw"] == F.col(draw)))
    return F.get(own, F.lit(0))["times"]


def _whole_times() -> Column:
    """How often a row is taken, beside its plan, unless its entry is taken in part."""
    bucket = F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")).alias("bucket")
    early = F.coalesce(F.struct(bucket, "key", "draw") <= F.col("cut"), F.lit(False)).cast("long")
    return F.least(F.col("epochs") + early, F.lit(MOST))


def _part_times(parts: DataFrame) -> DataFrame:
    """``times`` of rows whose entry is taken in part: the first by ``ord`` are taken once more.

    Tasks that numbered the rows count them, so that rows of an entry need not meet.
    """
    tasks = parts.withColumn("_part", in_part()).withColumn("_task", F.shiftright("ord", 33))
    ranked = rank_in_buckets(tasks, ["src", "key", "draw"], "_task", [F.col("ord")], "_rank")
    more = (F.col("_rank") < F.col("_part")).cast("long")
    return ranked.withColumn("times", F.least(F.col("epochs") + more, F.lit(MOST))).drop("_part", "_task", "_rank")


def taken_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (src, key, draw, ord and more) beside their plan, with ``times`` they are taken."""
    at = with_plan(rows, plan)
    whole = at.filter(in_part().isNull()).withColumn("times", _whole_times())
    return whole.unionByName(_part_times(at.filter(in_part().isNotNull())))


def mix_documents(docs: DataFrame, seed: int = 5, quality: Column | None = None) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken.

    Whole rows meet only their source's plan; just those of an entry that is
    taken in part (one or two a source, unless rows repeat) are written aside and
    counted.  Nulls, repeated rows and empty tables are as in ``mixture``.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    _, plan = mixture(docs, seed, quality)
    rows = with_plan(keyed(docs, seed, quality), plan)
    parts = rows.filter(in_part().isNotNull()).select("src", "key", "draw", "row").withColumn("ord", F.monotonically_increasing_id())
    parts = _part_times(with_plan(scratch.write(parts, "parts"), plan)).select("row", "times")
    whole = rows.filter(in_part().isNull()).select("row", _whole_times().alias("times"))
    times = F.col("times").cast("int")
    copies = whole.unionAll(parts).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), times)))
    return copies.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what the mix takes of every document."""
    rows, plan = mixture(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("times")).alias("taken")
    return taken_times(rows, plan).select("doc_id", "size", "source_size", "target", taken)


#: For tables without rows that repeat entirely.
ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, src, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size, length(t) AS n_chars, length(t) - length(replace(t, ' ', '')) AS n_blanks,
    CAST('0x' || substr(md5('5|' || doc_id || '|' || length(t)), 1, 13) AS BIGINT) AS draw FROM d),
k AS (SELECT *, -ln((draw + 0.5::DOUBLE) * power(2::DOUBLE, -52))
    / (1::DOUBLE + 3::DOUBLE / (1 + abs((n_chars - n_blanks)::DOUBLE / (n_blanks + 1) - 5))) AS key FROM w),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM w GROUP BY src),
t AS (SELECT *, 3::DOUBLE * source_size AS cap,
    [5::DOUBLE, 2, 1][1 + (row_number() OVER (ORDER BY CASE WHEN src = 'n' THEN 1 ELSE 0 END, src) - 1) % 3] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, src) AS place FROM t),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
g AS (SELECT src, source_size, least(cap, (SELECT arg_min(level, place) FROM v WHERE level * weight <= cap) * weight) AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM g),
r AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(size) OVER (PARTITION BY src ORDER BY key, draw, size ROWS UNBOUNDED PRECEDING) AS through FROM k JOIN e USING (src)),
c AS (SELECT src, max(CASE WHEN through <= rest THEN through ELSE 0 END) AS reached FROM r GROUP BY src),
l AS (SELECT r.*, rest - reached AS gap FROM r JOIN c USING (src)),
f AS (SELECT src, arg_min(doc_id, (abs(gap - size), key, draw)) AS filler FROM l WHERE through > rest AND size > 0 AND abs(gap - size) < gap GROUP BY src)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * least(epochs + CASE WHEN through <= rest OR doc_id = filler THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM l LEFT JOIN f USING (src)
"""
