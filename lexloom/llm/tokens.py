"""Token counts through a digest cache.

A cache table holds (text digest, tokenizer digest, n_tokens).  Documents join
it on the digest of their normalised content; only distinct contents that it
lacks are encoded, each once, and appended.  Normalised is what the tokenizer's
own normaliser makes of a text before it encodes it, so equal contents have
equal counts; a tokenizer without one takes texts as they are.  The tokenizer's
digest is that of its model file and its library's version, so another version
never reads this one's counts.
"""

from __future__ import annotations

import hashlib
import importlib.metadata

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map
from .scratch import Scratch, table

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Documents to encode, or to pass over: the fewer of them are sent to the
#: executors, up to so many ids; if both are more, texts move to meet them.
SENT_IDS = 500_000
#: Digests with a larger share of all rows, or so many of them, meet their count by broadcast: a hundred thousand at most.
HOT_SHARE, HOT_ROWS = 100_000, 1_000
#: The setting that names the query's cache; without it every run has a new one.
CACHE_SETTING = "spark.lexloom.token.cache"


def model_digest(path: str) -> str:
    library = importlib.metadata.version("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()


def normaliser(path: str):
    """A function from texts to what their tokens follow from."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [model.normalize(t) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    if model.normalizer is None:
        return lambda texts: texts
    # Added tokens are looked for in the text as it is.
    added = [t.content for t in model.get_added_tokens_decoder().values()]
    return lambda texts: [t if any(a in t for a in added) else model.normalizer.normalize_str(t) for t in texts]


def encoder(path: str):
    """A function from texts to token counts, with the library's defaults."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def _digests(path: str):
    def make():
        normalise = normaliser(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = normalise(["" if t is None else t for t in batch.column("text").to_pylist()])
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), digests], names=["doc_id", "n_bytes", "digest"])

        return each

    return make


def _counter(path: str, version: str):
    def make():
        count, normalise = encoder(path), normaliser(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n: list[int] = []
            for at in range(0, len(texts), 64):  # ids of a few documents at a time
                n.extend(count(texts[at : at + 64]))
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in normalise(texts)], pa.binary())
            return pa.record_batch([digests, pa.array([version] * len(n)), pa.array(np.array(n, np.int64))], names=["digest", "tokenizer", "n_tokens"])

        return each

    return make


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, or an empty one where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, model_path: str, cache_path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens for every row of ``docs`` (doc_id, text).

    Null texts count as empty: no bytes, and as many tokens as the library
    gives for an empty text.  Copies are encoded once, rows that repeat a doc_id
    each get their own text's count, empty tables give no rows, and further
    columns are ignored.  ``cache_path`` grows by the contents it lacked; one
    that concurrent runs both append has equal counts, of which one is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    version = model_digest(model_path)
    light = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    id_type = light.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(light.select("doc_id", "n_bytes", "text"), _digests(model_path), f"doc_id {id_type}, n_bytes long, digest binary", "text")
    n_rows = docs.count()
    rows = scratch.write(rows, "rows")

    def stored() -> DataFrame:
        own = read_cache(spark, cache_path).filter(F.col("tokenizer") == version)
        return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # The first document of each content, and the count that the cache has.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = scratch.write(first.join(stored(), "digest", "left"), "first")
    hot = first.filter(F.col("n") > max(HOT_ROWS, n_rows // HOT_SHARE)).select("digest")
    hot = F.broadcast(scratch.write(hot, "hot"))

    def met(side: DataFrame) -> DataFrame:
        """Rows with their digest's row of ``side``; those of digests that many share do not meet in one task."""
        often = rows.join(F.broadcast(side.join(hot, "digest", "left_semi")), "digest")
        return often.unionByName(rows.join(hot, "digest", "left_anti").join(side.join(hot, "digest", "left_anti"), "digest"))

    if not first.filter("n_tokens is null").isEmpty():
        decided = scratch.write(met(first).select("doc_id", "digest", (F.col("n_tokens").isNull() & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("wanted")), "decided")
        wanted = decided.filter("wanted").select(F.col("doc_id").alias("id")).distinct()
        n_wanted, n_missing = decided.filter("wanted").count(), first.filter("n_tokens is null").count()
        spared = decided.filter("not wanted").select(F.col("doc_id").alias("id")).distinct()
        # An id that repeats may be both: then all its texts are encoded.
        spared = scratch.write(spared.join(wanted.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left_anti"), "spared")
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        n_spared = spared.count()
        if n_spared <= min(n_wanted, SENT_IDS):
            misses = light.join(F.broadcast(spared), same, "left_anti")
        else:
            misses = light.join(F.broadcast(wanted) if n_wanted <= SENT_IDS else wanted, same, "left_semi")
        counted = arrow_map(misses.select("text"), _counter(model_path, version), CACHE_SCHEMA, "text")
        counted = scratch.write(counted, "counted")
        if counted.count() != n_missing:  # ids repeat
            lacking = first.filter("n_tokens is null").select("digest")
            counted = counted.dropDuplicates(["digest"]).join(lacking, "digest", "left_semi")
        counted.select("digest", "tokenizer", "n_tokens").write.mode("append").parquet(cache_path)
    return met(stored()).select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document, through the cache that CACHE_SETTING names."""
    cache = spark.conf.get(CACHE_SETTING, None) or Scratch(spark, "token-cache").path("counts")
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
