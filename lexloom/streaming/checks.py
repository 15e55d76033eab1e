"""Rules over files as they arrive.

Match and sequence rules look at one file at a time, so a stream needs no state
for them: every micro-batch of whole files is lexed and checked by itself.
Rules over findings see the findings of their micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..operators.lexing import lex_files
from ..plans.engine import Context, check_tokens
from ..rules.ast import Rule


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of text files that appear in ``folder``, each whole."""
    texts = spark.readStream.text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def check_stream(files: DataFrame, rules: list[Rule], path: str, checkpoint: str, context: Context | None = None, lex: Callable[[DataFrame], DataFrame] = lex_files) -> StreamingQuery:
    """Append violations to Parquet under ``path``; a batch that reruns replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        tokens = lex(batch).persist(StorageLevel.MEMORY_AND_DISK)
        found = check_tokens(tokens, rules, context, ordered=False)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        tokens.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
