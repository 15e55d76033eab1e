"""Packing token sequences by minimum bin slack.

A document's tokens are cut into full windows and one tail.  Full windows are
sequences by themselves.  Tails are packed by their lengths: there are fewer
than a window's worth of distinct lengths, so the plan is made on a histogram
of constant size, however many documents it counts.  Each step takes the
longest tail left and finds, by a subset-sum bitset over the remaining lengths
and their counts, the multiset that leaves least slack; the multiset then fills
as many sequences as its counts allow, so every step uses up some length.

Documents find their place from their rank among the tails of their length.
Ranks come from counters per partition, written with the pieces, so a length that a
third of all rows share is ranked without meeting in one task.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import arrow_map
from .scratch import Scratch, table

WINDOW = 2048
#: The id that ends every document.
END_ID = 1
#: Texts within these characters are cut into words alike by both libraries
#: below, whichever Unicode version each was built with.
_RARE = re.compile("[^\x00-ɏ‐-‧]")
#: The ranks' pattern needs stack for each blank of a run; longer runs go the other way.
_BLANKS = re.compile(r"\s{256}")


def token_ids(json_path: str, ranks_path: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to ids as ``tokenizers`` gives them, nothing added.

    ``ranks_path`` may name the same vocabulary as byte-pair ranks.  Texts of
    common characters without any of the special strings are then encoded from
    the ranks, which gives the same ids in a third of the time; every other text,
    those with long runs of blanks among them, goes through ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.no_truncation()
    slow.no_padding()
    encode_slow = lambda texts: [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    if ranks_path is None:
        return encode_slow
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def plain(text: str) -> bool:
        return not (_RARE.search(text) or _BLANKS.search(text) or any(s in text for s in special))

    def encode(texts: list[str]) -> list[list[int]]:
        return [fast.encode_ordinary(t) if plain(t) else encode_slow([t])[0] for t in texts]

    return encode


def _cutter(json_path: str, ranks_path: str | None, window: int):
    def make():
        encode = token_ids(json_path, ranks_path)
        seen = np.zeros(window + 1, np.int64)  # pieces so far, by length

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth")}
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 64):
                for doc_id, ids in zip(batch.column("doc_id")[at : at + 64].to_pylist(), encode(texts[at : at + 64])):
                    data = np.array([*ids, END_ID], "<u4")
                    for start in range(0, len(data), window):
                        piece = data[start : start + window]
                        n = len(piece)
                        for column, value in zip(out, (doc_id, start, n, zlib.crc32(piece.tobytes()), len(data), int(seen[n]))):
                            out[column].append(value)
                        seen[n] += 1
            arrays = [pa.array(v, pa.int64()) for v in out.values()]
            # The partition that these rows were read in: counters start anew in each, whatever task runs it.
            task = batch.column("task")[0].as_py()
            return pa.record_batch([*arrays, pa.array([task] * len(arrays[0]), pa.int64())], names=[*out, "task"])

        return each

    return make


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long, task long"


def best_fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is nearest below ``capacity``.

    One integer is the bitset of reachable sums.  A length's copies are added
    in powers of two, and the bitset before each addition is kept, from which
    the counts are traced back.
    """
    mask, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, some = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(some, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, some = left - take, some * 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with their counts in one bin), using up the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    bins = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill(window - longest, {n: c for n, c in rest.items() if c and n <= window - longest})
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[n] // m for n, m in pattern.items())
        bins.append((times, pattern))
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return bins


def lookup_table(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """One row per pattern and length: length, first rank, first bin, copies in a bin, offset in it.

    Sorted by length and rank.  Its size depends on the window, not on the data.
    """
    rows, used, first_bin = [], {}, 0
    for times, pattern in bins:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, used.get(length, 0), first_bin, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


#: Ranks stay below this; lengths above the bits they take.
_RANK_BITS = 48


def _placer(places: np.ndarray, first_full: int, window: int):
    def make():
        keys = places[:, 0] << _RANK_BITS | places[:, 1]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            full = length == window
            sequence, offset = np.where(full, first_full + rank, 0), np.zeros(len(rank), np.int64)
            if len(places):
                at = np.maximum(np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1, 0)
                _, first_rank, first_bin, copies, start = places[at].T
                nth = rank - first_rank
                sequence = np.where(full, sequence, first_bin + nth // copies)
                offset = np.where(full, 0, start + nth % copies * length)
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            return pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        return each

    return make


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into sequences of at most ``window`` ids.

    Returns one row per piece: doc_id, start (its document's ids before it),
    length, ids_crc32, doc_tokens, sequence_id (from 0, gapless) and offset.  A
    null text counts as empty and is its end id alone; rows that repeat, doc_id
    included, are packed each; an empty table gives no rows; further columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("task"))
    pieces = scratch.write(arrow_map(light, _cutter(json_path, ranks_path, window), PIECES, "text"), "pieces", docs.count(), texts=True)
    counts = scratch.write(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts", pieces.count())
    # At most ``window`` rows reach the driver.
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    histogram.pop(window, None)
    bins = plan_bins(histogram, window)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    place = _placer(lookup_table(bins), sum(times for times, _ in bins), window)
    return arrow_map(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame) -> DataFrame:
    """``pack_documents`` with the byte-level vocabulary of the public tokenizers.

    Null and empty texts are a piece of their end id alone, repeated rows are
    packed each, tables without rows give none.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))
