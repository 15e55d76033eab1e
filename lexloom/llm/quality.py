"""Quality classifier: histogram gradient-boosted trees over text statistics.

A pass over whole texts writes a row of statistics per document.  The trees are
grown in numpy on a bounded sample of labelled rows, from histograms of binned
statistics, and flattened into complete-tree arrays; scoring walks all trees
for a whole batch at once, one array lookup per level.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map
from .scratch import Scratch, sampled, table, temporary, without

#: Labelled rows that are learned from at most, by a hash of doc_id.
TRAIN_ROWS = 20_000
#: A document counts as good from this score on.
GOOD = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "capitals", "digits", "spaces", "symbols", "high_bytes",
    "symbols_per_word", "capital_words", "distinct_words", "top_word", "repeats_previous", "distinct_lines",
    "words_per_line", "full_stops", "entropy", "compressed", "top_symbol",
)
_KINDS = np.zeros(256, np.int64)  # 0: control and the rest
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 6
_KINDS[[9, 10, 11, 12, 13, 32]] = 4
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_ODD = np.array([c for c in range(33, 127) if _KINDS[c] == 5 and chr(c) not in ".,"])


def statistics(text: str) -> list[float]:
    """The row of FEATURES of one whole text; zeros for an empty one."""
    data = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, n_words = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    _, lower, upper, digits, spaces, symbols, high = np.bincount(_KINDS, counts, 7).tolist()
    shares = counts[counts > 0] / n
    lines = [x for x in text.split("\n") if x]
    frequent = Counter(words)
    odd = counts[_ODD]
    return [
        np.log1p(n), np.log1p(n_words), (n - spaces) / n_words, (lower + upper) / n, upper / (lower + upper + high + 1),
        digits / n, spaces / n, symbols / n, high / n, symbols / n_words,
        sum(map(str.isupper, words)) / n_words, len(frequent) / n_words, max(frequent.values()) / n_words,
        sum(map(operator.eq, words, words[1:])) / n_words, len(set(lines)) / max(1, len(lines)),
        n_words / max(1, len(lines)), counts[46] / n_words, float(-(shares * np.log2(shares)).sum()),
        len(zlib.compress(data, 1)) / n, odd.max() / n_words,
    ]


def _describe():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t or "") for t in batch.column("text").to_pylist()]
        values = pa.FixedSizeListArray.from_arrays(pa.array(np.array(rows, np.float64).ravel()), len(FEATURES))
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.record_batch([*kept, values.cast(pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"])

    return each


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, raw (a hash of the text) and x, the statistics, for every row."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    return arrow_map(light, _describe, "doc_id long, raw long, x array<double>", "text")


@dataclass
class Forest:
    """Complete trees of one depth: node i of a tree has children 2i+1 and 2i+2."""

    prior: float
    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray  # (trees, inner nodes): values above it go right
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows ``x``; every level is one lookup over all trees."""
        if not len(self.feature):
            return np.full(len(x), self.prior)
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        inner = self.feature.shape[1]
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.bound[trees, node])
        margin = np.log(self.prior / (1 - self.prior)) + self.value[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Forest:
    """Boost ``trees`` on logistic loss.

    Without rows nothing was learned and every score is 1, so nothing is
    rejected; with one class only, every score is near that class.
    """
    inner = 2**depth - 1
    empty = np.zeros((0, inner))
    if not len(y):
        return Forest(1.0, empty, empty, empty)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if y.min() == y.max():
        return Forest(prior, empty, empty, empty)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin = np.full(n, np.log(prior / (1 - prior)))
    feature, bound, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            wide = 2**level
            best, split = np.full(wide, 1e-6), np.full((wide, 2), -1)
            for f in range(width):
                cell = node * bins + binned[:, f]
                g = np.bincount(cell, grad, wide * bins).reshape(wide, bins).cumsum(1)
                h = np.bincount(cell, hess, wide * bins).reshape(wide, bins).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < 1) | (all_h - h < 1)] = 0
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                better = gain[np.arange(wide), at] > best
                best = np.where(better, gain[np.arange(wide), at], best)
                split[better] = np.stack([np.full(wide, f), at], 1)[better]
            first = wide - 1
            right = np.zeros(n, bool)
            for k in range(wide):
                f, at = split[k]
                if f >= 0:
                    feature[t, first + k], bound[t, first + k] = f, edges[f][at]
                    here = node == k
                    right[here] = x[here, f] > edges[f][at]
            node = 2 * node + right
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        value[t] = rate * g / (h + ridge)
        margin += value[t][node]
    return Forest(prior, feature, bound, value)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, raw, held_out and score for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) of rows that are not held out, at
    most ``train_rows`` of them.  Null and empty texts are scored by statistics
    of zero; labels that are null are ignored, and of several for one doc_id the
    lowest counts; rows that repeat are scored alike; empty tables give no rows;
    further columns are ignored.
    """
    return _scored(docs, labels, train_rows)[0]


def _scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, int]:
    """The result of ``score_quality``, and the number of rows."""
    n = docs.count()
    described = Scratch(docs.sparkSession, "quality").write(describe(docs), "described", n, texts=True)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(~held_out())
    # Bounded by train_rows, of some 200 bytes each: rows that repeat count once.
    rows = described.join(known, "doc_id").select("x", "quality", "doc_id", "raw").dropDuplicates(["doc_id", "raw"])
    rows = Scratch(docs.sparkSession, "labelled").write(rows, "rows")
    rows = sampled(rows, F.xxhash64("doc_id", "raw"), train_rows, rows.count()).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["raw"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    forest = train(x, np.array([float(r["quality"] > 0) for r in rows]))

    def scorer():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            kept = [batch.column(c) for c in ("doc_id", "raw", "held_out")]
            return pa.record_batch([*kept, pa.array(forest.score(x))], names=["doc_id", "raw", "held_out", "score"])

        return each

    marked = described.select("doc_id", "raw", held_out().alias("held_out"), "x")
    return arrow_map(marked, scorer, "doc_id long, raw long, held_out boolean, score double"), n


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score below GOOD, in their own columns.

    Null and empty texts are scored like others; rows that repeat stay or go
    together; without labels every row stays; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "rejected")
    with temporary():
        scored, n = _scored(docs, labels)
        bad = scored.filter(F.col("score") < GOOD)
        bad = scratch.write(bad.select("doc_id", "raw").distinct(), "rows", n)
    return without(docs, bad, doc_id=F.col("doc_id").cast("long"), raw=F.xxhash64("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document scored."""
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
