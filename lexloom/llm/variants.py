"""Spelling variants: words of a corpus one edit apart, and the form that each stands for.

Near words come from a prefix filter on positional bigrams.  All bigrams are
ordered by how many words hold them, rarest first.  An edit touches two bigrams at
most, so of a word's three rarest one survives in each near word and is among
that one's three rarest, too; bigrams that repeat the third are kept with it, so
that equal ones at several places cannot push each other out.

Beside a bigram that survives, the edit lies in front of it or behind it.  The
other side, position included, is equal in both words: counted from the start or
from the end.  Of the side that holds the edit one half is equal, the first or
the last.  A key is a bigram, the equal side and the equal half, for the length
of the shorter word; so words that meet in a key differ within a quarter of
their characters or so, and few that meet are not near.  All are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map, slices
from .scratch import Scratch, small, table
from .sql import CRC_TABLE, crc32

#: Shortest words, and fewest occurrences, that count as a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Of the hashes of occurrences, one in so many loses a character.
NOISE = 199
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
#: Bigrams of a word that are joined, one more than an edit can touch.
RAREST = 3
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 500_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences in all of ``docs`` (doc_id, text), words under ``least_length`` left out.

    Words are runs of letters from A to Z and U+00C0 to U+00FF, lower-cased from A
    to Z.  A run whose hash with its doc_id NOISE divides loses one character.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def tell(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in Counter(runs.findall((text or b"").translate(_LOWER).decode(errors="replace"))).items():
                        h = zlib.crc32(run.encode(), before)
                        if h % NOISE == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield tell(held)
                    held = Counter()
        if held:
            yield tell(held)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keys_of(word: str, order: dict[str, tuple[int, str]]) -> Iterator[tuple]:
    """The keys of a word; ``order`` has the place of every bigram, rarest first."""
    n = len(word)
    places = [order[word[p : p + 2]] for p in range(n - 1)]
    third = sorted(places)[RAREST - 1] if n > RAREST else max(places, default=None)
    for p, place in enumerate(places):
        if place > third:
            continue
        for shorter in (n, n - 1):
            # Equal up to the bigram, which ends here in both; behind it, equal up to the cut or from the cut on.
            end = p + 2
            if end <= shorter:
                cut = end + (shorter - end + 1) // 2
                yield "before, first half", shorter, p, word[:cut]
                yield "before, last half", shorter, p, word[:end], word[n - (shorter - cut) :]
            # Equal from the bigram on, which begins so many characters before the end.
            rest = n - p
            if rest <= shorter:
                cut = (shorter - rest) // 2
                yield "after, first half", shorter, rest, word[:cut], word[p:]
                yield "after, last half", shorter, rest, word[n - (shorter - cut) :]


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, n_a, b, n_b) of all ``words`` (word, n; distinct, three characters or more) one edit apart, a before b."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    # As many rows as the alphabet has pairs of letters: 90 x 90 at most.
    order = {g: (n, g) for g, n in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, at = [], []
            words = batch.column("word").to_pylist()
            for i, word in enumerate(words):
                own = [xxhash.xxh3_64_intdigest(repr(k)) for k in keys_of(word, order)]
                keys += own
                at += [i] * len(own)
            return pa.record_batch([pa.array(keys, pa.uint64()).view(pa.int64()), *(batch.column(c).take(pa.array(at, pa.int32())) for c in ("word", "n"))], names=["key", "word", "n"])

        return each

    keyed = scratch.write(arrow_map(words.select("word", "n"), make, "key long, word string, n long"), "keys")
    left, right = (keyed.select("key", F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    near = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "n_a", "b", "n_b").distinct()


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the form that has none itself.

    Each round doubles the steps followed.  Forms grow by RATIO a step, so a chain
    is no longer than the logarithm of the largest count, and rounds are few.
    """
    roots = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    for turn in range(1, 64):
        ahead = small(roots.select(F.col("word").alias("_word"), F.col("root").alias("_root")))
        moved = roots.join(ahead, roots["root"] == ahead["_word"], "left")
        if moved.filter("_root is not null").isEmpty():
            return roots
        roots = scratch.write(moved.select("word", F.coalesce("_root", "root").alias("root")), f"roots-{turn}")
    raise RuntimeError("forms lead round in a circle")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``docs`` (doc_id, text).

    A word's form is its near word of largest n, the first in code-point order
    among equals, if that n is at least RATIO times its own.  Null and empty
    texts have no words; a null doc_id counts as an empty one; rows that repeat
    count each; empty tables give no rows; further columns are ignored.
    """
    if least_length <= RAREST:
        raise ValueError(f"words need more than {RAREST} characters")
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.write(count_words(docs, least_length).filter(F.col("n") >= least_count), "words")
    pairs = scratch.write(near_pairs(words, scratch), "pairs")
    scratch.drop("keys")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("own"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("w")).alias("other")).unionAll(
        pairs.select("b", "n_b", F.struct(-F.col("n_a"), F.col("a")))
    )
    best = both.groupBy("word", "own").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    holds = -F.col("best.n") >= RATIO * F.col("own")
    known = scratch.write(best.select("word", "n_near", F.when(holds, F.col("best.w")).alias("form"), F.when(holds, -F.col("best.n")).alias("form_n")), "known")
    roots = follow(known.filter("form is not null"), scratch)
    found = words.join(known.join(roots, "word", "left"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Words are near if one is the other without a character, or both are equal without that at one place.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM d, crc_table),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
x AS (SELECT word, n, word AS variant, -1 AS i FROM v UNION ALL
  SELECT word, n, substr(word, 1, i) || substr(word, i + 2), i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.variant = b.variant AND a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
b AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS most FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN best END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN s ON s.word = f.word JOIN f l ON l.word = s.root AND l.form IS NULL
"""
