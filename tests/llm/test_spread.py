"""op7, op9, op10 and the pipeline."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from lexloom.llm import embeddings, mixing, ranking, sharding

from .test_dedup import SCHEMA, brute_components, frame, text

# -- embeddings -------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 24))
    rows = [*base, *(base[i % 50] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.2]) for i in range(200)), *(base[0] + rng.normal(size=24) * 0.05 for _ in range(60)), base[1] * 3, base[1] * 3]
    x = np.array(rows, np.float32).astype(float)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = units @ units.T >= 0.95
    np.fill_diagonal(close, False)
    found = embeddings.near_duplicates(vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).collect()
    got = {r["vec_id"]: r for r in found}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert links.sum() >= 0.9 * close.sum() and (links <= close.sum(1)).all()
    root = brute_components(len(x), [tuple(p) for p in np.argwhere(close)])
    same = np.mean([got[i]["component_id"] == root[i] for i in range(len(x))])
    assert same >= 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


@pytest.mark.parametrize("dimension, shards, copies", [(64, 256, 10), (64, 4096, 15), (768, 4096, 15)])
def test_shards_hold_close_pairs_with_few_copies(monkeypatch, dimension, shards, copies):
    rng = np.random.default_rng(dimension + shards)
    n, pairs = 30_000, 3_000
    one = embeddings.unit(rng.standard_normal((n, dimension)))
    beside = rng.standard_normal((pairs, dimension))
    beside = embeddings.unit(beside - (beside * one[:pairs]).sum(1, keepdims=True) * one[:pairs])
    other = 0.95 * one[:pairs] + np.sqrt(1 - 0.95**2) * beside  # at the threshold itself
    dealer = embeddings.Dealer(one, shards * embeddings.SHARD_ROWS, 0.95, 7)
    assert len(dealer.trees) <= copies
    met = (dealer.leaves(one[:pairs]) == dealer.leaves(other)).any(1).mean()
    assert met >= 0.95
    largest = max(np.bincount(leaves).max() for leaves in dealer.leaves(one).T)
    assert largest < 6 * n / shards + 20


def test_crowded_shards_meet_block_by_block(spark, monkeypatch):
    """20,000 vectors of one dense group: no task holds more than two blocks, and every pair is counted once."""
    n = 20_000
    rng = np.random.default_rng(8)
    x = (np.array([1.0, 0, 0, 0, 0, 0]) + rng.normal(size=(n, 6)) * 0.01).astype(np.float32)
    apart = rng.normal(size=(50, 6)).astype(np.float32)
    largest = spark.sparkContext.accumulator(0, _Largest())
    whole = embeddings.shard_pairs

    def watched(units, queries, members, *more):
        largest.add(len(units))
        return whole(units, queries, members, *more)

    monkeypatch.setattr(embeddings, "shard_pairs", watched)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate([x, apart]))]
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert len(found) == n + 50
    assert all(found[i]["n_links"] >= n - 1 and found[i]["component_id"] == 0 for i in range(n))
    units = np.concatenate([x, apart]).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    close = (units[n:] @ units.T >= 0.95).sum(1) - 1
    assert [found[n + i]["n_links"] for i in range(50)] == close.tolist()
    assert sum(r["n_links"] for r in found.values()) == n * (n - 1) + 2 * close.sum() - (units[n:] @ units[n:].T >= 0.95).sum() + 50
    assert 0 < largest.value <= 2 * embeddings.SHARD_ROWS * 1.2


class _Largest(AccumulatorParam):
    def zero(self, value):
        return value

    def addInPlace(self, a, b):
        return max(a, b)


def test_trees_that_hold_too_little_are_not_used(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 40)
    monkeypatch.setattr(embeddings, "MOST_TREES", 0)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    x = np.array([*base, *(base[i % 50] + rng.normal(size=24) * 0.05 for i in range(100))], np.float32).astype(float)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = units @ units.T >= 0.95
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).collect()}
    assert [found[i] for i in range(len(x))] == (close.sum(1) - 1).tolist()


def brute_links(vectors, cosine=0.95):
    out = []
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if len(a) == len(b) and float(np.dot(a, b)) >= cosine * float(np.linalg.norm(a)) * float(np.linalg.norm(b)):
                out.append((i, j))
    return out


def test_vectors_of_all_lengths_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 30)
    rng = np.random.default_rng(2)
    base = [list(rng.normal(size=d)) for d in (2, 3, 3, 5, 16, 16, 16) for _ in range(15)]
    rows = base + [[x * 1e39 for x in v] for v in base] + [[x * 1e200 for x in v] for v in base[:20]] + [[x * 1e-200 for x in v] for v in base[:20]]
    scaled = [np.array(v) / np.abs(v).max() for v in rows]
    want = np.zeros(len(rows), int)
    pairs = brute_links(scaled)
    for i, j in pairs:
        want[i] += 1
        want[j] += 1
    docs = spark.createDataFrame([(i, [float(x) for x in v], "x", 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, h string, rep long").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(docs).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
    root = brute_components(len(rows), pairs)
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(rows))]) >= 0.95
    long = spark.createDataFrame([(i, [float(i % 3 == 0), *[1.0] * 20_000]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [r["n_links"] for r in embeddings.near_duplicates(long).collect()] == [3] * 4


AWAY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lexloom.llm import embeddings
embeddings.SHARD_ROWS = 30
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = [(i, [float((i * k) % 17 - 8) for k in range(1, 9)]) for i in range(200)]
docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
print("rows", embeddings.near_duplicates(docs).count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", AWAY, str(root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_dense_groups_are_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", 100)
    monkeypatch.setattr(embeddings, "VERIFIED", 500)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = [*(centre + 0.02 * rng.normal(size=(600, 32))), *rng.normal(size=(600, 32))]
    got = embeddings.near_duplicates(vectors(spark, [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)])).collect()
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert all(links[i] == 599 for i in range(600)) and sum(links[i] for i in range(600, 1200)) == 0


# -- sharding ---------------------------------------------------------------


def sourced(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randrange(0, 40)) if i % 17 else None, "en", rng.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(n)]
    return rows, frame(spark, [(*r, 0) for r in rows])


def test_ranks_equal_a_plain_window(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "xxhash64(id) as h").withColumn("b", sharding.F.expr("shiftright(h, 60)"))
    got = ranking.rank_in_buckets(df, ["k"], "b", [sharding.F.col("h")], "r").collect()
    for k in range(3):
        assert [r["r"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["h"])] == list(range(sum(r["k"] == k for r in got)))


@pytest.mark.parametrize("n", [0, 1, 23, 24, 700])
def test_shards(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    rows, docs = sourced(spark, n)
    got = sharding.shard_documents(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    counts = Counter(r["shard"] for r in got)
    if n >= 24:
        assert sorted(counts) == list(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    source = Counter(r["src"] for r in got)
    for s in counts:
        for name, of in source.items():
            here = sum(r["shard"] == s and r["src"] == name for r in got)
            assert abs(here - of / 24) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard_documents(docs).collect()))


def test_shards_of_repeated_rows(spark):
    got = sharding.shard_documents(frame(spark, [(1, "same", "en", "a", 0)] * 60 + [(None, None, None, None, None)] * 12)).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {3}


def test_written_shards(spark, tmp_path):
    _, docs = sourced(spark, 100)
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_written_shards_of_repeated_rows(spark, tmp_path):
    rows = [(1, "a b", "en", "s", n) for n in range(3)] + [(1, "a b", "en", "s", 0)] * 40 + [(2, "c", "en", None, 0), (None, None, None, None, None), (None, None, None, None, 7), (3, "long " * 30_000, "en", "s", 0)]
    docs = frame(spark, rows, SCHEMA + ", shard string, slot string, row string, nth long, size string, _shard long")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.columns[-1] == "__shard" and back.columns[:-1] == docs.columns
    assert Counter(map(tuple, back.drop("__shard").collect())) == Counter(map(tuple, docs.collect()))
    counts = Counter(r["__shard"] for r in back.collect())
    assert len(counts) == 4 and max(counts.values()) - min(counts.values()) <= 1
    sharding.write_shards(docs.limit(0), f"file://{tmp_path}/none", 4)


def test_order_of_shards_equals_a_plain_window(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    rows, docs = sourced(spark, 500)
    light = sharding.light_rows(docs, 11).collect()
    places = []
    for src in {r["src"] for r in light}:
        own = sorted((r for r in light if r["src"] == src), key=lambda r: (r["key"], r["doc_id"]))
        places += [((i + 0.5) / len(own), src, r["key"], r["doc_id"]) for i, r in enumerate(own)]
    want = {doc: (p * 24 // 500, p - -(-(p * 24 // 500) * 500 // 24)) for p, (*_, doc) in enumerate(sorted(places))}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs).collect()} == want


# -- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        above = {s for s in free if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        capped |= above


def taken_words(docs):
    return mixing.taken_times(*mixing.mixture(docs)).withColumn("taken", mixing.F.col("size") * mixing.F.col("times")).collect()


@pytest.mark.parametrize("n", [3000, 5900])
def test_mixture_of_repeated_rows(spark, monkeypatch, n):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 500)
    rng = random.Random(n)
    rows = [(7, "one two three four five", "en", "a", 0)] * n + [(100 + i, text(rng, rng.randrange(1, 40)), "en", rng.choice("abc"), 0) for i in range(6000 - n)]
    rows += [(8, None, "en", "c", 0), (8, "", "en", None, 0)]
    docs = frame(spark, rows)
    got, mixed = taken_words(docs), mixing.mix_documents(docs)
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for source in {r["src"] for r in got}:
        own = [r for r in got if r["src"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20
    words = Counter(r["doc_id"] for r in mixed.collect())
    assert words[7] * 5 == sum(r["taken"] for r in got if r["doc_id"] == 7)


def test_mixture_by_given_quality(spark):
    rows = [(i, "one two", "en", "ab"[i % 2], i % 4) for i in range(2000)]
    docs = frame(spark, rows)
    best = mixing.F.when(mixing.F.col("n_chars") < 2, 4.0).otherwise(1.0)
    mixed = Counter(r["doc_id"] % 4 for r in mixing.mix_documents(docs, quality=best).collect())
    assert mixed[1] > 1.5 * mixed[3] > 0


@pytest.mark.parametrize("seed", range(4))
def test_mixture(spark, monkeypatch, seed):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 40)
    rng = random.Random(seed)
    names = rng.sample(["a", "b", "Z", "é", "", None, "x", "y"], 6)
    share = [rng.choice([1, 3, 30, 200]) for _ in names]
    rows = [(i, text(rng, rng.randrange(0, 30)) if i % 19 else None, "en", rng.choices(names, share)[0], 0) for i in range(900)]
    docs = frame(spark, rows)
    got = taken_words(docs)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets({s: sizes[s] for s in {r[3] for r in rows}})
    key = lambda s: "n" if s is None else "s" + s
    assert len(got) == 900
    for s, target in want.items():
        own = [r for r in got if r["src"] == key(s)]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 15
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = taken_words(docs)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect())
    assert all(mixed[r["doc_id"]] * r["size"] == r["taken"] for r in got if r["size"])


def test_mixture_edges(spark):
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    rows = frame(spark, [(1, None, "en", None, 0), (2, "", "en", "a", 0)])
    assert [r["taken"] for r in taken_words(rows)] == [0, 0]
    clash = frame(spark, [(1, "a b", "en", "s", 0)], SCHEMA + ", src string, size long, key double, draw long, target double, cut string")
    assert mixing.mix_documents(clash).columns == clash.columns


# -- pipeline ---------------------------------------------------------------


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        assert 0 < docs.count() <= before, name
        before = docs.count()
    out = corpus_pipeline.run(spark, tables)
    assert out.count() >= out.select("doc_id").distinct().count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c"), (1, None), (1, None), (2, ""), (2, "x y z"), (2, "x y z"), (3, "x  y z"), (4, "long " * 30_000), (5, "long " * 30_000 + "er")]])
def test_stages_on_odd_rows(spark, tables, rows):
    import corpus_pipeline

    extra = ", row string, raw long, src string, key double, shingles string, print long, u long, component_id long, times int, x string"
    docs = frame(spark, rows, SCHEMA + extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == docs.columns, name
        assert out.count() <= 3 * len(rows) + 400, name
    if rows:
        exact = corpus_pipeline.STAGES[1][1](spark, docs, tables).collect()
        assert len({(r["text"] or "").replace(" ", "") for r in exact}) == len(exact) == 5
        near = corpus_pipeline.STAGES[2][1](spark, docs, tables)
        assert near.filter("doc_id = 4").count() == 1


def test_pipeline_stages_take_effect(spark):
    """Every stage's decisions on the small tables, against brute force where there is one."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r["doc_id"] for r in corpus_pipeline.good(spark, docs, sf).collect()}
    wrong = [d for d, q in labels.items() if (d in good) != (q == 1)]
    assert len(wrong) <= 0.02 * len(labels)
    distinct = corpus_pipeline.distinct(spark, docs, sf).collect()
    bare = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    everything = {bare(r["text"]) for r in docs.collect()}
    assert len(distinct) == len(everything) == len({bare(r["text"]) for r in distinct})
