"""op1, op2 and op3 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexloom.llm import components, exact_dedup, quotient, simhash, substring
from lexloom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "r s t n lo mi za".split()]


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).repartition(3)


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            least = min(root[i], root[j])
            if root[i] != least or root[j] != least:
                root[i] = root[j] = least
                changed = True
    return root


# -- quotient filters -------------------------------------------------------


@pytest.mark.parametrize("bits", [0, 1, 5, 9])
@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_filter_round_trip(bits, n):
    rng = np.random.default_rng(n + bits)
    shard = int(rng.integers(0, 1 << bits)) if bits else 0
    low = rng.integers(0, 2**62, n, dtype=np.uint64) % np.uint64(2 ** (64 - bits) - 1 if bits else 2**62)
    low[: n // 3] = np.uint64(7) + np.arange(n // 3, dtype=np.uint64) % np.uint64(50)  # a crowded run
    prints, counts = np.unique(low | (np.uint64(shard) << np.uint64(64 - bits) if bits else np.uint64(0)), return_counts=True)
    counts = counts * rng.choice([1, 254, 255, 70_000], len(counts))
    found, n_found = quotient.read(quotient.build(prints, counts, bits), shard, bits)
    assert np.array_equal(found, prints) and np.array_equal(n_found, counts)


def test_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 500, 5000).astype(np.uint64) << np.uint64(40)
    parts = [np.unique(p, return_counts=True) for p in np.array_split(rows, 7)]
    decoded = [quotient.read(quotient.build(p, c, 0), 0, 0) for p, c in parts]
    found, counts = quotient.merge(decoded)
    want, n = np.unique(rows, return_counts=True)
    assert np.array_equal(found, want) and np.array_equal(counts, n)


# -- exact dedup ------------------------------------------------------------


def test_merged_filters_lose_nothing():
    rng = np.random.default_rng(12)
    bits, shard = 3, 5
    rows = [rng.integers(0, 400, 300).astype(np.uint64) * np.uint64(2**52 + 12345) % np.uint64(2**61) | np.uint64(shard) << np.uint64(61) for _ in range(6)]
    filters = [quotient.build(*np.unique(r, return_counts=True), bits) for r in [*rows, rows[0][:0]]]
    prints, counts = quotient.read(quotient.merge_filters(filters, shard, bits), shard, bits)
    want = np.unique(np.concatenate(rows), return_counts=True)
    assert (prints == want[0]).all() and (counts == want[1]).all()
    assert len(quotient.read(quotient.merge_filters([filters[-1]], shard, bits), shard, bits)[0]) == 0


def test_tables_of_a_stage_are_deleted(spark, tmp_path, monkeypatch):
    from lexloom.llm import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")

    rng = random.Random(2)
    docs = frame(spark, [(i, text(rng, 30)) for i in range(30)] + [(50, "same"), (51, "same")])
    kept = scratch.Scratch(spark, "kept")
    with scratch.temporary():
        out = kept.write(simhash.keep_representatives(exact_dedup.keep_first_copies(docs)), "out")
    left = list(tmp_path.rglob("*.parquet"))
    assert left and all("/kept-" in str(p) for p in left) and out.count() == 31


def test_exact_dedup(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, 5)) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1].replace(" ", rng.choice([" ", "\n", "  ", "\t"]))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "x" * 200_000), (204, "x" * 200_000), (205, "é e"), (206, "é e"), (300, "same"), (300, "same")]
    got = {r["doc_id"]: r for r in exact_dedup.dedup_exact(frame(spark, rows)).collect()}
    assert len(got) == len({r[0] for r in rows})
    groups = {}
    for doc_id, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), doc_id))
    for norm, members in groups.items():
        for _, doc_id in members:
            row = got[doc_id]
            assert (row["keep_id"], row["group_size"], row["kept"]) == (min(members)[1], len(members), doc_id == min(members)[1])
    kept = exact_dedup.keep_first_copies(frame(spark, rows)).collect()
    assert len(kept) == len(groups)
    assert {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept} == set(groups)


def test_exact_dedup_nulls_and_empty(spark):
    assert exact_dedup.dedup_exact(frame(spark, [])).count() == 0
    rows = exact_dedup.dedup_exact(frame(spark, [(None, "a"), (5, "a"), (None, "b")])).collect()
    assert sorted((r["keep_id"] is None, r["group_size"]) for r in rows) == [(False, 2), (False, 2), (True, 1)]


def test_extra_columns(spark):
    df = frame(spark, [(1, "a b"), (2, "a b")], SCHEMA + ", raw long, print long, sha string, keep_id long, _id long, _text long, rank int")
    assert exact_dedup.dedup_exact(df).count() == 2
    assert exact_dedup.keep_first_copies(df).columns == df.columns
    assert simhash.keep_representatives(df).columns == df.columns


# -- components -------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(50)]
    links = [(u, v) for u, v in links if u != v]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long").repartition(5), Scratch(spark, "test")).collect())
    root = brute_components(3000, links)
    assert got == {n: root[n] for n in {x for link in links for x in link}}


# -- simhash ----------------------------------------------------------------


def brute_print(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("t", ["", " ", "One", "one TWO", "É Ä three four", "a a a a a", "x " * 700])
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 20)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(11)
    rows = []
    for i in range(160):
        base = text(rng, rng.choice([30, 120, 300]))
        rows.append((len(rows), base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = base.split()
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "one"), (len(rows) + 3, "ONE")]
    prints = [brute_print(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    root = brute_components(len(rows), linked)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(rows))] == prints
    assert [got[i]["component_id"] for i in range(len(rows))] == root


def test_spanning_forest_has_least_distances():
    rng = random.Random(3)
    for _ in range(50):
        links = [(u, v, rng.randrange(8)) for u in range(12) for v in range(u + 1, 12) if rng.random() < 0.3]
        u, v, d = (np.array(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 3
        chosen = simhash.spanning(u, v, d)
        for bound in range(8):  # the forest connects what the links up to any distance connect
            want = brute_components(12, [(a, b) for a, b, c in links if c <= bound])
            assert brute_components(12, [(int(u[i]), int(v[i])) for i in chosen if d[i] <= bound]) == want
        assert len(chosen) == 12 - len(set(brute_components(12, [(a, b) for a, b, _ in links])))


def test_similar_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 30)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(12)
    rows = []
    for i in range(120):
        base = text(rng, rng.choice([60, 200, 400]))
        rows.append((len(rows), base))
        for edits in ([], [1], [3], [1, 2, 20])[i % 4]:
            words = base.split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "one"), (len(rows) + 3, "ONE"), (None, rows[0][1])]
    sets = []
    for _, t in rows[:-1]:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: (len(a & b) / len(a | b) if a | b else 1) >= 0.8
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    root = brute_components(len(sets), linked)
    got = dict(simhash.similar_documents(frame(spark, rows)).collect())
    found = sum(got.get(i, i) == root[i] for i in range(len(sets)) if root[i] != i)
    assert found >= 0.9 * sum(root[i] != i for i in range(len(sets)))
    assert all(root[i] == root[c] for i, c in got.items())
    kept = [r["doc_id"] for r in simhash.keep_representatives(frame(spark, rows)).collect()]
    assert set(range(len(sets))) - set(kept) == {i for i, c in got.items() if i != c} and None in kept


def test_shard_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    values = np.concatenate([values, values[:800] ^ (np.uint32(1) << rng.integers(0, 32, 800).astype(np.uint32))])
    rows, shards = simhash.route(values, simhash.grow(values[:2000], 40))
    at = [set() for _ in values]
    for r, s in zip(rows.tolist(), shards.tolist()):
        at[r].add(s)
    assert len(set(shards.tolist())) > 10
    assert all(at[i] & at[3000 + i] for i in range(800))


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = simhash.near_duplicates(frame(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c")])).collect()
    assert [r["component_id"] for r in rows] == [7, 7, 7]


def test_exact_dedup_of_repeated_ids(spark):
    rows = [(7, "a b"), (7, "ab"), (8, "a b"), (9, "x y", "en"), (9, "x y", "de"), (9, "xy "), (9, " xy"), (10, None), (10, ""), (None, "q"), (None, "q"), (11, "alone"), (11, "other")]
    docs = frame(spark, rows)
    kept = exact_dedup.keep_first_copies(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept if r["doc_id"] != 9) == [(0, "q"), (7, "a b"), (10, ""), (11, "alone"), (11, "other")]
    assert [r["doc_id"] for r in kept].count(9) == 1
    decided = exact_dedup.dedup_exact(docs).collect()
    assert len(decided) == len(rows) and len({(r["doc_id"], r["raw"]) for r in decided if r["kept"]}) == 6
    alike = frame(spark, [(1, "same text", "en", "s", n % 7) for n in range(500)])
    assert exact_dedup.keep_first_copies(alike).count() == 1


# -- substring --------------------------------------------------------------


def test_chains_prefer_order():
    assert substring.chains([1, 4, 9, 12], [11, 14, 19, 22]) == [(0, 3)]
    crossed = substring.chains([1, 5, 10], [300, 5, 10])
    assert sorted(crossed) == [(0, 0), (1, 2)]


def test_chain_scores_match_quadratic():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 40)
        pos = sorted(rng.sample(range(200), n))
        other = [rng.randrange(200) for _ in range(n)]
        best = [0.0] * n
        for i in range(n):
            gains = [best[j] - substring.GAP * (pos[i] - pos[j] + other[i] - other[j]) for j in range(i) if pos[j] < pos[i] and other[j] < other[i]]
            best[i] = substring.WORTH + max([0.0, *gains])
        top = max(range(n), key=lambda i: best[i])
        first, last = next(c for c in substring.chains(pos, other) if c[1] == top or best[c[1]] == best[top])
        assert pos[first] <= pos[last] and other[first] <= other[last]


def test_align_over_edits():
    a = np.arange(100)
    b = np.concatenate([np.arange(500, 510), np.arange(20), [999], np.arange(21, 60), np.arange(63, 100), np.arange(700, 720)])
    whole = lambda words: substring.Slice(words, 0, len(words))
    start, end, o_start, o_end, agreed, n = substring.align(whole(a), whole(b), 30, 40)
    assert (start, end, o_start, o_end) == (0, 100, 10, 107) and agreed == 96 and n == 100
    assert substring.align(substring.Slice(a[:60], 0, 100), whole(b), 30, 40) is None
    assert substring.align(whole(a), substring.Slice(b[20:], 20, len(b)), 30, 20) is None


def test_packed_columns_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1000):
        columns = [np.sort(rng.integers(0, 2**64, n, np.uint64)), rng.integers(-(2**63), 2**63, n, np.int64), rng.integers(0, 50, n)]
        assert all((a.view(np.int64) == b).all() for a, b in zip(columns, substring.unpack(substring.pack(columns))))


def held_passages(rows):
    """The places of every MIN_WORDS words that several documents hold."""
    places = {}
    for doc, t in rows:
        words = (t or "").lower().split()
        for at in range(len(words) - substring.MIN_WORDS + 1):
            places.setdefault(tuple(words[at : at + substring.MIN_WORDS]), []).append((doc, at))
    return [p for p in places.values() if len({d for d, _ in p}) > 1]


def family(rng):
    """Texts that share passages whole, in fragments, several times over, and long ones."""
    rows = []
    put = lambda *parts: rows.append((len(rows), " ".join(parts)))
    own = lambda a=5, b=60: text(rng, rng.randrange(a, b))
    for _ in range(6):  # fragments come before, between and after whole passages
        passage = text(rng, rng.choice([50, 51, 60, 75, 120])).split()
        for _ in range(8):
            a = rng.randrange(0, len(passage) - 20)
            put(own(), *passage[a : a + rng.randrange(20, 50)], own())
            if rng.random() < 0.5:
                put(own(), *passage, own())
    common = text(rng, 45)
    for _ in range(12):  # one fragment in many texts, some of which share more around it
        put(own(), common, own())
    tail, lead = text(rng, 9), text(rng, 7)
    for _ in range(4):
        put(own(), common, tail, own())
        put(own(), lead, common, own())
        put(own(), common, own(), common, tail, own())  # twice in one text
    line = text(rng, 6)
    for n in (12, 20, 33):  # texts that repeat themselves, at other lengths
        put(own(), *[line] * n, tail, own())
        put(*[line] * n)
    long = text(rng, 900)
    put(own(), long), put(own(), long, own()), put(*long.split()[300:700])
    put(*[w if i % 30 else "changed" for i, w in enumerate(long.split())])
    for _ in range(30):
        put(own(40, 90))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, task_keys", [(1, 10**6), (2, 10**6), (3, 300), (6, 10**6)])
def test_passages_match_brute_force(spark, monkeypatch, partitions, task_keys):
    monkeypatch.setattr(substring, "TASK_KEYS", task_keys)
    monkeypatch.setattr(substring, "REACH", 66)
    monkeypatch.setattr(substring, "MORE", 2)
    rows = family(random.Random(77))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = substring.passages(docs).collect()
    words = {doc: t.lower().split() for doc, t in rows}
    for r in found:
        assert r["doc_id"] != r["source_doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8
        assert words[r["doc_id"]][r["start_word"]] == words[r["source_doc_id"]][r["source_start"]]
    held = held_passages(rows)
    assert len(held) > 1000
    for places in held:  # through passages that hold these words on both sides all their holders are connected
        holders = sorted({d for d, _ in places})
        inside = lambda d, a, z: any(doc == d and a <= at and at + 50 <= z for doc, at in places)  # noqa: B023, E731
        links = [
            (holders.index(r["doc_id"]), holders.index(r["source_doc_id"]))
            for r in found
            if r["doc_id"] in holders and r["source_doc_id"] in holders
            and inside(r["doc_id"], r["start_word"], r["end_word"]) and inside(r["source_doc_id"], r["source_start"], r["source_end"])
        ]
        assert set(brute_components(len(holders), links)) == {0}, (holders, places)


def test_passages_of_odd_rows(spark):
    rng = random.Random(5)
    shared, other = text(rng, 60), text(rng, 30_000)
    rows = [(1, f"{shared} {text(rng, 10)}"), (1, f"{shared} {text(rng, 10)}"), (2, shared), (2, shared), (2, text(rng, 80)), (3, other), (4, f"{other} end"), (None, shared), (5, None), (6, "  ")]
    clash = frame(spark, rows, SCHEMA + ", node long, pos long, words string, key long, a string, first long, bucket long, data binary, again long")
    found = substring.passages(clash).collect()
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in found}
    assert {d for p in pairs for d in p} == {1, 2, 3, 4} and {(3, 4), (4, 3)} & pairs
    assert max(r["end_word"] - r["start_word"] for r in found) == 30_000
    left = substring.without_passages(clash, substring.passages(clash))
    assert left.columns == clash.columns and left.count() == len(rows)


def test_passages(spark):
    rng = random.Random(21)
    shared = text(rng, 70)
    fuzzy = shared.split()
    fuzzy[20], fuzzy[45:47] = "changed", []
    rows = [(i, text(rng, 120)) for i in range(30)]
    rows[3] = (3, f"{text(rng, 20)} {shared} {text(rng, 30)}")
    rows[9] = (9, f"{shared} {text(rng, 30)}")
    rows[14] = (14, f"{text(rng, 60)} {' '.join(fuzzy)}")
    rows[20] = (20, f"{text(rng, 10)} {' '.join(shared.split()[:40])} {text(rng, 40)}")  # too short
    rows += [(50, None), (51, ""), (None, shared), (52, "few words")]
    found = substring.passages(frame(spark, rows)).collect()
    assert sorted({r["doc_id"] for r in found}) == [9, 14]
    row = next(r for r in found if r["doc_id"] == 9)
    assert (row["source_doc_id"], row["start_word"], row["end_word"], row["source_start"], row["source_end"]) == (3, 0, 70, 20, 90)
    row = next(r for r in found if r["doc_id"] == 14)
    assert row["start_word"] == 60 and row["end_word"] == 128 and 0.8 <= row["identity"] < 1
    cut = {r["doc_id"]: r["text"] for r in substring.without_passages(frame(spark, rows), substring.passages(frame(spark, rows))).collect()}
    assert len(cut[9].split()) == 30 and len(cut[3].split()) == 120 and cut[50] is None
    assert substring.passages(frame(spark, [])).count() == 0


def test_fuzzy_passage_whose_seeds_others_hold_too(spark):
    """Each seed has a first holder, and one between the two texts, of its own."""
    rng = random.Random(3)
    passage = [f"s{rng.randrange(10**6)}" for _ in range(80)]
    changed = [f"x{i}" if i % 16 == 10 else w for i, w in enumerate(passage)]
    rows = [(1000, f"{text(rng, 20)} {' '.join(passage)}"), (3000, f"{' '.join(changed)} {text(rng, 20)}")]
    for i in range(76):
        rows += [(n + i, f"{text(rng, 60)} {' '.join(passage[i : i + 5])} {text(rng, 60)}") for n in (1, 2000)]
    found = substring.passages(frame(spark, rows).repartition(1)).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in found] == [(3000, 1000)]


def test_passages_of_a_hot_holder(spark, monkeypatch):
    """A document that all others share a passage with meets them in several tasks; the rows are the same."""
    rng = random.Random(21)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(70)]
    rows = []
    for i in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        words = list(shared)
        words[rng.randrange(20, 50)] = f"x{i}"
        rows.append((i, " ".join(own + words if i % 2 else words + own)))
    docs = frame(spark, rows)
    sent = sorted(map(tuple, substring.passages(docs).collect()))
    monkeypatch.setattr(substring, "SENT_IDS", 0)
    monkeypatch.setattr(substring, "SALT_ROWS", 3)
    assert sorted(map(tuple, substring.passages(docs).collect())) == sent
    assert {r[0] for r in sent} == set(range(1, 40))


@pytest.mark.parametrize("parts", [[(0, 45)], [(8, 53)], [(0, 30), (30, 60)], [(0, 48), (12, 60)]])
def test_passage_with_partial_first_holders(spark, parts):
    rng = random.Random(str(parts))
    trials, rows = 30, []
    for t in range(trials):
        passage = text(rng, 60).split()
        for n, (a, b) in enumerate(parts):
            rows.append((10 * t + n, f"{text(rng, 80)} {' '.join(passage[a:b])} {text(rng, 80)}"))
        for n in (8, 9):
            rows.append((10 * t + n, f"{text(rng, 80)} {' '.join(passage)} {text(rng, 80)}"))
    found = substring.passages(frame(spark, rows)).filter("doc_id % 10 = 9 and source_doc_id % 10 = 8 and end_word - start_word >= 58")
    assert found.select("doc_id").distinct().count() == trials


@pytest.mark.parametrize("words, edits, least", [(60, 6, 0.95), (80, 8, 0.95), (80, 12, 0.9)])
def test_fuzzy_passages_recall(spark, words, edits, least):
    rng = random.Random(words + edits)
    trials, rows = 60, []
    for t in range(trials):
        passage = text(rng, words).split()
        rows.append((2 * t, f"{text(rng, 80)} {' '.join(passage)} {text(rng, 80)}"))
        for at in rng.sample(range(words), edits):
            passage[at] = f"changed{at}"
        rows.append((2 * t + 1, f"{text(rng, 80)} {' '.join(passage)} {text(rng, 80)}"))
    found = substring.passages(frame(spark, rows)).filter("doc_id = source_doc_id + 1 and identity >= 0.8")
    assert found.select("doc_id").distinct().count() >= least * trials


def test_copies_of_texts_that_repeat_themselves(spark):
    rng = random.Random(8)
    line = text(rng, 7)
    rows = [(1, "same " * 90), (2, "same " * 90), (3, f"{text(rng, 30)} {' '.join([line] * 20)} end"), (4, text(rng, 90))]
    rows += [(5, rows[2][1]), (6, f"{text(rng, 60)} {' '.join([line] * 40)}")]
    found = [tuple(r)[:6] for r in substring.passages(frame(spark, rows)).collect()]
    by = {(doc, other): [] for doc, *_, other, _, _ in found}
    for doc, start, end, other, _, _ in found:
        by[doc, other].append((start, end))
    assert set(by) == {(2, 1), (5, 3), (6, 3)}
    assert by[2, 1] == [(0, 90)] and by[5, 3] == [(0, 171)]
    assert {w for start, end in by[6, 3] for w in range(start, end)} >= set(range(60, 340)) and len(by[6, 3]) < 8


def test_covering_keeps_all_words():
    rng = random.Random(3)
    for _ in range(50):
        spans = sorted({(a := rng.randrange(200), a + rng.randrange(1, 60)) for _ in range(rng.randrange(1, 40))}, key=lambda s: (s[0], -s[1]))
        kept = [spans[i] for i in substring.covering(spans)]
        assert {w for s in kept for w in range(*s)} == {w for s in spans for w in range(*s)}
        assert all(a[1] < c[0] for a, c in zip(kept, kept[2:]))


def test_similar_short_documents(spark):
    rng = random.Random(12)
    rows = []
    for n in (8, 9, 10, 12, 15):
        for _ in range(20):
            t = text(rng, n)
            rows += [(len(rows), t), (len(rows) + 1, f"{t} {text(rng, 1)}")]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = {i: c for i, c in enumerate(brute_components(len(rows), linked)) if any(i in pair for pair in linked)}
    assert len(linked) >= 100
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, rows)).collect()} == want


def test_similar_documents_of_a_family(spark):
    rng = random.Random(31)
    rows = []
    for size, variants in ((60, 60), (200, 30)):
        base = text(rng, size).split()
        rows.append((len(rows), " ".join(base)))
        for _ in range(variants):
            own = list(base)
            for at in rng.sample(range(size), size // 60):
                own[at] = text(rng, 1)
            rows.append((len(rows), " ".join(own)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = brute_components(len(rows), linked)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, rows)).collect()}
    same = [got.get(i, i) == want[i] for i in range(len(rows))]
    assert sum(same) >= 0.95 * len(rows)


def test_similar_documents_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SALT_ROWS", 3)
    rng = random.Random(9)
    one, two = text(rng, 80), text(rng, 80)
    near = f"{one} more"
    rows = [(7, one), (7, two), (7, two), (8, near), (9, f"{two} more"), (10, text(rng, 80)), (None, one), *((20 + i, f"{one} {text(rng, 1)}") for i in range(12))]
    docs = frame(spark, rows, SCHEMA + ", node long, again long, salt long, salts long")
    kept = simhash.keep_representatives(docs).collect()
    texts = Counter(r["text"] for r in kept)
    assert texts[None] == 0 and sum(near in t or one in t for t in texts) <= 2  # with the row without an id
    assert sum(two in t for t in texts) == 1 and rows[5][1] in texts


@pytest.mark.parametrize("near, parts", [(3, 2), (7, 4)])
def test_crowded_shards_lose_no_link(spark, monkeypatch, near, parts):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    rng = np.random.default_rng(near)
    # Half of the prints share their lower half within a bit; some of them differ in few upper bits.
    low = np.uint64(0x1234567) ^ (np.uint64(1) << rng.integers(0, 32, 700).astype(np.uint64))
    high = rng.integers(0, 2**32, 700).astype(np.uint64)
    for i in range(0, 200, 2):
        high[i + 1] = high[i] ^ (np.uint64(1) << np.uint64(rng.integers(0, 32)))
    prints = np.unique(np.concatenate([low | high << np.uint64(32), rng.integers(0, 2**63, 700).astype(np.uint64)]))
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = brute_components(len(prints), [tuple(x) for x in np.argwhere(distance <= near)])
    rows = [(0, int(p), i) for i, p in enumerate(prints.view(np.int64))]
    distinct = spark.createDataFrame(rows, "signature long, print long, rep long")
    links = [tuple(r) for r in simhash.print_links(distinct, near, parts, Scratch(spark, "t")).collect()]
    assert all(distance[u, v] <= near for u, v in links)
    assert brute_components(len(prints), links) == want


def test_routed_copies_do_not_grow_with_the_rows():
    """Near prints around a few hundred centres: copies of each that shards are sent, over all parts."""
    rng = np.random.default_rng(5)
    noise = (rng.random((60_000, 64)) < 0.2) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    prints = (rng.integers(0, 2**63, 300).astype(np.uint64)[rng.integers(0, 300, 60_000)] ^ noise).view(np.int64)

    def copies(n):
        shards = simhash.shard_count(n)
        drawn, out = prints[: 64 * shards], 0.0
        for part in range(4):
            tree = simhash.grow(simhash.part_of(drawn, part, 4), shards, 1)
            filled = np.bincount(simhash.route(simhash.part_of(drawn, part, 4), tree, 1)[1]) * (n / len(drawn))
            own = simhash.route(simhash.part_of(prints, part, 4), tree, 1)[1]
            full = simhash.is_crowded(filled, n, shards)
            out += (1 + 7 * full[np.minimum(own, len(full) - 1)]).sum() / len(prints)
        return out

    assert copies(4_000_000) < 1.5 * copies(250_000) < 24


def test_a_part_that_many_prints_share_is_cut_within_a_task(monkeypatch):
    monkeypatch.setattr(simhash, "CUT", 400)
    rng = np.random.default_rng(6)
    high = rng.integers(0, 2**40, 150).astype(np.uint64)[rng.integers(0, 150, 1500)] << np.uint64(20)
    prints = np.unique(high ^ (np.uint64(1) << rng.integers(16, 64, 1500).astype(np.uint64)) ^ np.uint64(9)).view(np.int64)
    distance = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)[None, :])
    u, v = simhash.shard_links(prints, 0, 4, 7)
    linked = [(i, j) for i, j in np.argwhere(distance <= 7).tolist() if i < j]
    assert len(set(simhash.part_of(prints, 0, 4).tolist())) == 1 and (distance[u, v] <= 7).all()
    assert brute_components(len(prints), list(zip(u.tolist(), v.tolist()))) == brute_components(len(prints), linked)


@pytest.mark.parametrize("block", [1000, 8])
def test_no_similar_pair_is_left_unconnected(spark, monkeypatch, block):
    from lexloom.llm import overlap

    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "OFTEN", 2)
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(12))
    rows = []
    for k in range(60):  # pairs a little above and below the bound, all with one line
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(60, 160))]
        other = list(base)
        for i in rng.sample(range(len(base)), len(base) // rng.randrange(36, 60) + 1):
            other[i] = f"x{rng.randrange(50_000)}"
        rows += [(2 * k, " ".join(base) + " " + line), (2 * k + 1, " ".join(other) + " " + line)]
    sets = {d: np.unique(simhash.shingle_hashes(t.encode(), 5)) for d, t in rows}
    similar = {b for a in sets for b in sets if a < b and simhash.similarity(sets[a], sets[b]) >= 0.8}
    assert 10 < len(similar) < 60
    # Fingerprints are not needed to find them.
    monkeypatch.setattr(simhash, "SIGNATURES", 1)
    monkeypatch.setattr(simhash, "print_links", lambda distinct, *_: distinct.selectExpr("rep AS u", "rep AS v"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert {d for d, c in got.items() if d != c} == similar and all(c == d - 1 for d, c in got.items() if d != c)


@pytest.mark.parametrize("block", [1000, 16])
def test_fuzzy_passage_whose_seeds_many_hold(spark, monkeypatch, block):
    """Each seed has more than 32 places, and other first and last holders before the two texts."""
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(3)
    passage = [f"s{rng.randrange(10**6)}" for _ in range(80)]
    changed = [f"x{i}" if i % 16 == 10 else w for i, w in enumerate(passage)]
    rows = [(1000, f"{text(rng, 20)} {' '.join(passage)}"), (90_000, f"{' '.join(changed)} {text(rng, 20)}")]
    for i in range(76):
        rows += [(n + 40 * i + k, f"{text(rng, 60)} {' '.join(passage[i : i + 5])} {text(rng, 60)}") for n in (-9000, 2000) for k in range(20)]
    found = substring.passages(frame(spark, rows)).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in found] == [(90_000, 1000)]
