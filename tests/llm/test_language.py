"""op11, op12 and op13: encoding, spelling variants, prefix trie."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import bpe, trie, variants
from lexloom.llm.scratch import Scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, word string, n string, key string"

# -- encoding ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(WORDS)


POOLS = [
    "ab c'sdtrelvm  \t\n",
    "aab",
    "".join(map(chr, range(0x250))),
    "".join(map(chr, range(0x2010, 0x2028))) + "xyz ",
    "".join(chr(c) for c in range(0x3000)),
    "日本語 مرحبا नमस्ते ΣΑΣ İıſ ﬁ 😀👩‍👧 0123²½Ⅷ é",
]


@pytest.mark.parametrize("pool", range(len(POOLS)))
def test_ids_equal_the_library(codec, library, pool):
    rnd = random.Random(pool)
    texts = ["".join(rnd.choice(POOLS[pool]) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [t[:5] + special + t[5:] for t, special in zip(texts, ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>"] * 8)]
    ids, counts = codec.encode(texts)
    cuts = np.cumsum(counts)[:-1]
    for text, own in zip(texts, np.split(ids, cuts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.tolist() == want, text
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_and_forgetting(codec, library, monkeypatch):
    rnd = random.Random(4)
    texts = ["a" * 30_001, "".join(rnd.choice("abcde") for _ in range(50_000)), "é" * 999 + " end"]
    for limit in (200_000, 1):
        monkeypatch.setattr(bpe, "KNOWN_WORDS", limit)
        for text in texts:
            ids, counts = codec.encode([text, "", text])
            want = library.encode(text, add_special_tokens=False).ids
            assert counts.tolist() == [len(want), 0, len(want)] and ids.tolist() == want * 2


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


def test_bad_merges_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [["ab", "b"], ["a", "b"]])


def test_encoding_edges(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello the World's <|endoftext|>"), (4, "Hello the World's <|endoftext|>"), (None, "x"), (5, "the " * 40_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(3)
    encoded = bpe.encode(docs, WORDS)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in encoded.collect()), key=repr) == want
    texts = sorted(((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in bpe.decode(encoded, WORDS).collect()), key=repr) == texts
    hashed = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, WORDS).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert hashed == sorted((i or 0, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())) for i, ids in want)
    odd = spark.createDataFrame([(1, None), (2, [320, None, 70_000, 320])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, WORDS).collect()} == {1: "", 2: library.decode([320, 320])}
    assert bpe.digests(docs.limit(0), WORDS).count() == 0


# -- spelling variants ------------------------------------------------------


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [o for o in n if brute_near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("alphabet, longest", [("ab", 9), ("abcd", 8), ("aéÿ", 7)])
def test_near_pairs_match_brute_force(spark, alphabet, longest):
    rnd = random.Random(longest)
    words = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(4, longest))) for _ in range(300)})
    want = {(a, b) for a in words for b in words if a < b and brute_near(a, b)}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    found = variants.near_pairs(df, Scratch(spark, "near")).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want
    assert all(words[r["n_a"]] == r["a"] and words[r["n_b"]] == r["b"] for r in found)


def test_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 20)
    rnd = random.Random(6)
    stems = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 9))) for _ in range(25)]
    words = stems + [w[:i] + rnd.choice("abcdeÉX") + w[i + rnd.randint(0, 1) :] for w in stems for i in (0, 2, 4)]
    weights = [rnd.choice([1, 1, 5, 40, 200]) for _ in words]
    rows = [(i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in rnd.choices(words, weights, k=60))) for i in range(120)]
    rows += [(None, "Wörterbuch×÷ " * 7), (500, None), (501, ""), (7, rows[7][1]), (7, rows[7][1]), (502, "12-3"), (503, "abcdef" * 30_000), (504, "wortmenge ꞵabcdefꞵ " * 3_000)]
    # Forms in a row: 5, 25, 125 and 625 occurrences.
    rows += [(600 + k, " ".join([w] * 5**k)) for k, w in enumerate(["kettenwor", "kettenwort", "kettenworte", "kettenworten"], 1)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS).repartition(4)
    got = {r["word"]: tuple(r)[1:] for r in variants.spelling_variants(docs).collect()}
    want = brute_variants(rows)
    assert got == want
    assert want["kettenwor"][1] == "kettenworten" and sum(1 for w in want.values() if w[0] and w[0] != w[1]) >= 2


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), least_length=3)


# -- prefix trie ------------------------------------------------------------


def brute_trie(rows, share):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: tuple(t[2] for t in sorted(own, key=lambda t: t[:2])) for c, own in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = turns.get(base, ())[:h] + own[h:] if share else own
    members, children = defaultdict(list), defaultdict(list)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
    return out


def chats(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-30, 90), 60):
        n = rnd.choice([1, 2, 3, 5, 8, 12])
        first = rnd.choice(["hi", "hi", "yes", "é" * 5])
        rows += [(c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "user", "user", None]), first if t == 0 else rnd.choice(["a", "b", None, ""])) for t in range(n)]
    rows += [(200, t, "user", "same") for t in range(40)] + [(201, t, "user", "same") for t in range(37)] + [(202, 1, "user", "tie"), (202, 1, "bot", "tie"), (202, 1, "user", "tie")]
    rows += [(c, t, "user", "copy" * 50) for c in range(300, 340) for t in range(3)] + [(None, 0, "user", "x"), (410, None, None, None)]
    # Each hangs from the one before, one turn deeper.
    rows += [(500 + k, t, "user", "chain" if t < k else f"end {k}") for k in range(1, 20) for t in range(k + 1)]
    return rows


@pytest.mark.parametrize("share, block, ranges", [(True, 4096, 20_000), (True, 3, 7), (False, 2, 5), (False, 4096, 20_000)])
def test_trie_matches_brute_force(spark, monkeypatch, share, block, ranges):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "RANGE_ROWS", ranges)
    rows = chats(block)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string").repartition(3)
    found = trie.conversation_trie(df, share).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert len(found) == len(got) and got == brute_trie(rows, share)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema), True).count() == 0
    one = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_leaves"]) for r in trie.conversation_trie(spark.createDataFrame([(7, 0, "a", "b")], schema)).collect()]
    assert sorted(one) == [(7, 0, None, 1), (7, 1, 7, 1)]
