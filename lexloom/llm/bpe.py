"""Byte-pair encoding and decoding by batched merge rounds.

The symbols of many distinct words lie in one flat array.  Each round finds every
word's pair of lowest rank by binary search over the sorted pair keys, merges all
its occurrences from left to right, and searches anew only the pairs beside a
merge; words without a pair to merge leave.  There are about as many rounds as the
longest word has merges.

In a vocabulary whose every symbol is made by one merge, after those of its parts,
a word's merges come in rising rank, so that merging all occurrences of the lowest
at once is what the library does one by one.  ``Codec`` refuses any other.

Texts of common characters are normalised and split by one pattern; in all others
the library's own normaliser and splitter find the words.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import arrow_map
from .scratch import table

#: Words, and characters of words, that a task remembers from one slice of texts to the next.
KNOWN_WORDS, KNOWN_CHARACTERS = 200_000, 4_000_000
#: Characters that normalise and split alike in every version of Unicode in use.
_RARE = re.compile("[^\x00-ɏ‐-‧]")
_NO_PAIR = np.iinfo(np.int64).max
#: The normaliser, and the splitter's pattern, that this encoder knows: fixed values.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Merges:
    """Merge rules as sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made: dict[int, int] = {}
        left, right, product = (np.zeros(len(pairs), np.int64) for _ in range(3))
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if z in made or any(p not in made and len(s.removesuffix("</w>")) > 1 for p, s in ((x, a), (y, b))):
                raise ValueError(f"merge {rank} makes a symbol twice or before its parts")
            made[z] = rank
            left[rank], right[rank], product[rank] = x, y, z
        self.product = product
        keys = left << 32 | right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NO_PAIR where none merges it."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], _NO_PAIR)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``symbols`` of words, whose numbers rise along ``word``, merged until no pair is left; and their words."""
        rank = np.full(len(symbols), _NO_PAIR)  # of a symbol and the next of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[first, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, first), lengths)
            going = least != _NO_PAIR
            if not going.all():
                ready.append((word[~going], symbols[~going]))
                symbols, word, rank, least = symbols[going], word[going], rank[going], least[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            # In a run of one symbol every second pair is merged.
            nth = np.arange(len(at))
            begins = np.r_[True, np.diff(at) > 1]
            at = at[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0]
            symbols[at] = self.product[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, word, rank = symbols[kept], word[kept], rank[kept]
            at = at - np.arange(len(at))
            changed = np.union1d(at, at[at > 0] - 1)
            rank[changed] = _NO_PAIR
            changed = changed[changed < len(word) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        if not ready:
            return symbols, word
        words, found = (np.concatenate(x) for x in zip(*ready))
        order = np.argsort(words, kind="stable")
        return found[order], words[order]


class Codec:
    """Texts to ids and back, as the library's tokenizer of a byte-level vocabulary with word ends does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added, splitters = spec["model"], spec["added_tokens"], spec["pre_tokenizer"].get("pretokenizers", [])
        wanted = {"type": "BPE", "end_of_word_suffix": "</w>", "dropout": None, "continuing_subword_prefix": None}
        split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        known = (
            len(splitters) == 2
            and all(all(own.get(k) == v for k, v in want.items()) for want, own in ((wanted, model), (split, splitters[0]), (level, splitters[1])))
            and not model.get("ignore_merges")
            and spec["decoder"] is None
            and spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALISER}
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not known:
            raise ValueError(f"{path}: not a vocabulary of the kind that this encoder knows")
        self.path, vocabulary = path, model["vocab"]
        self.merges = Merges(vocabulary, model["merges"])
        characters = byte_characters()
        self.inner = np.array([vocabulary[c] for c in characters], np.int64)
        self.last = np.array([vocabulary[c + "</w>"] for c in characters], np.int64)
        self.byte = {c: b for b, c in enumerate(characters)}
        self.special = {t["content"]: t["id"] for t in added}
        self.tokens = {i: s for s, i in {**vocabulary, **self.special}.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN.replace(r"\s", r"\t-\r \x85\xa0"))
        self.library = None
        self._forget()

    def _forget(self) -> None:
        """Ids of the words seen so far, in one flat array: none but the special ones."""
        self.place = {s: i for i, s in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int64)
        self.first, self.count = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)
        self.characters = 0

    def _plain_words(self, text: str) -> list[str]:
        if not _RARE.search(text):
            return self.words.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in found]

    def split(self, text: str) -> list[str]:
        """The words of a text, and the special strings in it."""
        if self.cut is None or not self.cut.search(text):
            return self._plain_words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self._plain_words(part)
        return out

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen before, together."""
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        found, word = self.merges.merge(symbols, np.repeat(np.arange(len(data)), lengths))
        count = np.bincount(word, minlength=len(data))
        self.characters += sum(map(len, words))
        self.place.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        split = [self.split(t) for t in texts]
        words = [w for own in split for w in own]
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        through = np.concatenate([[0], ends])
        cuts = np.cumsum([0, *map(len, split)])
        if len(self.place) > KNOWN_WORDS or self.characters > KNOWN_CHARACTERS:
            self._forget()
        return ids, np.diff(through[cuts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, which the library gives as their tokens between blanks; ids without a token are passed over."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) for every row of ``docs`` (doc_id, text).

    Null texts count as empty and have no ids; special strings inside texts are
    their ids; texts of any length are encoded whole; rows that repeat are encoded
    each; empty tables give no rows; further columns are ignored.
    """

    def make():
        codec = Codec(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            return pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

        return each

    light = docs.select("doc_id", "text")
    return arrow_map(light, make, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, ids array<int>", "text")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids).

    Null ids are none, and give an empty text; ids that are null or that no token
    has are passed over; empty tables give no rows; further columns are ignored.
    """

    def make():
        codec = Codec(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [codec.decode(ids.as_py() or []) for ids in batch.column("ids")]
            return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return each

    light = encoded.select("doc_id", "ids")
    return arrow_map(light, make, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``: the ids, and what they decode to, in one pass.

    Edge cases are those of ``encode`` and ``decode``; an empty text has the
    digests of no bytes.
    """
    import hashlib

    def make():
        codec = Codec(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            data, cuts = ids.astype("<u4"), np.concatenate([[0], np.cumsum(counts)]).tolist()
            own = [data[a:b] for a, b in zip(cuts, cuts[1:])]
            shas = [hashlib.sha256(x.tobytes()).hexdigest() for x in own]
            back = [hashlib.sha256(codec.decode(x.tolist()).encode()).hexdigest() for x in own]
            return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    light = docs.select("doc_id", "text")
    return arrow_map(light, make, f"doc_id {light.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document encoded and decoded."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"))
