"""Classes with operators, and swapped greed, by Java against a set model."""

import random

import pytest

from lexloom.rules.ast import RuleError
from lexloom.rules.dialect import java_regex

ALPHABET = "abcdefgh0123 -^&~[]éÉßαΩ_\n"
#: Atoms and what they hold of the alphabet.
ATOMS = {
    "a": "a", "c-f": "cdef", "0-2": "012", r"\d": "0123", r"\w": "abcdefgh0123éÉßαΩ_", r"\p{Lu}": "ÉΩ", r"\p{Greek}": "αΩ", "[:alpha:]": "abcdefgh",
    r"\-": "-", r"\]": "]", "é": "é", r"\x{3b1}": "α", r"\s": " \n", "[:^digit:]": "".join(c for c in ALPHABET if c not in "0123"), "_": "_",
}


def holds(spark, pattern):
    java = spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
    return {c for c in ALPHABET if java.matcher(c).find()}


def random_class(rng, depth=2):
    """(pattern, what it holds) of a random class."""
    text, held = None, None
    for nth in range(rng.randrange(1, 4)):
        part, own = "", set()
        for _ in range(rng.randrange(1, 4)):
            if depth and rng.random() < 0.3:
                inner, more = random_class(rng, depth - 1)
            else:
                inner, more = rng.choice(sorted(ATOMS.items()))
            part, own = part + inner, own | set(more)
        if text is None:
            text, held = part, own
            continue
        operator = rng.choice(["&&", "--", "~~"])
        text += operator + part
        held = {"&&": held & own, "--": held - own, "~~": held ^ own}[operator]
    negated = rng.random() < 0.3
    return ("[^" if negated else "[") + text + "]", set(ALPHABET) - held if negated else held


@pytest.mark.parametrize("seed", range(4))
def test_classes_equal_sets(spark, seed):
    rng = random.Random(seed)
    for _ in range(100):
        pattern, want = random_class(rng)
        assert holds(spark, pattern) == want, pattern


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("[a-f--c-d]", "abef"), (r"[\w--[a-f]--\d]", "ghéÉßαΩ_"), ("[a-f&&c-h~~d]", "cef"), ("[^a-h&&[^c]]", "c0123 -^&~[]éÉßαΩ_\n"), ("[]a]", "]a"), ("[^]a]", "".join(c for c in ALPHABET if c not in "]a")),
        ("[-a]", "-a"), ("[a-]", "a-"), ("[a^]", "a^"), ("[&a]", "&a"), ("[a&~]", "a&~"), (r"[a&&]", ""), ("[[a][b]c]", "abc"),
    ],
)
def test_classes(spark, pattern, want):
    assert holds(spark, pattern) == set(want)


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("a+", "aaa", "aaa"), ("(?U)a+", "aaa", "a"), ("(?U)a+?", "aaa", "aaa"), ("(?U:a+)a*", "aaa", "aaa"), ("(?U)(?-U:a+)", "aaa", "aaa"), ("((?U)a{1,2})", "aaa", "a"),
        ("(?U)a??", "a", "a"), ("(?u)é", "é", "é"), ("(?iU)A{2,}", "aaa", "aa"), ("(?U)x|a*", "aa", ""), ("((?U)b)a+", "baa", "baa"),
    ],
)
def test_swapped_greed(spark, pattern, text, want):
    matcher = spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_regex(pattern)).matcher(text)
    assert matcher.find() and matcher.group() == want


@pytest.mark.parametrize("pattern", ["[a", "[a--", "(?-u)a", r"[\b]", "[[:nothing:]]", "[a[b]", "(?U", "a)"])
def test_refused(pattern):
    with pytest.raises(RuleError):
        java_regex(pattern)
