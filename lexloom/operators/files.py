"""Which rules apply to a file, decided once per file.

Languages, paths, path guards and waivers say nothing of single tokens.  A file's
rules are one bitset beside its text: files to which no rule applies are left out
before anything is lexed, and tokens carry the bits instead of being asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import applies
from ..rules.ast import Rule

#: The column of a file's bits: one long for every WORD rules.
BITS, WORD = "rule_bits", 62
#: Files with waivers that are sent to every executor; more are joined by a shuffle.
SENT_FILES = 100_000


def _bit(index: int) -> int:
    return 1 << index % WORD


def with_rule_bits(files: DataFrame, rules: list[Rule], waivers: list[tuple[str, str]], alive: Callable[[Rule], bool] = lambda r: True) -> DataFrame:
    """``files`` (file, language, ...) to which a match or sequence rule applies, with their bits.

    A rule that a waiver names, itself or by its guard, does not apply to the
    waiver's file.  Rules over findings have no bits.
    """
    own = [(i, r) for i, r in enumerate(rules) if not r.aggregate and alive(r)]
    words = -(-len(rules) // WORD) or 1
    always = [0] * words
    tested: list[list[Column]] = [[] for _ in range(words)]
    for i, r in own:
        if r.languages is None and not (r.include or r.exclude or r.unless_path):
            always[i // WORD] |= _bit(i)
        else:
            tested[i // WORD].append(F.when(applies(r), F.lit(_bit(i)).cast("long")).otherwise(F.lit(0).cast("long")))
    bits = [reduce(lambda a, b: a.bitwiseOR(b), tests, F.lit(some).cast("long")) for some, tests in zip(always, tested)]
    files = files.withColumn(BITS, F.array(*bits))
    named: dict[str, list[int]] = {}
    for i, r in own:
        for name in {r.id, r.unless_waiver} - {None}:
            named.setdefault(name, []).append(i)
    waived: dict[str, list[int]] = {}
    for name, file in waivers:
        for i in named.get(name, ()):
            waived.setdefault(file, [0] * words)[i // WORD] |= _bit(i)
    if waived:
        gone = files.sparkSession.createDataFrame(sorted(waived.items()), "_file string, _waived array<long>")
        gone = F.broadcast(gone) if len(waived) <= SENT_FILES else gone
        left = F.zip_with(BITS, "_waived", lambda have, gone: have.bitwiseAND(F.bitwise_not(gone)))
        files = files.join(gone, files["file"] == gone["_file"], "left")
        files = files.withColumn(BITS, F.when(F.col("_waived").isNull(), F.col(BITS)).otherwise(left)).drop("_file", "_waived")
    return files.filter(reduce(or_, (F.col(BITS)[w] != 0 for w in range(words))))


def decided(tokens: DataFrame) -> Callable[[int, Rule], Column] | None:
    """A rule's test of a token's file by its bits, where tokens carry them."""
    if BITS not in tokens.columns:
        return None
    return lambda i, r: F.col(BITS)[i // WORD].bitwiseAND(F.lit(_bit(i)).cast("long")) != 0


def decided_for(rule: str) -> Column:
    """The same for the number in a column."""
    return F.expr(f"shiftright(element_at({BITS}, CAST({rule} DIV {WORD} AS INT) + 1), {rule} % {WORD}) & 1 = 1")


def of_rule(tokens: DataFrame, index: int, rule: Rule) -> tuple[DataFrame, Rule]:
    """The tokens of a rule's files, and the rule without what its bits have decided."""
    test = decided(tokens)
    if test is None:
        return tokens, rule
    return tokens.filter(test(index, rule)), replace(rule, languages=None, include=(), exclude=(), unless_path=None)
