"""Many rules for single words, as a dictionary from word to rules.

A branch per rule would make one projection grow with the rules until it can no
longer be compiled.  Rules that name the text they want are rows of a table
instead, which tokens meet by a hash join; what else such a rule asks is tested
behind it, once per distinct condition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import conjunction
from ..rules.ast import Pred, Rule

#: Fewer rules for words than this are branches of the projection.
LEAST_RULES = 16
#: Words of all rules that are sent to every executor; more are joined by a shuffle.
SENT_WORDS = 200_000
#: Distinct further conditions that one projection tests.
MOST_CONDITIONS = 64


def literal(rule: Rule) -> tuple[tuple[str, ...], tuple[Pred, ...]] | None:
    """(the texts that a plain rule accepts, its other predicates), or None if it names none."""
    for at, p in enumerate(rule.match):
        if p.field == "text" and p.op in ("eq", "any"):
            texts = (p.value,) if p.op == "eq" else tuple(dict.fromkeys(p.value))
            return texts, rule.match[:at] + rule.match[at + 1 :]
    return None


def split(rules: list[tuple[int, Rule]]) -> tuple[list[tuple[int, Rule]], list[tuple[int, Rule]]]:
    """Rules for the dictionary, and the others."""
    named = [(i, r) for i, r in rules if literal(r) is not None]
    conditions: dict = {}
    own = []
    for i, r in named:
        if condition(r) in conditions or len(conditions) < MOST_CONDITIONS:
            conditions[condition(r)] = True
            own.append((i, r))
    if len(own) < LEAST_RULES:
        return [], rules
    taken = {i for i, _ in own}
    return own, [(i, r) for i, r in rules if i not in taken]


def condition(rule: Rule) -> tuple:
    """What a rule asks besides the text, as a key."""
    return literal(rule)[1], rule.languages, rule.include, rule.exclude, rule.unless_path


def dictionary_matches(tokens: DataFrame, rules: list[tuple[int, Rule]], asked: Callable[[int, Rule], Column], decided: Column | None) -> DataFrame:
    """(rule, all columns of ``tokens``) of rules for words.

    ``asked`` gives a rule's tests of its file; where these were decided before,
    ``decided`` tells for the column ``rule``.
    """
    conditions: dict[tuple, int] = {}
    tests: list[Column] = []
    entries: dict[str, list[tuple[int, int]]] = {}
    for i, r in rules:
        texts, rest = literal(r)
        key = (rest,) if decided is not None else condition(r)
        if key not in conditions:
            conditions[key] = len(tests)
            tests.append(conjunction(rest) if decided is not None else conjunction(rest) & asked(i, r))
        for text in texts:
            entries.setdefault(text, []).append((i, conditions[key]))
    words = tokens.sparkSession.createDataFrame(sorted(entries.items()), "_word string, _entries array<struct<rule: int, test: int>>")
    if len(entries) <= SENT_WORDS:
        words = F.broadcast(words)
    found = tokens.join(words, tokens["text"] == words["_word"]).withColumn("_entry", F.explode("_entries"))
    found = found.withColumn("rule", F.col("_entry.rule")).filter(F.element_at(F.array(*tests), F.col("_entry.test") + 1))
    if decided is not None:
        found = found.filter(decided)
    return found.drop("_word", "_entries", "_entry")
