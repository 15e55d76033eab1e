"""Rules over findings: set algebra and counting.

Findings carry ``emitted``, a struct that orders them as rules and files do:
rule index, path components, region opener, position.  The first finding of a
group represents it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..rules.ast import Rule

_CARRIED = ("file", "span", "matched")


def _key_columns(parts) -> list[Column]:
    return [F.col("file") if k == "file" else F.col("matched.function") for k in dict.fromkeys(parts)]


def _keys(parts) -> list[Column]:
    return [c.alias(f"_{k}") for c, k in zip(_key_columns(parts), dict.fromkeys(parts))]


def _carried():
    return F.struct("emitted", *_CARRIED)


def _size_test(n: Column, op: str, than: int) -> Column:
    return {"gt": n > than, "lt": n < than, "ge": n >= than, "le": n <= than, "eq": n == than}[op]


def _chosen(operation: str, of: tuple[str, ...], has: list[Column]) -> tuple[Column, Column]:
    """Whether a key stays, and the operand whose first finding represents it."""
    if operation == "union":
        return reduce(or_, has), F.coalesce(*(F.when(h, F.lit(r)) for h, r in zip(has, of)))
    if operation == "intersection":
        return reduce(and_, has), F.lit(of[0])
    return reduce(and_, [has[0], *(~h for h in has[1:])]), F.lit(of[0])


def _parts(rule: Rule) -> tuple[str, ...]:
    """What a rule's keys are made of."""
    if rule.compose:
        return tuple(dict.fromkeys(rule.compose[2]))
    return ("file", "function") if rule.count[1] == "function" else ("file",)


def within_files(rule: Rule) -> bool:
    """Whether the rule's keys lie within a file each."""
    return rule.count is not None or "file" in rule.compose[2]


def with_derived(primary: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """``primary`` and the findings that ``rules``, whose keys lie within files, derive from it.

    A derived finding is a primary one by another name: the first of its key.
    So one pass marks each row with the rules that it stands for, by windows
    over its key, and no row is read twice.  All windows lie within a file.
    """
    names, tests = [F.col("rule")], {}
    for i, rule in rules:
        of_key = tests.setdefault(_parts(rule), [])
        if rule.compose:
            operation, of, _ = rule.compose
            of_key += [(F.max(F.col("rule_id") == r), f"_has{i}_{j}") for j, r in enumerate(of)]
            kept, operand = _chosen(operation, of, [F.col(f"_has{i}_{j}") for j in range(len(of))])
        else:
            other, _, op, n = rule.count
            of_key.append((F.count_if(F.col("rule_id") == other), f"_n{i}"))
            kept, operand = _size_test(F.col(f"_n{i}"), op, n), F.lit(other)
        first = F.col("_first_" + "_".join(_parts(rule))) == 1
        names.append(F.when(kept & (F.col("rule_id") == operand) & first, F.lit(i)))
    # Windows over one name share their exchange; over the struct's field each has its own.
    df = primary.withColumn("_function", F.col("matched.function")) if any("function" in parts for parts in tests) else primary
    for parts, counted in tests.items():  # two windows for each kind of key
        keys = ["_function" if k == "function" else k for k in parts]
        df = df.select("*", *(c.over(Window.partitionBy(*keys)).alias(n) for c, n in counted))
        order = Window.partitionBy(*keys, "rule_id").orderBy("emitted")
        df = df.withColumn("_first_" + "_".join(parts), F.row_number().over(order))
    return df.select(F.explode(F.array_compact(F.array(*names))).alias("rule"), *_CARRIED)


def composed(primary: DataFrame, rule: Rule) -> DataFrame:
    """(file, span, matched) for each key that the set operation leaves.

    For keys across files: one aggregation finds every operand's first finding
    per key, combined on the map side; which operands have one decides the key.
    Operands that no rule has are empty sets.
    """
    operation, of, key = rule.compose
    own = primary.filter(F.col("rule_id").isin(*of))
    firsts = [F.min(F.when(F.col("rule_id") == r, _carried())).alias(f"_r{i}") for i, r in enumerate(of)]
    grouped = own.groupBy(*_keys(key)).agg(*firsts)
    kept, operand = _chosen(operation, of, [F.col(f"_r{i}").isNotNull() for i in range(len(of))])
    chosen = F.coalesce(*(F.when(operand == r, F.col(f"_r{i}")) for i, r in enumerate(of)))
    return grouped.filter(kept).select(chosen.alias("_first")).select(*(F.col(f"_first.{c}").alias(c) for c in _CARRIED))


def summary(violations: DataFrame) -> DataFrame:
    """errors, warnings (everything else) and total, as one row."""
    errors = F.count_if(F.col("severity") == "error")
    return violations.agg(errors.alias("errors"), (F.count(F.lit(1)) - errors).alias("warnings"), F.count(F.lit(1)).alias("total"))
