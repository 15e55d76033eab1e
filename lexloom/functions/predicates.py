"""Token predicates as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.ast import Pred, Rule, Step

_NUMBERS = ("start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col", "curly_depth", "round_depth", "bracket_depth")
_STRINGS = ("node_kind", "class", "text", "function")


def token_field(name: str) -> Column | None:
    """The column that a predicate's field names; None for an unknown field."""
    if name == "kind":
        name = "node_kind"
    if name in (*_NUMBERS, *_STRINGS, "named"):
        return F.col(name)
    if name == "range_lines":
        return F.col("end_line") - F.col("start_line") + 1
    if name == "text_len":
        return F.col("end_byte") - F.col("start_byte")
    return None


def predicate(pred: Pred) -> Column:
    """One predicate over the current token, never null.

    References compare with nothing here, so they are false.
    """
    field = token_field(pred.field)
    if field is None:
        return F.lit(pred.op == "not_regex")
    if pred.op in ("eq_ref", "ne_ref"):
        return F.lit(False)
    if pred.op in ("gt", "lt", "ge", "le"):
        number = field if pred.field not in (*_STRINGS, "kind", "named") else field.cast("string").try_cast("double")
        compared = {"gt": number > pred.value, "lt": number < pred.value, "ge": number >= pred.value, "le": number <= pred.value}
        return F.coalesce(compared[pred.op], F.lit(False))
    text = field if pred.field in (*_STRINGS, "kind") else field.cast("string")
    if pred.op == "eq":
        return text == F.lit(pred.value)
    if pred.op == "any":
        return text.isin(*pred.value) if pred.value else F.lit(False)
    found = text.rlike(pred.value)
    return ~found if pred.op == "not_regex" else found


def conjunction(preds: tuple[Pred, ...]) -> Column:
    return reduce(and_, map(predicate, preds)) if preds else F.lit(True)


def accepts(step: Step) -> Column:
    """Whether a step without references takes the current token."""
    found = reduce(or_, map(conjunction, step.alternatives)) if step.alternatives else F.lit(False)
    return ~found if step.negate else found


def applies(rule: Rule) -> Column:
    """A rule's language and path filters, and its path guard, as a filter on tokens."""
    tests = []
    if rule.languages is not None:
        tests.append(F.col("language").isin(*rule.languages) if rule.languages else F.lit(False))
    if rule.include:
        tests.append(reduce(or_, (F.col("file").rlike(g) for g in rule.include)))
    tests += [~F.col("file").rlike(g) for g in (*rule.exclude, *(rule.unless_path or ()))]
    return reduce(and_, tests) if tests else F.lit(True)
