"""Sequences with balanced delimiters and captures at fixed places, by windows.

A delimiter that opens and the one that closes it are one item of the sequence: a
window over (file, block, pair) lets the opening token see what holds behind its
partner, so a match jumps over the pair.  What stands between is compared with
the partner's place.  A capture that is compared a fixed number of tokens later
is an offset.  All windows run from a region's end to its beginning and share one
exchange; other shapes are left to search.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import accepts, conjunction, token_field
from ..rules.ast import Rule, Step
from .primary import _END, _finding, _useful_blocks, ahead, backward, carried, first_region, is_gap, must_start, regions, step_holds, tail_matches

_OPENERS = ("(", "{", "[")


@dataclass(frozen=True)
class Pair:
    """Steps from an opening delimiter to the one that closes it: fixed tokens, then a run or single tokens between gaps."""

    open: int
    close: int
    fixed: tuple[int, ...]
    run: int | None = None
    singles: tuple[int, ...] = ()


def _pair(steps: tuple[Step, ...], open_: int, close: int) -> Pair | None:
    inner = list(range(open_ + 1, close))
    fixed = []
    while inner and steps[inner[0]].quant == "one":
        fixed.append(inner.pop(0))
    if not inner:
        return Pair(open_, close, tuple(fixed))
    if len(inner) == 1 and steps[inner[0]].quant == "zero_or_more":
        return Pair(open_, close, tuple(fixed), inner[0])
    gaps, singles = inner[::2], inner[1::2]
    if not fixed and len(inner) % 2 and all(is_gap(steps[i]) for i in gaps) and all(steps[i].quant == "one" for i in singles):
        return Pair(open_, close, (), None, tuple(singles))
    return None


def items(steps: tuple[Step, ...]) -> list[int | Pair] | None:
    """Single steps and pairs, in order; None where delimiters nest or stay open."""
    out: list[int | Pair] = []
    i = 0
    while i < len(steps):
        if not steps[i].delimiter or steps[i].alternatives[0][0].value not in _OPENERS:
            out.append(i)  # a delimiter that closes nothing is a token like any other
            i += 1
            continue
        close = next((k for k in range(i + 1, len(steps)) if steps[k].delimiter), None)
        if close is None or steps[close].alternatives[0][0].value in _OPENERS:
            return None
        pair = _pair(steps, i, close)
        if pair is None:
            return None
        out.append(pair)
        i = close + 1
    return out


def captures(steps: tuple[Step, ...]) -> dict[tuple[int, str], tuple[str, int]] | None:
    """(step, variable) -> (bound field, how many tokens before); None where a place is not fixed."""
    bound: dict[str, tuple[int, str]] = {}
    out = {}
    for i, step in enumerate(steps):
        for name in {p.value for a in step.alternatives for p in a if p.op in ("eq_ref", "ne_ref")}:
            if name not in bound:
                continue  # nothing is bound yet: the comparison is false
            at, attr = bound[name]
            if any(s.quant != "one" for s in steps[at : i + 1]):
                return None
            out[i, name] = (attr, i - at)
        for name, attr in step.bind:
            if name in bound:
                return None
            bound[name] = (i, attr)
    return out


def plannable(rule: Rule) -> bool:
    return bool(rule.steps) and items(rule.steps) is not None and captures(rule.steps) is not None


def _compared(step: Step, i: int, known: dict, order) -> Column:
    """Whether a step with references takes the current token."""
    found = []
    for nth, preds in enumerate(step.alternatives):
        tests = [F.col(f"a{i}_{nth}")]
        for p in preds:
            if p.op in ("eq_ref", "ne_ref"):
                attr, back = known.get((i, p.value), ("", 0))
                if token_field(p.field) is None or token_field(attr) is None:
                    tests.append(F.lit(False))
                    continue
                have, bound = F.col(f"_v_{p.field}"), F.lead(f"_v_{attr}", back).over(order)
                tests.append(F.coalesce(have == bound if p.op == "eq_ref" else have != bound, F.lit(False)))
        found.append(reduce(and_, tests))
    any_found = reduce(or_, found) if found else F.lit(False)
    return ~any_found if step.negate else any_found


def paired_sequences(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """A sequence for which ``plannable`` holds, from its last item to its first."""
    steps = rule.steps
    known, order = captures(steps), backward()
    start = accepts(steps[0]) if must_start(steps[0]) and not steps[0].has_refs else None
    columns, fields = [], set()
    for i, step in enumerate(steps):
        if not step.has_refs:
            columns.append(accepts(step).alias(f"a{i}"))
            continue
        for nth, preds in enumerate(step.alternatives):
            columns.append(conjunction(tuple(p for p in preds if p.op not in ("eq_ref", "ne_ref"))).alias(f"a{i}_{nth}"))
            fields |= {p.field for p in preds if p.op in ("eq_ref", "ne_ref")} | {known[i, p.value][0] for p in preds if (i, p.value) in known}
    values = [token_field(f).cast("string").alias(f"_v_{f}") for f in sorted(fields) if token_field(f) is not None]
    df = regions(tokens, rule, [*carried(start), F.col("jmp").cast("long").alias("_jmp"), *columns, *values])
    df = df.withColumn("_pair", F.coalesce(F.least("pos", "_jmp"), F.col("pos")))
    for i, step in enumerate(steps):
        if step.has_refs:
            df = df.withColumn(f"a{i}", _compared(step, i, known, order)).drop(*(f"a{i}_{nth}" for nth in range(len(step.alternatives))))
    df = df.drop(*(v for v in df.columns if v.startswith("_v_")))
    if rule.in_scope:
        df = _useful_blocks(df, steps)
    then = f"f{len(steps)}"
    df = df.withColumn(then, F.lit(False))
    for item in reversed(items(steps)):
        first = item if isinstance(item, int) else item.open
        if isinstance(item, int):
            holds = step_holds(steps[item], F.col(f"a{item}"), F.col(then), tail_matches(steps[item + 1 :]), order)
            df = df.withColumn(f"f{first}", holds)
        else:
            df = _over_pair(df, steps, item, then, order).withColumnRenamed("_holds", f"f{first}")
        df = df.drop(then)
        then = f"f{first}"
    return _finding(first_region(df.filter(then), rule), index, F.col("open"))


def _over_pair(df: DataFrame, steps: tuple[Step, ...], pair: Pair, then: str, order) -> DataFrame:
    """``df`` with ``_holds``: the pair begins here and what follows it consumes the rest of the region."""
    place, begins = F.col("pos").cast("long"), F.col(f"a{pair.open}")
    df = df.withColumn("_close", F.col(f"a{pair.close}") & F.lag(then, 1, tail_matches(steps[pair.close + 1 :])).over(order))
    # Of a delimiter without a partner nothing is known: its steps are steps like others.
    df = df.withColumn("_loose", F.col("_close"))
    for i in reversed(range(pair.open + 1, pair.close)):
        df = df.withColumn("_loose", step_holds(steps[i], F.col(f"a{i}"), F.col("_loose"), False, order))
    both = Window.partitionBy("file", "open", "_pair")
    tests = [F.max(F.when(place > F.col("_jmp"), F.col("_close"))).over(both)]
    tests += [F.lag(f"a{i}", nth, False).over(order) for nth, i in enumerate(pair.fixed, 1)]
    inside = len(pair.fixed) + 1
    if pair.run is None and not pair.singles:
        tests.append(F.col("_jmp") == place + inside)
    elif pair.run is not None:
        tests.append(F.col("_jmp") >= place + inside)
        if not is_gap(steps[pair.run]):
            stop = F.min(F.when(~F.col(f"a{pair.run}"), place)).over(ahead(order, inside))
            tests.append(F.coalesce(stop, F.lit(_END)) >= F.col("_jmp"))
    else:
        # The first place where each single token may stand, behind that of the one before it.
        last = None
        for i in reversed(pair.singles):
            ends = place if last is None else F.lag("_reach", 1).over(order)
            df = df.withColumn("_end", F.when(F.col(f"a{i}"), ends)).withColumn("_reach", F.min("_end").over(ahead(order))).drop("_end")
            last = i
        tests.append(F.coalesce(F.lag("_reach", 1).over(order) < F.col("_jmp"), F.lit(False)))
    matched = reduce(and_, tests)
    loose = F.lag("_loose", 1, False).over(order)
    df = df.withColumn("_matched", F.coalesce(matched, F.lit(False))).withColumn("_loose", loose)
    return df.withColumn("_holds", begins & F.when(F.col("_jmp").isNull(), F.col("_loose")).otherwise(F.col("_matched"))).drop("_close", "_loose", "_matched", "_reach")
