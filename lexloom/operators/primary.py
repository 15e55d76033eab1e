"""Findings of single rules: plain matches, scope clauses and window sequences.

Every function takes the tokens relation and returns findings: the rule's index
and the token's payload, with ``open`` as the region that found it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import accepts, applies, conjunction
from ..rules.ast import Rule
from ..schema import MATCHED_FIELDS, SPAN_FIELDS
from . import files, literals

PAYLOAD = ("file", "pos", *SPAN_FIELDS, *MATCHED_FIELDS)
#: The root block, which encloses the whole file.
ROOT = -1
#: A position behind every token.
_END = 2**31


def _finding(df: DataFrame, index: int, opener: Column | None = None) -> DataFrame:
    found = [F.col(f"_payload.{c}") if "_payload" in df.columns and c not in ("file", "pos") else F.col(c) for c in PAYLOAD]
    return df.select(F.lit(index).alias("rule"), F.lit(ROOT).alias("open") if opener is None else opener.alias("open"), *found)


def plain_matches(tokens: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """All plain ``match`` rules in one pass over the tokens, without a shuffle.

    Many rules for single words are looked up; the others are branches of one projection.
    """
    known = files.decided(tokens)
    asked = known or (lambda i, r: applies(r))
    looked_up, rules = literals.split(rules)
    parts = []
    if looked_up:
        found = literals.dictionary_matches(tokens, looked_up, asked, files.decided_for("rule") if known else None)
        parts.append(found.select("rule", F.lit(ROOT).alias("open"), *PAYLOAD))
    if rules:
        hits = [F.when(asked(i, r) & conjunction(r.match), F.lit(i)) for i, r in rules]
        any_hit = reduce(or_, (h.isNotNull() for h in hits))
        found = tokens.filter(any_hit)
        rule = F.explode(F.array_compact(F.array(*hits))) if len(hits) > 1 else F.lit(rules[0][0])
        parts.append(found.select(rule.alias("rule"), F.lit(ROOT).alias("open"), *PAYLOAD))
    return reduce(DataFrame.unionAll, parts)


def scoped_matches(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """A ``match`` whose clauses look at the innermost enclosing block.

    Clause tokens inside a block are a difference of running counts: that before
    its closer, which the opener sees in a window over the pair, and that at its
    opener.  A target asks the last opener of its level.  So each token is one row,
    however deep it lies; braces, clause tokens and targets alone move, once.
    Braces belong to the block around them, and a file is its own outermost block.
    """
    clauses = [(kind, conjunction(preds)) for kind, preds in rule.where]
    some, target = reduce(or_, (c for _, c in clauses)), conjunction(rule.match)
    n = range(len(clauses))
    opens, closes = ((F.col("node_kind") == b) & F.col("jmp").isNotNull() for b in "{}")
    df = tokens.filter(applies(rule) & (some | target | opens | closes))
    # Only targets need more than their place.
    payload = [F.when(target, F.col(c)).alias(c) for c in PAYLOAD if c not in ("file", "pos")]
    own = [c.cast("int").alias(f"c{i}") for i, (_, c) in enumerate(clauses)]
    df = df.select("file", "pos", *payload, target.alias("_target"), opens.alias("_opens"), closes.alias("_closes"), F.least("pos", "jmp").alias("_pair"), *own)
    order = Window.partitionBy("file").orderBy("pos")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("_opens").cast("int") - F.col("_closes").cast("int")
    df = df.withColumns({"_level": F.sum(step).over(up_to)} | {f"n{i}": F.sum(f"c{i}").over(up_to) for i in n})
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({f"all{i}": F.last(f"n{i}").over(whole) for i in n})
    pair = Window.partitionBy("file", "_pair")
    df = df.withColumns({f"to{i}": F.max(F.when(F.col("_closes"), F.col(f"n{i}") - F.col(f"c{i}"))).over(pair) for i in n})
    # An opener answers on the level inside, and may be a target on the one outside.
    entry = lambda level, answers: F.struct(level.alias("level"), F.lit(answers).alias("answers"))
    none = F.array().cast("array<struct<level: bigint, answers: boolean>>")
    answer = F.when(F.col("_opens"), F.array(entry(F.col("_level"), True))).otherwise(none)
    ask = F.when(F.col("_target"), F.array(entry(F.col("_level") - F.col("_opens").cast("int"), False))).otherwise(none)
    df = df.withColumn("_at", F.explode(F.concat(answer, ask))).withColumn("_level", F.col("_at.level"))
    block = F.struct(*(F.col(f"n{i}").alias(f"from{i}") for i in n), *(F.col(f"to{i}").alias(f"to{i}") for i in n))
    same = Window.partitionBy("file", "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_block", F.last(F.when(F.col("_at.answers"), block), ignorenulls=True).over(same)).filter("not _at.answers")
    tests = []
    for i, (kind, _) in enumerate(clauses):
        low = F.coalesce(F.col(f"_block.from{i}"), F.lit(0))
        high = F.coalesce(F.col(f"_block.to{i}"), F.col(f"all{i}"))
        others = high - low - F.col(f"c{i}") > 0
        tests.append({"contains": others, "not_contains": ~others, "followed_by": high > F.col(f"n{i}")}[kind])
    return _finding(df.filter(reduce(lambda a, b: a & b, tests)), index)


def regions(tokens: DataFrame, rule: Rule, columns: list) -> DataFrame:
    """Tokens once per region of a sequence rule, with the region as ``open``."""
    own = tokens.filter(applies(rule))
    if not rule.in_scope:
        return own.select(F.lit(ROOT).alias("open"), *columns)
    return own.select(F.explode(F.slice("block_path", F.lit(2), F.greatest(F.size("block_path") - 1, F.lit(0)))).alias("open"), *columns)


def outermost(tokens: DataFrame, rule: Rule, columns: list) -> DataFrame:
    """Tokens in blocks, each once, with the outermost block around them as ``open``."""
    own = tokens.filter(applies(rule) & (F.size("block_path") > 1))
    return own.select(F.element_at("block_path", 2).alias("open"), *columns)


def tail_matches(steps) -> bool:
    """Whether the steps can match nothing."""
    return all(s.quant != "one" for s in steps)


def carried(start: Column | None) -> list[Column]:
    """Place and payload, as one column that is null where no match may start: other tokens need no more than their place."""
    payload = F.struct(*(c for c in PAYLOAD if c not in ("file", "pos")))
    return [F.col("file"), F.col("pos"), (payload if start is None else F.when(start, payload)).alias("_payload")]


def must_start(step) -> bool:
    """Whether a match starts at a token that this first step accepts."""
    return step.quant == "one"


def is_gap(step) -> bool:
    return step.quant == "zero_or_more" and not step.negate and step.alternatives == ((),)


def gapped(steps) -> bool:
    """Whether single tokens alternate with any tokens, to the region's end."""
    return len(steps) % 2 == 0 and all(is_gap(s) if i % 2 else s.quant == "one" for i, s in enumerate(steps))


def gapped_sequences(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """Tokens that others follow somewhere in the region, in order.

    From the last token to the second, the last place where each may stand is
    the last one before that of the next; a start lies before all of them.  Only
    tokens that some step accepts take part, and their order does not matter.
    """
    wanted = [accepts(s) for s in rule.steps[::2]]
    flags = [f"a{i}" for i in range(len(wanted))]
    own = tokens.filter(reduce(or_, wanted))
    df = (outermost if rule.in_scope else regions)(own, rule, [*carried(wanted[0]), *(w.alias(a) for w, a in zip(wanted, flags))])
    block, last = Window.partitionBy("file", "open"), None
    for a in reversed(flags[1:]):
        holds = F.col(a) if last is None else F.col(a) & (F.col("pos") < F.col(last))
        df = df.withColumn(f"last_{a}", F.max(F.when(holds, F.col("pos"))).over(block))
        last = f"last_{a}"
    holds = F.col("a0") if last is None else F.col("a0") & (F.col("pos") < F.col(last))
    return _finding(df.filter(holds), index, F.col("open"))


def single_run(steps) -> bool:
    """Whether single tokens begin, and at most one run follows, to the region's end."""
    return all(s.quant == "one" for s in steps[:-1]) and must_start(steps[0]) and steps[-1].quant != "optional"


def runs_in_blocks(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """``single_run`` sequences that end with some block around them.

    How far the run could go is a window over the outermost block: the sequence
    holds in blocks that close behind its single tokens, and not behind the first
    token that the run refuses.  So every token is one row; only starts are dealt to
    the blocks around them, whose closers tell where they end.
    """
    steps = rule.steps
    n = len(steps) - (steps[-1].quant == "zero_or_more")
    start, closes = accepts(steps[0]), (F.col("node_kind") == "}") & F.col("jmp").isNotNull()
    around = F.when(start, F.slice("block_path", F.lit(3), F.greatest(F.size("block_path") - 2, F.lit(0))))
    flags = [accepts(s).alias(f"a{i}") for i, s in enumerate(steps)]
    if n == 1 < len(steps):  # then starts, what the run refuses and closers say all
        tokens = tokens.filter(start | ~accepts(steps[1]) | closes)
    df = outermost(tokens, rule, [*carried(start), around.alias("_around"), F.when(closes, F.col("jmp").cast("int")).alias("_opener"), *flags])
    df, order = _useful_blocks(df, steps), backward()
    holds = reduce(lambda a, b: a & b, (F.lag(f"a{i}", i, False).over(order) for i in range(n)))
    refused = F.when(~F.col(f"a{n}"), F.col("pos")) if n < len(steps) else F.col("pos")
    stop = F.min(refused).over(ahead(order, n))
    df = df.withColumns({"_holds": holds, "_last": F.lag("pos", n - 1).over(order), "_stop": stop}).filter("_holds or _opener is not null")
    # Where nothing is refused the outermost block is the one; else it closes too late.
    entry = lambda block, closes: F.struct(block.alias("open"), F.lit(closes).alias("closes"))
    none = F.array().cast("array<struct<open: int, closes: boolean>>")
    blocks = F.when(F.col("_stop").isNull(), F.array("open")).otherwise(F.col("_around"))
    asks = F.when(F.col("_holds"), F.transform(blocks, lambda b: entry(b, False))).otherwise(none)
    answers = F.when(F.col("_opener").isNotNull(), F.array(entry(F.col("_opener"), True))).otherwise(none)
    df = df.withColumn("_at", F.explode(F.concat(asks, answers))).withColumn("open", F.col("_at.open"))
    close = F.max(F.when(F.col("_at.closes"), F.col("pos"))).over(Window.partitionBy("file", "open"))
    df = df.withColumn("_close", close).filter("not _at.closes and (_stop is null or _close > _last and _close <= _stop)")
    return _finding(first_region(df, rule), index, F.col("open"))


def run_to_the_end(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """``single_run`` sequences over whole files, by one window.

    The single tokens stand at fixed places ahead, and from the run on nothing may
    stand that it refuses.  With one single token, only starts and what is refused say all.
    """
    steps = rule.steps
    n = len(steps) - (steps[-1].quant == "zero_or_more")
    start, flags = accepts(steps[0]), [accepts(s).alias(f"a{i}") for i, s in enumerate(steps)]
    if n == 1 < len(steps):
        tokens = tokens.filter(start | ~accepts(steps[1]))
    df, order = regions(tokens, rule, [*carried(start), *flags]), backward()
    # A step that takes any token needs one to stand there, as the last single step sees where nothing is asked.
    asked = [i for i in range(n) if i == n - 1 or steps[i].negate or steps[i].alternatives != ((),)]
    tests = [F.lag(f"a{i}", i, False).over(order) for i in asked]
    if n == len(steps):
        tests.append(F.lag("pos", n).over(order).isNull())
    elif not is_gap(steps[n]):
        tests.append(F.min(F.when(~F.col(f"a{n}"), F.col("pos"))).over(ahead(order, n)).isNull())
    df = df.withColumn("_holds", reduce(lambda a, b: a & b, tests)).filter("_holds")
    return _finding(df, index, F.col("open"))


def window_sequences(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """A sequence without captures and delimiters, by windows over its regions.

    From the last step to the first, a column holds whether the steps from
    there on consume the rest of the region, starting at this token.  What holds
    at the region's end is known when planning.  All windows share one
    partitioning and order, so the plan has one exchange and one sort.
    """
    steps = rule.steps
    if not steps:
        return _finding(tokens.filter(F.lit(False)), index)
    if gapped(steps):
        return gapped_sequences(tokens, index, rule)
    if rule.in_scope and single_run(steps):
        return runs_in_blocks(tokens, index, rule)
    if not rule.in_scope and single_run(steps):
        return run_to_the_end(tokens, index, rule)
    start = accepts(steps[0]) if must_start(steps[0]) else None
    df = regions(tokens, rule, [*carried(start), *(accepts(s).alias(f"a{i}") for i, s in enumerate(steps))])
    if rule.in_scope:
        df = _useful_blocks(df, steps)
    order = backward()
    df = df.withColumn(f"f{len(steps)}", F.lit(False))
    for i in reversed(range(len(steps))):
        holds = step_holds(steps[i], F.col(f"a{i}"), F.col(f"f{i + 1}"), tail_matches(steps[i + 1 :]), order)
        df = df.withColumn(f"f{i}", holds).drop(f"f{i + 1}", f"a{i}")
    return _finding(first_region(df.filter("f0"), rule), index, F.col("open"))


def backward():
    """Regions from their last token to their first.

    So what lies ahead of a token is a running window.  A frame from each token to
    the region's end would be computed anew for each.
    """
    return Window.partitionBy("file", "open").orderBy(F.desc("pos"))


def ahead(order, least: int = 0):
    """From the region's end to the token ``least`` places ahead of the current one."""
    return order.rowsBetween(Window.unboundedPreceding, -least)


def step_holds(step, accepted: Column, then: Column, at_end: bool, order) -> Column:
    """Whether ``step`` and what follows it consume the rest of the region from here on.

    ``then`` is the same for what follows, at each token; ``at_end`` at the region's end.
    ``order`` is that of ``backward``.
    """
    if step.quant == "zero_or_more":
        rest, place = ahead(order), F.col("pos").cast("long")
        goal = F.coalesce(F.min(F.when(then, place)).over(rest), F.lit(_END if at_end else _END + 1))
        stop = F.coalesce(F.min(F.when(~accepted, place)).over(rest), F.lit(_END))
        return goal <= stop
    holds = accepted & F.lag(then, 1, at_end).over(order)
    return then | holds if step.quant == "optional" else holds


def _useful_blocks(df: DataFrame, steps) -> DataFrame:
    """Only blocks in which every needed, positive step is accepted by some token."""
    needed = [i for i, s in enumerate(steps) if s.quant == "one" and not s.negate and any(s.alternatives)]
    if not needed:
        return df
    # The sequence's own order, so that its sort serves both.
    block = backward().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for i in needed:
        df = df.withColumn(f"some{i}", F.max(f"a{i}").over(block))
    return df.filter(reduce(lambda a, b: a & b, (F.col(f"some{i}") for i in needed))).drop(*(f"some{i}" for i in needed))


def first_region(df: DataFrame, rule: Rule) -> DataFrame:
    """A token that starts a match in several blocks is found once, by the outermost."""
    if not rule.in_scope:
        return df
    return df.groupBy("file", "pos").agg(F.min("open").alias("open"), F.first("_payload").alias("_payload"))
