"""Sequences with captures or balanced delimiters, by search within a region.

Spark evaluates every predicate that needs no binding and sends one bit per
step; the search works on those bits, the fields that are bound or compared,
and the delimiter links.  It is iterative and remembers every state it has
tried (step, position, bindings, open delimiters), so no state is tried twice.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import conjunction, token_field
from ..rules.ast import Rule, Step
from .paired import paired_sequences, plannable
from .primary import _finding, carried, first_region, must_start, outermost, regions, window_sequences


#: The bit of tokens at which all steps of a fixed beginning are accepted.
_START = 62
#: States that a region's search remembers from one start to the next.
STATES = 500_000
#: Tokens that starts are walked over side by side; the few that are undecided then are searched one by one.
WALK = 256


class _Places:
    """Where the tokens of a region accept an alternative, or have a value."""

    def __init__(self, masks: list[int], values: dict[str, list]):
        self.masks, self.values = masks, values
        self.bits: dict[int, list[int]] = {}
        self.same: dict[str, dict] = {}

    def of_bit(self, bit: int) -> list[int]:
        if bit not in self.bits:
            self.bits[bit] = [p for p, m in enumerate(self.masks) if m >> bit & 1]
        return self.bits[bit]

    def of_value(self, field: str, value: str | None) -> list[int]:
        if field not in self.same:
            where: dict = {}
            for p, v in enumerate(self.values[field]):
                where.setdefault(v, []).append(p)
            self.same[field] = where
        return self.same[field].get(value, []) if value is not None else []


class Matcher:
    """Starts at which ``steps`` consume the rest of a region of tokens."""

    def __init__(self, steps: tuple[Step, ...]):
        self.steps = steps
        self.flagged = False  # whether masks tell where a match may start
        #: Alternatives get one bit each, in step order.
        self.bits: list[list[int]] = []
        n = 0
        for s in steps:
            self.bits.append(list(range(n, n + len(s.alternatives))))
            n += len(s.alternatives)
        #: Steps that take any number of any tokens: the next step's candidates are looked up, not walked to.
        self.free = [s.quant == "zero_or_more" and not s.negate and not s.bind and not s.delimiter and s.alternatives == ((),) for s in steps]
        #: Steps at the beginning that take one token each, without references: Spark finds where they all hold.
        self.fixed = next((i for i, s in enumerate(steps) if s.quant != "one" or s.has_refs), len(steps))
        self.refs = [[[p for p in a if p.op in ("eq_ref", "ne_ref")] for a in s.alternatives] for s in steps]

    @property
    def fields(self) -> list[str]:
        """Fields whose values the search needs."""
        bound = {attr for s in self.steps for _, attr in s.bind}
        return sorted(bound | {p.field for step in self.refs for a in step for p in a})

    def accepts(self, s: int, mask: int, values: dict, at: int, binds: dict[str, str]) -> bool:
        found = False
        for bit, refs in zip(self.bits[s], self.refs[s]):
            if mask >> bit & 1 and all(self._ref(p, values, at, binds) for p in refs):
                found = True
                break
        return found != self.steps[s].negate

    @staticmethod
    def _ref(pred, values: dict, at: int, binds: dict[str, str]) -> bool:
        have, bound = values[pred.field][at], binds.get(pred.value)
        if have is None or bound is None:
            return False
        return (have == bound) == (pred.op == "eq_ref")

    def starts(self, masks: list[int], values: dict[str, list], partners: list[int | None], among: list[int] | None = None) -> list[int]:
        known: dict = {}  # states that were tried, and whether they led to the end
        places = _Places(masks, values)
        out = []
        for p in self.possible(masks) if among is None else among:
            if self._match(p, masks, values, partners, known, places):
                out.append(p)
            if len(known) > STATES:  # states with bindings are of use to starts that bind alike only
                known = {state: led for state, led in known.items() if not state[2]}
        return out

    def _next(self, s: int, at: int, limit: int, binds: dict[str, str], places: _Places) -> list[int]:
        """Positions from ``at`` to ``limit`` that step ``s``, which takes one token, may accept."""
        found: set[int] = set()
        for bit, refs in zip(self.bits[s], self.refs[s]):
            own = places.of_bit(bit)
            for ref in refs:
                if ref.op == "eq_ref":
                    same = places.of_value(ref.field, binds.get(ref.value))
                    own = same if len(same) < len(own) else own
            found.update(own[bisect_left(own, at) : bisect_right(own, limit)])
        return sorted(found)

    def possible(self, masks: list[int]) -> list[int]:
        """Positions that the first step may take, if it must take one."""
        if not self.steps:
            return []
        if self.flagged:
            return [p for p, m in enumerate(masks) if m >> _START & 1]
        first = self.steps[0]
        if first.quant != "one" or first.negate:
            return list(range(len(masks)))
        bits = self._bits(0)
        return [p for p, m in enumerate(masks) if m & bits]

    def _bits(self, s: int) -> int:
        return sum(1 << b for b in self.bits[s])

    def bound_at(self) -> dict[str, tuple[int, str]] | None:
        """Where each variable is bound, as the step and the field, if starts can be walked side by side; else None.

        Then no delimiters count, variables are bound once and by the single tokens at
        the beginning, and only the last step takes any number of any tokens.
        """
        ones = next((i for i, s in enumerate(self.steps) if s.quant != "one"), len(self.steps))
        bound = [(var, (i, f)) for i, s in enumerate(self.steps) for var, f in s.bind]
        late = any(i >= ones for _, (i, _) in bound) or len({var for var, _ in bound}) < len(bound)
        if not self.steps or late or not self.free[-1] or any(self.free[:-1]) or any(s.delimiter for s in self.steps):
            return None
        return dict(bound)

    def walk(self, masks: np.ndarray, first: np.ndarray, ends: np.ndarray, codes: dict[str, np.ndarray], bound: dict) -> tuple[np.ndarray, np.ndarray]:
        """(rows at which a match starts, rows that are undecided after WALK tokens) of the starts ``first`` in regions that end at ``ends``.

        Of all starts at once, the steps that may take the next token are bits.
        """
        hits, last = [], len(self.steps) - 1
        state = np.ones(len(first), np.int64)
        for ahead in range(WALK):
            for s, step in enumerate(self.steps):
                if step.quant != "one":
                    state |= (state >> s & 1) << (s + 1)
            done = (state >> last & 1) == 1
            hits.append(first[done])
            left = ~done & (state != 0) & (first + ahead < ends)
            first, ends, state = first[left], ends[left], state[left]
            if not len(first):
                break
            at, then = first + ahead, np.zeros(len(first), np.int64)
            for s, step in enumerate(self.steps):
                own = np.flatnonzero(state >> s & 1)
                if len(own):
                    taken = self._taken(s, masks, at[own], first[own], codes, bound)
                    then[own] |= taken.astype(np.int64) << (s if step.quant == "zero_or_more" else s + 1)
            state = then
        return np.sort(np.concatenate(hits)), first

    def _taken(self, s: int, masks: np.ndarray, at: np.ndarray, first: np.ndarray, codes: dict[str, np.ndarray], bound: dict) -> np.ndarray:
        """``accepts`` for many places."""
        found = np.zeros(len(at), bool)
        for bit, refs in zip(self.bits[s], self.refs[s]):
            here = (masks[at] >> bit & 1) == 1
            for ref in refs:
                where, field = bound.get(ref.value, (s, ""))
                if where >= s:  # nothing is bound yet
                    here[:] = False
                    continue
                have, want = codes[ref.field][at], codes[field][first + where]
                here &= (have >= 0) & (want >= 0) & ((have == want) == (ref.op == "eq_ref"))
            found |= here
        return found != self.steps[s].negate

    def search(self, masks: np.ndarray, starts: np.ndarray, column, known: list[str], coded=None) -> list[int]:
        """Rows at which a match starts, over many regions at once.

        Regions without any lexeme for a step that needs one are passed over.
        ``column`` gives the values of a column between two rows, ``coded`` numbers
        that are equal where values of fields are, -1 for null.
        """
        bound = self.bound_at() if self.flagged and coded else None
        if bound is not None:
            first = np.flatnonzero(masks >> _START & 1)
            ends = np.append(starts[1:], len(masks))
            region = np.searchsorted(starts, first, "right") - 1
            hits, open_ = self.walk(masks, first, ends[region], coded(self.fields), bound)
            out = hits.tolist()
            for a in np.unique(starts[np.searchsorted(starts, open_, "right") - 1]).tolist():
                b = int(ends[np.searchsorted(starts, a)])
                values = {f: column(f"_v_{f}", a, b) if f in known else [None] * (b - a) for f in self.fields}
                among = (open_[(open_ >= a) & (open_ < b)] - a).tolist()
                out += [a + i for i in self.starts(masks[a:b].tolist(), values, [None] * (b - a), among)]
            return sorted(out)
        some = np.bitwise_or.reduceat(masks, starts)
        useful = np.ones(len(starts), bool)
        for s, step in enumerate(self.steps):
            if step.quant == "one" and not step.negate:
                useful &= (some & self._bits(s)) != 0
        ends, out = np.append(starts[1:], len(masks)), []
        for a, b in zip(starts[useful].tolist(), ends[useful].tolist()):
            pos = column("pos", a, b)
            index_of = {p: i for i, p in enumerate(pos)}
            partners = [index_of.get(j) if j is not None else None for j in column("jmp", a, b)]
            values = {f: column(f"_v_{f}", a, b) if f in known else [None] * len(pos) for f in self.fields}
            out += [a + i for i in self.starts(masks[a:b].tolist(), values, partners)]
        return out

    def _match(self, start: int, masks, values, partners, known: dict, places: _Places) -> bool:
        steps, n = self.steps, len(masks)
        todo = [((0, start, (), ()), None)]
        came: dict = {}  # the state from which each was first reached
        while todo:
            state, parent = todo.pop()
            s, at, binds, stack = state
            if s == len(steps) and at == n or known.get(state):
                while parent is not None:
                    known[parent] = True
                    parent = came[parent]
                return True
            if s == len(steps) or state in known:
                continue
            known[state] = False
            came[state] = parent
            step, bound = steps[s], dict(binds)
            if self.free[s]:
                limit = min(n, stack[-1]) if stack else n
                if s + 1 == len(steps):
                    todo += [((s + 1, n, binds, stack), state)] if limit == n else []
                    continue
                if steps[s + 1].quant == "one" and not steps[s + 1].negate:
                    todo += [((s + 1, q, binds, stack), state) for q in reversed(self._next(s + 1, at, limit, bound, places))]
                    continue
            taken = at < n and self.accepts(s, masks[at], values, at, bound)
            if step.quant != "one":
                todo.append(((s + 1, at, binds, stack), state))  # take no (more) token
                if not taken or stack and at >= stack[-1]:
                    continue
            elif not taken:
                continue
            if step.bind:
                bound.update((var, values[f][at]) for var, f in step.bind if values[f][at] is not None)
                binds = tuple(sorted(bound.items()))
            if step.delimiter and partners[at] is not None:
                if partners[at] > at:
                    stack = (*stack, partners[at])
                elif stack:
                    if stack[-1] != at:
                        continue
                    stack = stack[:-1]
            todo.append(((s if step.quant == "zero_or_more" else s + 1, at + 1, binds, stack), state))
        return False


def searched_sequences(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """Any sequence rule, one region at a time."""
    matcher = Matcher(rule.steps)
    parts = []
    for s, step in enumerate(rule.steps):
        for bit, preds in zip(matcher.bits[s], step.alternatives):
            free = tuple(p for p in preds if p.op not in ("eq_ref", "ne_ref"))
            parts.append(F.when(conjunction(free), F.lit(1 << bit)).otherwise(0))
    if len(parts) > 62:
        raise ValueError(f"rule {rule.id}: more than 62 alternatives in one sequence")
    mask = parts[0].cast("long") if parts else F.lit(0).cast("long")
    for p in parts[1:]:
        mask = mask.bitwiseOR(p.cast("long"))
    fields = matcher.fields
    known = [f for f in fields if token_field(f) is not None]
    start = None
    if rule.steps and must_start(rule.steps[0]) and not rule.steps[0].negate:
        start = mask.bitwiseAND(matcher._bits(0)) != 0
    columns = [*carried(start), "jmp", mask.alias("_mask"), *(token_field(f).cast("string").alias(f"_v_{f}") for f in known)]
    df = regions(tokens, rule, columns)
    if matcher.fixed > 1:
        df = _with_starts(df, matcher)
    else:
        df = df.repartition("file", "open")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the region that a batch breaks off
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            starts = _region_starts(rows)
            held = rows.slice(starts[-1])
            yield from found(rows.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from found(held, np.zeros(1, np.int64))

    def found(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.num_rows == 0:
            return
        def coded(wanted: list[str]) -> dict[str, np.ndarray]:
            own = [f for f in wanted if f in known]
            out = {f: np.full(rows.num_rows, -1) for f in wanted}
            if own:
                values = pa.chunked_array([c for f in own for c in rows.column(f"_v_{f}").chunks]).combine_chunks()
                codes = pc.fill_null(values.dictionary_encode().indices, -1).to_numpy()
                out |= dict(zip(own, codes.reshape(len(own), -1)))
            return out

        hits = matcher.search(rows.column("_mask").to_numpy(), starts, lambda name, a, b: rows.column(name).slice(a, b - a).to_pylist(), known, coded)
        if hits:
            yield from rows.select(["open", "file", "pos", "_payload"]).take(pa.array(hits, pa.int64())).combine_chunks().to_batches()

    ordered = df.sortWithinPartitions("file", "open", "pos")
    hits = ordered.mapInArrow(search, df.select("open", "file", "pos", "_payload").schema)
    return _finding(first_region(hits, rule), index, F.col("open"))


def _with_starts(df: DataFrame, matcher: Matcher) -> DataFrame:
    """Regions in which the fixed beginning holds somewhere, with a bit where it does: by windows whose exchange the search shares."""
    matcher.flagged = True
    order = Window.partitionBy("file", "open").orderBy("pos")
    holds = None
    for i in range(matcher.fixed):
        taken = F.col("_mask").bitwiseAND(F.lit(matcher._bits(i))) != 0
        here = F.lead(~taken if matcher.steps[i].negate else taken, i, False).over(order)
        holds = here if holds is None else holds & here
    df = df.withColumn("_starts", holds)
    df = df.withColumn("_some", F.max("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    mask = F.when(F.col("_starts"), F.col("_mask").bitwiseOR(F.lit(1 << _START))).otherwise(F.col("_mask")).alias("_mask")
    return df.filter("_some").select(*(mask if c == "_mask" else c for c in df.columns if c not in ("_starts", "_some")))


def _region_starts(rows: pa.Table) -> np.ndarray:
    """Where a region begins in rows sorted by file and opener."""
    new = np.ones(rows.num_rows, bool)
    for name in ("file", "open"):
        column = rows.column(name).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if name == "file" else new[1:] | differs
    return np.flatnonzero(new)


def sequences(tokens: DataFrame, index: int, rule: Rule) -> DataFrame:
    """The cheapest plan that a sequence rule allows."""
    repeat = repeated_later(rule)
    if repeat is not None:
        return _repeats(tokens, index, rule, repeat)
    if any(s.bind or s.has_refs or s.delimiter for s in rule.steps):
        return (paired_sequences if plannable(rule) else searched_sequences)(tokens, index, rule)
    return window_sequences(tokens, index, rule)


def repeated_later(rule: Rule):
    """The predicates of ``x:PATTERN any* :x any*``, or None for another shape."""
    s = rule.steps
    free = lambda step: step.quant == "zero_or_more" and not step.negate and step.alternatives == ((),)
    if len(s) != 4 or not free(s[1]) or not free(s[3]) or s[0].negate or s[2].negate:
        return None
    if s[0].quant != "one" or s[2].quant != "one" or len(s[0].bind) != 1 or s[2].bind or s[0].has_refs:
        return None
    var, attr = s[0].bind[0]
    if attr != "text" or len(s[2].alternatives) != 1 or len(s[0].alternatives) != 1:
        return None
    ref = s[2].alternatives[0]
    if len(ref) != 1 or ref[0].op != "eq_ref" or ref[0].field != "text" or ref[0].value != var:
        return None
    return s[0].alternatives[0]


def _repeats(tokens: DataFrame, index: int, rule: Rule, preds) -> DataFrame:
    """A bound text that occurs again: the last position of each text in its region, of blocks in the outermost."""
    first = conjunction(preds)
    df = (outermost if rule.in_scope else regions)(tokens, rule, [*carried(first), F.col("text").alias("_text"), first.alias("_first")])
    last = F.max("pos").over(Window.partitionBy("file", "open", "_text"))
    found = df.withColumn("_last", last).filter(F.col("_first") & (F.col("_last") > F.col("pos")))
    return _finding(found, index, F.col("open"))
