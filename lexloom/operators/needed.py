"""What rules need of the tokens: columns, and tokens that may count at all.

A lexer that knows makes and sends on no more than that.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..rules.ast import Pred, Rule
from ..schema import TOKENS
from .primary import gapped

#: Fields of predicates that are made of other columns, or go by another name.
_MADE_OF = {"kind": ("node_kind",), "range_lines": ("start_line", "end_line"), "text_len": ("start_byte", "end_byte")}
#: Columns by whose values tokens are passed over.
_TOLD_BY = ("text", "node_kind", "class")


def rules_for(rules: list[Rule], asked: Iterable[str]) -> list[Rule]:
    """The rules that tell the findings of those asked for: themselves, and those that they are made of."""
    ids = set(asked)
    for r in rules:
        if r.id in asked and r.aggregate:
            ids.update(r.compose[1] if r.compose else r.count[:1])
    return [r for r in rules if r.id in ids]


def _conjunctions(rule: Rule) -> list[tuple[Pred, ...]]:
    if rule.steps is not None:
        return [a for s in rule.steps for a in s.alternatives]
    return [rule.match or (), *(preds for _, preds in rule.where)]


def columns(rules: list[Rule], shown: Iterable[str]) -> tuple[str, ...]:
    """Columns of the tokens that plans of ``rules`` read, and those that are ``shown`` of findings."""
    out = {"file", "pos", *shown}
    for r in rules:
        if r.languages is not None:
            out.add("language")
        if r.aggregate:
            out.update({"function"} & {*(r.compose[2] if r.compose else r.count[1:2])})
            continue
        fields = {p.field for preds in _conjunctions(r) for p in preds} | {f for s in r.steps or () for _, f in s.bind}
        for f in fields:
            out.update(_MADE_OF.get(f, (f,)))
        if r.where or r.in_scope:
            out.update(("node_kind", "jmp"))
        if r.in_scope:
            out.add("block_path")
        if r.steps is not None:
            out.add("jmp")
    return tuple(f for f in TOKENS.names if f in out)


def _values(preds: tuple[Pred, ...]) -> tuple[str, tuple[str, ...]] | None:
    """A column and its values at tokens that ``preds`` accept; None if nothing tells."""
    for p in preds:
        field = "node_kind" if p.field == "kind" else p.field
        if field in _TOLD_BY and p.op in ("eq", "any"):
            return field, (p.value,) if p.op == "eq" else tuple(p.value)
    return None


def wanted(rules: list[Rule]) -> dict[str, set[str]] | None:
    """Values of columns of which a token has one at least, unless no rule's plan looks at it; None if all may count."""
    out: dict[str, set[str]] = {}
    for r in rules:
        if r.aggregate:
            continue
        if r.steps is not None and (not gapped(r.steps) or any(s.bind or s.has_refs or s.delimiter or s.negate for s in r.steps)):
            return None
        own = [a for s in r.steps[::2] for a in s.alternatives] if r.steps is not None else _conjunctions(r)
        for found in map(_values, own):
            if found is None:
                return None
            out.setdefault(found[0], set()).update(found[1])
        if r.where:
            out.setdefault("node_kind", set()).update("{}")
    return out
