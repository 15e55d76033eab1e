"""Rules as they are written (Raw...) and as they are planned (the rest)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Attrs = dict[str, Any]


class RuleError(ValueError):
    """A rule file that cannot be read or compiled."""


@dataclass
class RawStep:
    attrs: Attrs = field(default_factory=dict)
    quant: str | None = None
    negate: bool = False
    bind: dict[str, str] = field(default_factory=dict)
    alt: list[list[RawStep]] | None = None


@dataclass
class RawRule:
    id: str
    severity: str = "error"
    description: str | None = None
    message: str | None = None
    languages: list[str] | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    match: Attrs | None = None
    steps: list[RawStep] | None = None
    in_scope: bool = False
    #: contains, not_contains, followed_by -> attrs
    where: dict[str, Attrs] = field(default_factory=dict)
    compose: tuple[str, list[str], list[str]] | None = None  # op, of, key
    count: tuple[str, str, str, int] | None = None  # rule, scope, op, n
    #: path -> globs, waiver -> rule id, adr -> topic
    unless: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


@dataclass
class RuleFile:
    rules: list[RawRule] = field(default_factory=list)
    waivers_dir: str | None = None
    adr_dir: str | None = None


@dataclass(frozen=True)
class Pred:
    """``field op value``; value is a string, a tuple of strings, a Java regex or a number."""

    field: str
    op: str  # eq any regex not_regex gt lt ge le eq_ref ne_ref
    value: Any
    source: Any = None  # the regex as written


@dataclass(frozen=True)
class Step:
    #: Alternatives, each a conjunction; a plain step has one.
    alternatives: tuple[tuple[Pred, ...], ...]
    quant: str = "one"  # one optional zero_or_more
    negate: bool = False
    bind: tuple[tuple[str, str], ...] = ()
    is_set: bool = False  # written as an alternation or a set

    @property
    def has_refs(self) -> bool:
        return any(p.op in ("eq_ref", "ne_ref") for a in self.alternatives for p in a)

    @property
    def delimiter(self) -> bool:
        """A positive literal of exactly one bracket, which is balanced against its partner."""
        if self.negate or self.is_set or len(self.alternatives[0]) != 1 or self.quant != "one":
            return False
        pred = self.alternatives[0][0]
        return pred.field == "text" and pred.op == "eq" and pred.value in ("(", ")", "{", "}", "[", "]")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    description: str | None
    message: str | None
    languages: tuple[str, ...] | None
    include: tuple[str, ...]  # anchored Java regexes
    exclude: tuple[str, ...]
    match: tuple[Pred, ...] | None = None
    where: tuple[tuple[str, tuple[Pred, ...]], ...] = ()
    steps: tuple[Step, ...] | None = None
    in_scope: bool = False
    compose: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    count: tuple[str, str, str, int] | None = None
    unless_path: tuple[str, ...] | None = None
    unless_waiver: str | None = None
    unless_adr: str | None = None

    @property
    def aggregate(self) -> bool:
        return self.compose is not None or self.count is not None
