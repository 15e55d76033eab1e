"""Rules written as YAML."""

from __future__ import annotations

from typing import Any

import yaml

from ..schema import LANGUAGES
from .ast import RawRule, RawStep, RuleError, RuleFile


def _get(data: Any, key: str, kind: type, what: str, default=None):
    if not isinstance(data, dict):
        raise RuleError(f"{what}: expected a mapping")
    value = data.get(key)
    if value is None:
        return default
    if not isinstance(value, kind):
        raise RuleError(f"{what}: `{key}` has the wrong type")
    return value


def _strings(value: Any, what: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise RuleError(f"{what}: expected a list of strings")
    return value


def _step(data: Any, what: str) -> RawStep:
    attrs = {str(k): v for k, v in _get(data, "attrs", dict, what, {}).items()}
    alt = _get(data, "alt", list, what)
    if alt is not None:
        if not all(isinstance(a, list) for a in alt):
            raise RuleError(f"{what}: each `alt` alternative must be a list of steps")
        alt = [[_step(s, what) for s in a] for a in alt]
    bind = {str(k): str(v) for k, v in _get(data, "bind", dict, what, {}).items()}
    return RawStep(attrs, _get(data, "quant", str, what), bool(data.get("negate")), bind, alt)


def _rule(data: Any) -> RawRule:
    name = _get(data, "id", str, "rule")
    if name is None:
        raise RuleError("a rule has no `id`")
    what = f"rule {name}"
    severity = _get(data, "severity", str, what)
    if severity not in ("error", "warning"):
        raise RuleError(f"{what}: `severity` must be error or warning")
    rule = RawRule(name, severity, _get(data, "description", str, what), _get(data, "message", str, what))
    applies = _get(data, "applies_to", dict, what, {})
    if applies.get("languages") is not None:
        rule.languages = _strings(applies["languages"], what)
        for language in rule.languages:
            if language not in LANGUAGES:
                raise RuleError(f"{what}: unknown language `{language}`")
    paths = _get(applies, "paths", dict, what, {})
    rule.include = _strings(paths.get("include") or [], what)
    rule.exclude = _strings(paths.get("exclude") or [], what)
    rule.match = _get(data, "match", dict, what)
    sequence = _get(data, "match_sequence", dict, what)
    if sequence is not None:
        rule.steps = [_step(s, what) for s in _get(sequence, "steps", list, what, [])]
        within = _get(_get(sequence, "anchor", dict, what, {}), "within", str, what, "")
        rule.in_scope = "ScopeStart" in within and "ScopeEnd" in within
    where = _get(data, "where_scope", dict, what, {})
    rule.where = {k: _get(where, k, dict, what) for k in ("contains", "not_contains", "followed_by") if where.get(k) is not None}
    compose = _get(data, "compose", dict, what)
    if compose is not None:
        key = compose.get("key") or []
        rule.compose = (_get(compose, "op", str, what, ""), _strings(compose.get("of") or [], what), [key] if isinstance(key, str) else _strings(key, what))
    count = _get(data, "count", dict, what)
    if count is not None:
        n = count.get("n")
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise RuleError(f"{what}: `count.n` must be a whole number")
        rule.count = (_get(count, "rule", str, what, ""), _get(count, "scope", str, what, "file"), _get(count, "op", str, what, ""), n)
    unless = _get(data, "unless", dict, what, {})
    if (globs := unless.get("path.matches")) is not None:
        rule.unless["path"] = [globs] if isinstance(globs, str) else _strings(globs, what)
    if "waiver.exists" in unless:
        rule.unless["waiver"] = _get(unless["waiver.exists"] or {}, "rule", str, what, name)
    if "adr.exists" in unless:
        rule.unless["adr"] = _get(unless["adr.exists"], "topic", str, what, "")
    return rule


def parse(text: str) -> RuleFile:
    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise RuleError(f"invalid YAML: {e}") from None
    rules = [_rule(r) for r in _get(data, "rules", list, "rules file", [])]
    return RuleFile(rules, _get(data, "waivers_dir", str, "rules file"), _get(data, "adr_dir", str, "rules file"))
