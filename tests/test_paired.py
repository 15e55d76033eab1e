"""Balanced delimiters and captures by windows, against search."""

import random
from functools import reduce

import pytest

from lexloom.operators import paired, search
from lexloom.rules.compile import load_dsl, load_yaml

from .helpers import found, tuple_tokens

BODIES = [
    '"(" any * ")" any *',
    '"{" any * "}"',
    'a "(" ")" any *',
    'a "(" any ")" b any *',
    'a "(" b any * ")" any *',
    'a ? "(" not b * ")" any *',
    '"(" a any b + ")" any *',
    '"(" a * ")" not a *',
    '"{" any * a any * "}" any *',
    '"(" any * a any * b any * ")" a *',
    'any * "(" any * ")" any * "{" a * "}" any *',
    '"(" any * "}" any *',
    '")" any * "(" b * ")" any *',
    '"(" any any any ")" any *',
    'x:@ident "b" :x any *',
    'x:@ident any :x :x any *',
    'a any * x:@ident any :x any *',
    'x:@ident not :x any *',
    'x:any y:any (:x | :y) any *',
    'f:@ident "(" any ")" :f any *',
    'f:@ident (a | b) :f any *',
    'x:@ident "(" any * ")" any *',
    '"[" any * "]" any *',
]


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(11)
    out = {}
    for i in range(220):
        letters = "ab(){}" if i % 3 else "aab(()){}[]"
        out[f"f{i:03}"] = [rng.choice(letters) for _ in range(rng.randrange(1, 16))]
    def nested(depth):
        inner = [rng.choice("aabb")]
        for _ in range(rng.randrange(0, 4)):
            part = nested(depth - 1) if depth else [rng.choice("ab")]
            inner += rng.choice([["(", *part, ")"], ["{", *part, "}"], part])
        return inner

    out |= {f"n{i:03}": ["{", *nested(3), "}"] for i in range(150)}
    out |= {"long": ["a", "(", *["b"] * 40, ")", "b"], "deep": ["{"] * 9 + ["a", "(", "b", ")", "b"] + ["}"] * 9, "loose": ["a", "(", "b", "b", "{", ")", "a"]}
    tokens = tuple_tokens(spark, out).cache()
    yield tokens
    tokens.unpersist()


@pytest.mark.parametrize("scope", ["", "in scope "])
@pytest.mark.parametrize("part", range(4))
def test_windows_equal_search(streams, scope, part):
    bodies = BODIES[part::4]
    rules = [load_dsl(f"rule R {{ sequence {scope}{{ {b} }} }}")[0][0] for b in bodies]
    assert all(paired.plannable(r) for r in rules), [b for b, r in zip(bodies, rules) if not paired.plannable(r)]

    def run(how):
        parts = [how(streams, i, r) for i, r in enumerate(rules)]
        return {i: {(r["file"], r["pos"]) for r in rows} for i, rows in _by_rule(reduce(lambda a, b: a.unionAll(b), parts).collect(), len(rules)).items()}

    fast, slow = run(paired.paired_sequences), run(search.searched_sequences)
    for i, body in enumerate(bodies):
        assert fast[i] == slow[i], body
    assert sum(map(len, slow.values())) > 30


def _by_rule(rows, n):
    out = {i: [] for i in range(n)}
    for r in rows:
        out[r["rule"]].append(r)
    return out


@pytest.mark.parametrize("body", ['"(" any *', '"(" "(" any * ")" ")"', '"(" a * b * ")"', 'x:@ident any * "b" :x', "x:@ident x:@ident :x", '"{" any * x:@ident "}" :x any * :x'])
def test_other_shapes_are_searched(spark, body):
    assert not paired.plannable(load_dsl(f"rule R {{ sequence {{ {body} }} }}")[0][0])
    found(tuple_tokens(spark, {"f": ["a", "(", "b", ")"]}), f"sequence {{ {body} }}")


def test_plans_hold_no_python(streams):
    rule = load_dsl('rule R { sequence in scope { a "(" any * ")" any * } }')[0][0]
    plan = search.sequences(streams, 0, rule)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and plan.count("Exchange hashpartitioning(file") == 2  # one for the blocks, one to find each start once


def test_fields_other_than_the_text(streams):
    text = """
rules:
  - id: R
    severity: error
    match_sequence:
      steps:
        - {attrs: {class: ident}, bind: {k: node_kind, u: nothing}}
        - {attrs: {text.ne_ref: k, class.eq_ref: v}, negate: true}
        - {attrs: {node_kind.ne_ref: k}}
        - {attrs: {}, quant: zero_or_more}
"""
    rule = load_yaml(text)[0][0]
    assert paired.plannable(rule)
    fast, slow = ({(r["file"], r["pos"]) for r in how(streams, 0, rule).collect()} for how in (paired.paired_sequences, search.searched_sequences))
    assert fast == slow and fast
