"""Matches, scopes, sequences, aggregates and suppression over tokens."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import primary, search
from lexloom.operators.aggregate import summary
from lexloom.plans.engine import Context, check_tokens
from lexloom.rules.ast import Rule, Step
from lexloom.rules.compile import compile_pred, load_dsl
from lexloom.schema import TOKENS

from .helpers import check, found, source_tokens, tuple_tokens


@pytest.fixture(scope="module")
def block(spark):
    return tuple_tokens(spark, {"f": "a { b { c d } b } d".split(), "g": ["x", "{", "}", "y"]}).cache()


def test_plain_matches(spark):
    tokens = tuple_tokens(spark, {"f": [("k", "num", "12", ""), ("k", "num", "7", ""), ("k", "ident", "x", "fn"), ("k", "str", "nine", "")]})
    assert found(tokens, "match Token[text > 7]") == [("f", 0)]
    assert found(tokens, "match Token[text <= 7]") == [("f", 1)]
    assert found(tokens, "match Token[nothing !~ /x/]") == [("f", i) for i in range(4)]
    assert found(tokens, 'match Token[nothing = "x"]') == []
    assert found(tokens, "match :x") == []
    assert found(tokens, 'match Token[function = "fn"]') == [("f", 2)]
    assert found(tokens, 'match Token[start_line = 3, range_lines = 1, text_len = 1, named = "true"]') == [("f", 2)]
    assert found(tokens, "match Token[text in []]") == []


def test_plain_matches_do_not_shuffle(spark):
    tokens = tuple_tokens(spark, {"f": ["a"]})
    rules = load_dsl("rule A { match a } rule B { match /b/ } rule C { match @ident }")[0]
    plan = check_tokens(tokens, rules, ordered=False)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_fused_rules(spark):
    rows = check(tuple_tokens(spark, {"f": ["a", "b", "c"]}), "rule A { match a } rule B { match /[ab]/ } rule C { lang go match a }")
    assert [(r["rule_id"], r["matched"]["text"]) for r in rows] == [("A", "a"), ("B", "a"), ("B", "b")]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("match b where scope contains c", [("f", 2), ("f", 7)]),
        ("match a where scope contains c", [("f", 0)]),
        ("match c where scope contains c", []),
        ("match b where scope contains b", [("f", 2), ("f", 7)]),
        ("match b where scope not contains c", []),
        ("match c where scope not contains c", [("f", 4)]),
        ("match b where scope followed by b", [("f", 2)]),
        ("match x where scope followed by y", [("g", 0)]),
        ('match x where scope contains "{"', [("g", 0)]),
        ('match c where scope contains "{"', []),
        ("match b where scope contains c where scope followed by c", [("f", 2)]),
        ("match any where scope contains nothing", []),
    ],
)
def test_scopes(block, body, want):
    assert found(block, body) == want


def naive_scope(kinds, target, clause, kind):
    from lexloom.operators.lexemes import links

    partner = links(kinds)
    out = []
    for i, k in enumerate(kinds):
        if k != target:
            continue
        around = [o for o in range(i) if kinds[o] == "{" and partner[o] is not None and partner[o] > i]
        low, high = (max(around), partner[max(around)]) if around else (-1, len(kinds))
        others = [j for j in range(low + 1, high) if j != i and kinds[j] == clause]
        hit = {"contains": bool(others), "not contains": not others, "followed by": any(j > i for j in others)}[kind]
        if hit:
            out.append(i)
    return out


def test_scopes_match_a_direct_reading(spark):
    rng = random.Random(1)
    streams = {f"f{i:03}": [rng.choice("{}()ab") for _ in range(rng.randrange(1, 16))] for i in range(150)}
    tokens = tuple_tokens(spark, streams).cache()
    for kind, clause in itertools.product(("contains", "not contains", "followed by"), ("b", "{")):
        want = sorted((f, i) for f, s in streams.items() for i in naive_scope(s, "a", clause, kind))
        assert found(tokens, f'match a where scope {kind} "{clause}"') == want


def naive(steps, region, partners):
    """Direct recursive reading of sequence matching; steps are (set, negate, quant, delimiter, bind, ref)."""

    def accept(step, at, binds):
        texts, negate, *_, ref = step
        hit = region[at] in texts if texts is not None else True
        if ref:
            hit = hit and binds.get(ref) == region[at]
        return hit != negate

    def go(s, at, binds, stack):
        if s == len(steps):
            return at == len(region)
        _, _, quant, delimiter, bind, _ = steps[s]
        barrier = stack[-1] if stack else len(region)
        ok = at < len(region) and accept(steps[s], at, binds)
        after = {**binds, bind: region[at]} if ok and bind else binds
        if quant == "one":
            if not ok:
                return False
            p = partners[at]
            if delimiter and p is not None:
                if p > at:
                    return go(s + 1, at + 1, after, [*stack, p])
                if stack:
                    return stack[-1] == at and go(s + 1, at + 1, after, stack[:-1])
            return go(s + 1, at + 1, after, stack)
        if go(s + 1, at, binds, stack):
            return True
        return ok and at < barrier and go(s if quant == "zero_or_more" else s + 1, at + 1, after, stack)

    return [p for p in range(len(region)) if go(0, p, {}, [])]


def random_steps(rng, captures):
    steps = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.random()
        if captures and kind < 0.25:
            d = rng.choice("(){}")
            steps.append(({d}, False, "one", True, None, None))
        elif captures and kind < 0.4:
            steps.append((None, False, rng.choice(["one", "optional"]), False, None, "v"))
        else:
            texts = None if rng.random() < 0.2 else set(rng.sample("ab(){", rng.randrange(0, 4)))
            if texts is not None and len(texts) == 1 and texts & set("(){}"):
                texts = {"a", "b"}
            bind = "v" if captures and rng.random() < 0.3 else None
            steps.append((texts, rng.random() < 0.3, rng.choice(["one", "one", "optional", "zero_or_more"]), False, bind, None))
    return steps


def compiled(steps):
    out = []
    for texts, negate, quant, delimiter, bind, ref in steps:
        if ref:
            alternatives = ((compile_pred("text.eq_ref", ref, "R"),),)
        elif texts is None:
            alternatives = ((),)
        elif delimiter:
            alternatives = ((compile_pred("text", next(iter(texts)), "R"),),)
        else:
            alternatives = tuple((compile_pred("text", t, "R"),) for t in sorted(texts))
        is_set = texts is not None and not delimiter
        out.append(Step(alternatives, quant, negate, ((bind, "text"),) if bind else (), is_set))
    return tuple(out)


def streams_for(rng, n):
    return {f"f{i:03}": [rng.choice("ab(){}") for _ in range(rng.randrange(1, 12))] for i in range(n)}


@pytest.mark.parametrize("in_scope", [False, True])
def test_window_sequences_equal_search_and_brute_force(spark, in_scope):
    from lexloom.operators.lexemes import links

    rng = random.Random(4)
    streams = streams_for(rng, 130)
    tokens = tuple_tokens(spark, streams).cache()
    for _ in range(8):
        steps = random_steps(rng, captures=False)
        rule = Rule("R", "error", None, None, None, (), (), steps=compiled(steps), in_scope=in_scope)
        want = set()
        for f, s in streams.items():
            partner = links(s)
            regions = [(o + 1, partner[o]) for o in range(len(s)) if s[o] == "{" and partner[o] is not None] if in_scope else [(0, len(s))]
            for low, high in regions:
                want |= {(f, low + p) for p in naive(steps, s[low:high], [None] * (high - low))}
        by_window = {(r["file"], r["pos"]) for r in primary.window_sequences(tokens, 0, rule).collect()}
        by_search = {(r["file"], r["pos"]) for r in search.searched_sequences(tokens, 0, rule).collect()}
        assert by_window == want and by_search == want, steps


def test_search_equals_brute_force():
    """Captures, references and balanced delimiters, without Spark."""
    from lexloom.operators.lexemes import links

    rng = random.Random(9)
    for _ in range(1500):
        steps = random_steps(rng, captures=True)
        region = [rng.choice("ab(){}") for _ in range(rng.randrange(1, 11))]
        partner = links(region)
        matcher = search.Matcher(compiled(steps))
        masks = []
        for text in region:
            mask = 0
            for bits, step in zip(matcher.bits, matcher.steps):
                for bit, preds in zip(bits, step.alternatives):
                    free = [p for p in preds if p.op == "eq"]
                    if all(p.value == text for p in free):
                        mask |= 1 << bit
            masks.append(mask)
        values = {f: region for f in matcher.fields}
        assert matcher.starts(masks, values, partner) == naive(steps, region, partner), (steps, region)


def test_many_tokens_do_not_recurse(spark):
    tokens = tuple_tokens(spark, {"f": ["a", "("] + ["b"] * 5000 + [")"]})
    assert found(tokens, 'sequence { a "(" any * ")" }') == [("f", 0)]


def test_repeats_equal_search(spark):
    rng = random.Random(2)
    tokens = tuple_tokens(spark, {f"f{i}": [rng.choice("abcde{}") for _ in range(12)] for i in range(40)}).cache()
    for scope in ("", "in scope "):
        rule = load_dsl(f"rule R {{ sequence {scope}{{ x:@ident any * :x any * }} }}")[0][0]
        assert search.repeated_later(rule) is not None
        fast = sorted((r["file"], r["pos"], r["open"]) for r in search.sequences(tokens, 0, rule).collect())
        slow = sorted((r["file"], r["pos"], r["open"]) for r in search.searched_sequences(tokens, 0, rule).collect())
        assert fast == slow


IN_BLOCKS = [
    "a not b *", "a b *", "a", "a b", "a any *", "any b", "not a not b *", 'a "{" not b *', '"}" a *', '"{" any a *', "a any * b any *",
    "a any any *", "any any any", 'a not "}" *', "any any * any any * b any *", "a not (a | b) *", "a [] *",
]


@pytest.mark.parametrize("body", IN_BLOCKS)
def test_sequences_in_blocks_equal_search(nested, body):
    """Also the block that finds a start is the outermost of those that do."""
    rule = load_dsl(f"rule R {{ sequence in scope {{ {body} }} }}")[0][0]
    assert primary.gapped(rule.steps) or primary.single_run(rule.steps)
    fast, slow = (sorted((r["file"], r["pos"], r["open"], r["text"]) for r in how(nested, 0, rule).collect()) for how in (search.sequences, search.searched_sequences))
    assert fast == slow


@pytest.fixture(scope="module")
def nested(spark):
    rng = random.Random(12)
    streams = {f"f{i:02}": [rng.choice("ab{{}}x") for _ in range(rng.randrange(0, 26))] for i in range(60)}
    return tuple_tokens(spark, streams | {"deep": ["a", "{"] * 12 + ["b"] + ["}", "a"] * 12}).cache()


def test_deep_blocks_keep_one_row_per_token(spark):
    """A token within 1,000 blocks is dealt to none of them."""
    tokens = tuple_tokens(spark, {"f": ["{"] * 1000 + ["a", "b", "c"] + ["}"] * 1000})
    for body in ("a any * b any *", "a not c *", "a not d *"):
        rule = load_dsl(f"rule R {{ sequence in scope {{ {body} }} }}")[0][0]
        plan = search.sequences(tokens, 0, rule)._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Window") :]
        assert "explode" not in below, plan
    assert found(tokens, "sequence in scope { a any * b any * }") == [("f", 1000)]
    assert found(tokens, "sequence in scope { a not d * }") == [("f", 1000)]
    assert found(tokens, "sequence in scope { a not c * }") == []


def test_no_steps_never_fire(spark):
    assert found(tuple_tokens(spark, {"f": ["a"]}), "sequence { }") == []


def test_sequence_plans_have_one_exchange(spark):
    tokens = tuple_tokens(spark, {"f": ["a"]})
    rule = load_dsl("rule R { sequence { a b ? any * c not d * } }")[0][0]
    plan = primary.window_sequences(tokens, 0, rule)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    # A frame from a token to the end is computed anew for each token.
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_long_files_take_linear_time(spark):
    """120,000 tokens of one file: quadratic frames would take minutes."""
    n = 120_000
    kind = F.when(F.col("id") % 9 == 3, "(").when(F.col("id") % 9 == 7, ")").when(F.col("id") % 5 == 0, "b").otherwise("a")
    names = [f.name for f in TOKENS]
    known = {"file": F.lit("f"), "pos": F.col("id"), "text": kind, "node_kind": kind, "block_path": F.array(F.lit(-1)), "language": F.lit("typescript")}
    known["jmp"] = F.when(F.col("id") % 9 == 3, F.col("id") + 4).when(F.col("id") % 9 == 7, F.col("id") - 4)
    tokens = spark.range(0, n, 1, 1).select(*(known.get(f, F.lit(0)).cast(TOKENS[f].dataType).alias(f) for f in names))
    texts = ["(" if i % 9 == 3 else ")" if i % 9 == 7 else "b" if i % 5 == 0 else "a" for i in range(n)]
    last_b = max(i for i in range(n) if texts[i] == "b")
    assert len(found(tokens, "sequence { b not b * }")) == 1
    assert found(tokens, "sequence { a b not b * }") == ([("f", last_b - 1)] if texts[last_b - 1] == "a" else [])
    pairs = sum(1 for i in range(n) if texts[i] == "(" and i % 9 == 3 and i + 4 < n and "b" in texts[i + 1 : i + 4])
    assert len(found(tokens, 'sequence { "(" any * b any * ")" any * }')) == pairs


CALLS = {
    "a/x.ts": [("d", "symbol", "stop", "f"), ("r", "symbol", "free", "f"), ("d", "symbol", "stop", "g"), ("d", "symbol", "stop", "g")],
    "a-b/x.ts": [("d", "symbol", "free", ""), ("r", "symbol", "stop", "")],
    "c.ts": [("d", "symbol", "free", "f")],
}
BASE = "rule S { match stop } rule F (warning) { match free } "


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("compose intersection of S, F", [("a/x.ts", 1), ("a-b/x.ts", 2)]),
        ("compose intersection of F, S", [("a/x.ts", 2), ("a-b/x.ts", 1)]),
        ("compose intersection of S, F by file, function", [("a/x.ts", 1), ("a-b/x.ts", 2)]),
        ("compose union of S, F", [("a/x.ts", 1), ("a-b/x.ts", 2), ("c.ts", 1)]),
        ("compose union of S, F by function", [("a/x.ts", 1), ("a/x.ts", 3), ("a-b/x.ts", 2)]),
        ("compose difference of F, S", [("c.ts", 1)]),
        ("compose difference of S, F by file, function", [("a/x.ts", 3)]),
        ("compose difference of S, NOWHERE", [("a/x.ts", 1), ("a-b/x.ts", 2)]),
        ("compose intersection of S, NOWHERE", []),
        ("count S per file > 2", [("a/x.ts", 1)]),
        ("count S per function >= 2", [("a/x.ts", 3)]),
        ("count S per function == 1", [("a/x.ts", 1), ("a-b/x.ts", 2)]),
        ("count S per file < 2", [("a-b/x.ts", 2)]),
        ("count S per file <= 0", []),
        ("count NOWHERE per file < 9", []),
        ("count S per file > 2 unless path \"a/*\"", []),
        ("lang rust count S per file > 2", [("a/x.ts", 1)]),
    ],
)
def test_aggregates(spark, body, want):
    rows = check(tuple_tokens(spark, CALLS), BASE + f"rule A {{ {body} }}")
    assert [(r["file"], r["span"]["start_line"]) for r in rows if r["rule_id"] == "A"] == want


def test_aggregates_read_only_surviving_primary_findings(spark):
    tokens = tuple_tokens(spark, CALLS)
    rules = BASE + "rule A { count S per file > 2 } rule B { count A per file > 0 }"
    assert {r["rule_id"] for r in check(tokens, rules)} == {"S", "F", "A"}
    waived = check(tokens, rules, Context(waivers=[("S", "a/x.ts")]))
    assert {(r["rule_id"], r["file"]) for r in waived} == {("F", "a/x.ts"), ("S", "a-b/x.ts"), ("F", "a-b/x.ts"), ("F", "c.ts")}
    assert not [r for r in check(tokens, rules, Context(waivers=[("A", "a/x.ts")])) if r["rule_id"] == "A"]


def test_same_id_pools(spark):
    rules = "rule S { match stop } rule S { match free } rule A { count S per file >= 4 }"
    rows = check(tuple_tokens(spark, CALLS), rules)
    assert [r["file"] for r in rows if r["rule_id"] == "A"] == ["a/x.ts"]


def test_order_and_summary(spark):
    tokens = tuple_tokens(spark, CALLS)
    rows = check(tokens, BASE)
    assert [(r["file"], r["span"]["start_line"]) for r in rows] == [("a/x.ts", 1), ("a/x.ts", 2), ("a/x.ts", 3), ("a/x.ts", 4), ("a-b/x.ts", 1), ("a-b/x.ts", 2), ("c.ts", 1)]
    assert tuple(summary(check_tokens(tokens, load_dsl(BASE)[0])).first()) == (4, 3, 7)


@pytest.mark.parametrize(
    ("guard", "context", "want"),
    [
        ("", Context(waivers=[("R", "a/x.ts")]), 1),
        ("", Context(waivers=[("Q", "a/x.ts")]), 4),
        ("unless waiver Q", Context(waivers=[("Q", "a/x.ts")]), 1),
        ("unless waiver Q", Context(waivers=[("Q", "a-b/x.ts"), ("R", "a/x.ts")]), 0),
        ('unless path "a-*/**"', Context(), 3),
        ('unless adr "t"', Context(adrs=[("t", True)]), 0),
        ('unless adr "t"', Context(adrs=[("t", False), ("u", True)]), 4),
        ('in "a/*" not in "**/y.ts"', Context(), 3),
        ('in "a-b/*" in "c*"', Context(), 1),
        ('not in "a/*"', Context(), 1),
    ],
)
def test_suppression(spark, guard, context, want):
    assert len(found(tuple_tokens(spark, CALLS), f"match stop {guard}", context)) == want


def test_nested_regions_report_once_by_the_outermost(spark):
    tokens = tuple_tokens(spark, {"f": "{ a { b } }".split()})
    rule = load_dsl("rule R { sequence in scope { b any * } }")[0][0]
    assert [(r["pos"], r["open"]) for r in primary.window_sequences(tokens, 0, rule).collect()] == [(3, 0)]


def test_no_rules(spark):
    assert check(tuple_tokens(spark, CALLS), "") == []
    assert check(tuple_tokens(spark, CALLS), "rule A { count X per file > 0 }") == []


# -- expectations over small repositories -----------------------------------

SWITCH = {"apps/s.ts": "export function s(k: string) {\n  switch (k) {\n    case 'a':\n      return 1;\n  }\n}\n", "apps/dbg.ts": "function d() {\n  debugger;\n}\n"}
PREFIX = {"apps/x.ts": 'const pumbaA = 1;\nconst other = 2;\nconst pumbaB = "pumbaC";\n'}
RELATED = {
    "apps/x.ts": "function f() {\n  debugger;\n  return 1;\n}\nfunction g() {\n  debugger;\n  debugger;\n}\n",
    "apps/y.ts": "let v = 1;\nv = v + v;\n",
}


@pytest.mark.parametrize(
    ("files", "rules", "want"),
    [
        (SWITCH, "rule R { match switch }", [("apps/s.ts", 2, "switch")]),
        (SWITCH, "rule R { match /^sw/ }", [("apps/s.ts", 2, "switch")]),
        (PREFIX, "rule R { match @ident & /^pumba/ }", [("apps/x.ts", 1, "pumbaA"), ("apps/x.ts", 3, "pumbaB")]),
        (RELATED, 'rule R { sequence in scope { debugger ";" debugger any * } }', [("apps/x.ts", 6, "debugger")]),
        (RELATED, "rule R { match debugger where scope contains return }", [("apps/x.ts", 2, "debugger")]),
        (RELATED, 'rule R { sequence { n:@ident "=" :n any * } }', [("apps/y.ts", 2, "v")]),
        (RELATED, "rule D { match debugger } rule R { count D per function > 1 }", [("apps/x.ts", 6, "debugger")]),
    ],
)
def test_small_repositories(spark, files, rules, want):
    rows = [r for r in check(source_tokens(spark, files), rules) if r["rule_id"] == "R"]
    assert [(r["file"], r["span"]["start_line"], r["matched"]["text"]) for r in rows] == want


def test_intersection_by_function(spark):
    rules = "rule D { match debugger } rule T { match return } rule R { compose intersection of D, T by function }"
    rows = [r for r in check(source_tokens(spark, RELATED), rules) if r["rule_id"] == "R"]
    assert [r["matched"]["function"] for r in rows] == ["f"]
