"""Rule languages, dialects and the compiler."""

import re
import warnings

import pytest

from lexloom.rules import dsl
from lexloom.rules.ast import RuleError
from lexloom.rules.compile import compile_pred, load_dsl, load_yaml
from lexloom.rules.dialect import glob_regex, java_regex
from lexloom.starter import RULES, YAML


def one(text):
    return load_dsl(text)[0][0]


def preds(rule):
    return [(p.field, p.op, p.source if p.source is not None else p.value) for p in rule.match]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("foo", [("text", "eq", "foo")]),
        ('"=="', [("text", "eq", "==")]),
        ("@ident", [("class", "eq", "ident")]),
        (r"/a\/b/", [("text", "regex", "a/b")]),
        ("^/x/", [("text", "not_regex", "x")]),
        ("@ident & /^a/", [("class", "eq", "ident"), ("text", "regex", "^a")]),
        ("any", []),
        (".", []),
        ('Token[text in ["a", "b"], range_lines > 3]', [("range_lines", "gt", 3.0), ("text", "any", ("a", "b"))]),
        ("Token[]", []),
        ("Token[named = \"true\", text !~ /q/]", [("named", "eq", "true"), ("text", "not_regex", "q")]),
        ("Token[text_len >= -2.5]", [("text_len", "ge", -2.5)]),
        (":x", [("text", "eq_ref", "x")]),
    ],
)
def test_patterns(pattern, want):
    assert preds(one(f"rule R {{ match {pattern} }}")) == want


def test_envelope():
    text = """
    waivers "w" adrs "a"  # dirs
    rule A (warning) { lang TypeScript, go  in "x/**" in "y" not in "z", "q"  desc "d\\"e\\n" message "m"
      unless path "p/*" unless adr "t" match foo where scope contains bar where scope not contains @num
      where scope followed by /re/ unless waiver B }
    rule C { count A per function >= 3 }
    rule D { compose difference of A, C by file, function }
    """
    rules, file = load_dsl(text)
    a, c, d = rules
    assert (file.waivers_dir, file.adr_dir) == ("w", "a")
    assert (a.severity, a.languages, a.description, a.message) == ("warning", ("typescript", "go"), 'd"en', "m")
    assert len(a.include) == 2 and len(a.exclude) == 2 and len(a.unless_path) == 1
    assert (a.unless_adr, a.unless_waiver) == ("t", "B") and [k for k, _ in a.where] == ["contains", "followed_by", "not_contains"]
    assert c.severity == "error" and c.count == ("A", "function", "ge", 3)
    assert d.compose == ("difference", ("A", "C"), ("file", "function"))


def test_steps():
    rule = one('rule R { sequence in scope { x:@ident "(" any * ")" + not foo ? ( a | b & @ident ) * [ c /d/ ] ^ /e/ :x } }')
    assert rule.in_scope
    assert [s.quant for s in rule.steps] == ["one", "one", "zero_or_more", "one", "zero_or_more", "optional", "zero_or_more", "one", "one", "one"]
    assert [s.negate for s in rule.steps] == [False] * 5 + [True, False, False, True, False]
    assert rule.steps[0].bind == (("x", "text"),) and rule.steps[-1].has_refs
    assert [s.delimiter for s in rule.steps] == [False, True, False, True] + [False] * 6
    assert [len(s.alternatives) for s in rule.steps][6:8] == [2, 2]


def test_quirks():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert preds(one("rule R { match /a/ & /b/ }")) == [("text", "regex", "b")]
        rule = one("rule R { match a where scope contains x where scope contains y match b }")
        assert rule.match[0].value == "b" and rule.where[0][1][0].value == "y"
    assert len(seen) == 3
    # A literal before a colon is a label.
    assert one("rule R { sequence { foo :x } }").steps[0].bind == (("foo", "text"),)
    # A step's caret negates the whole conjunction, a match's only the regex.
    assert one("rule R { sequence { ^/a/ & @ident } }").steps[0].negate
    assert preds(one("rule R { match ^/a/ & @ident }")) == [("class", "eq", "ident"), ("text", "not_regex", "a")]
    assert one("rule R { match a unless waiver }").unless_waiver == "R"


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("rule R {\n\n match %}", "line 3"),
        ("rule R { match a", "unexpected end"),
        ("rule R (fatal) { match a }", "unknown severity"),
        ("rule R { lang klingon match a }", "unknown language"),
        ("rule R { match not foo }", "unexpected statement"),
        ("rule R { match a != b }", "unexpected statement"),
        ('rule R { match "a }', "unterminated string"),
        ("rule R { match /a }", "unterminated regex"),
        ("rule R { match a sequence { b } }", "needs one body"),
        ("rule R { desc \"x\" }", "needs one body"),
        ("rule R { count X per line > 1 }", "cannot be counted per"),
        ("rule R { compose xor of A }", "cannot be composed by"),
        ("rule R { compose union of A by line }", "cannot be grouped by"),
        ("rule R { match /(/ }", "invalid regex"),
        ("rule R { match /(?=a)/ }", "look-around"),
        (r"rule R { match /(a)\1/ }", "invalid regex"),
        ("rule R { in \"[a\" match a }", "invalid glob"),
        ("bogus", "line 1"),
        ("rule R { count X per file > 1.5 }", "whole number"),
        ("rule R { match Token[text > \"a\"] }", "expected a number"),
    ],
)
def test_errors(text, message):
    with pytest.raises(RuleError, match=message):
        load_dsl(text)


def test_yaml():
    rules, file = load_yaml("""
waivers_dir: w
rules:
  - id: A
    severity: error
    applies_to: {languages: [go], paths: {include: ["a/**"], exclude: ["b"]}}
    match: {text.any.regex: x, curly_depth.gt: 2, named: true}
    where_scope: {contains: {text: y}}
    unless: {path.matches: ["p"], waiver.exists: {rule: B}, adr.exists: {topic: t}}
  - id: B
    severity: warning
    match_sequence:
      anchor: {within: "ScopeStart..ScopeEnd"}
      steps:
        - {attrs: {class: ident}, bind: {k: node_kind}}
        - {quant: one_or_more, alt: [[{attrs: {text: a}}], [{alt: [[{attrs: {text: b}}], [{attrs: {text: c}}]]}]]}
        - {attrs: {text.ne_ref: k}, negate: true, quant: optional}
  - {id: C, severity: error, compose: {op: union, of: [A, B], key: [function]}}
  - {id: D, severity: error, count: {rule: A, op: le, n: 4}}
""")
    a, b, c, d = rules
    assert file.waivers_dir == "w" and a.languages == ("go",) and (a.unless_waiver, a.unless_adr) == ("B", "t")
    assert preds(a) == [("curly_depth", "gt", 2.0), ("named", "eq", "true"), ("text", "regex", "x")]
    assert b.in_scope and [s.quant for s in b.steps] == ["one", "one", "zero_or_more", "optional"] and len(b.steps[1].alternatives) == 3
    assert c.compose == ("union", ("A", "B"), ("function",)) and d.count == ("A", "file", "le", 4)


@pytest.mark.parametrize(
    "text",
    [
        "rules: [{id: A, match: {text: a}}]",
        "rules: [{id: A, severity: error, match: {text.like: a}}]",
        "rules: [{id: A, severity: error, match: {text.gt: a}}]",
        "rules: [{id: A, severity: error, match: {text: [a]}}]",
        "rules: [{id: A, severity: error, compose: {op: union, of: []}}]",
        "rules: [{id: A, severity: error, match_sequence: {steps: [{quant: many}]}}]",
        "rules: [{id: A, severity: error, match_sequence: {steps: [{alt: [[{}, {}]]}]}}]",
        "rules: [{id: A, severity: error, match_sequence: {steps: []}, where_scope: {contains: {text: a}}}]",
        "rules: [{id: A, severity: error, count: {rule: A, op: near, n: 4}}]",
        "rules: {",
    ],
)
def test_yaml_errors(text):
    with pytest.raises(RuleError):
        load_yaml(text)


def test_starter_packs_agree():
    a, b = load_dsl(RULES)[0], load_yaml(YAML)[0]
    assert [(r.id, r.severity, r.description, r.match) for r in a] == [(r.id, r.severity, r.description, r.match) for r in b]


def test_predicate_values():
    assert compile_pred("text.any", ["a", ["b", 3], True], "R").value == ("a", "b", "3", "true")
    assert compile_pred("named", False, "R").value == "false"


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("^a$", ["a"], ["a\n", "ab"]),
        (r"\w+é", ["xé"], ["é"]),
        ("a.b", ["axb", "a\rb"], ["a\nb"]),
        ("(?P<n_1>x)y", ["xy"], ["x"]),
        ("[^]x]", ["a"], ["]", "x"]),
        ("(?m)^b$", ["a\nb\nc"], ["ab"]),
        (r"\$", ["$"], ["a"]),
        ("[[:alpha:]]z", ["az"], ["1z"]),
        ("(?i)AB", ["ab"], ["a"]),
        ("a{2,3}?", ["aa"], ["a"]),
    ],
)
def test_regexes(spark, pattern, yes, no):
    regex = java_regex(pattern)
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r["t"] for r in rows.filter(rows.t.rlike(regex)).collect()}
    assert got == set(yes)


@pytest.mark.parametrize("bad", ["(?<=a)b", "a++", "(?>a)", r"\k<n>", "(", ")", "[", "*a", "a{3,1}", "x\\", "(?x-u)a"])
def test_refused_regexes(bad):
    with pytest.raises(RuleError):
        java_regex(bad)


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.ts", ["a.ts", "x/a.ts"], ["a.tsx"]),
        ("**/x.ts", ["x.ts", "a/b/x.ts"], ["ax.ts"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "a/"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]),
        ("{a,b*}/?.ts", ["a/x.ts", "bcd/x.ts"], ["c/x.ts"]),
        ("[!a]b[0-9]", ["xb1"], ["ab1", "xbx"]),
        ("a.b", ["a.b"], ["axb"]),
        (r"\*", ["*"], ["a"]),
    ],
)
def test_globs(glob, yes, no):
    regex = re.compile(glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(regex.match(p) for p in yes) and not any(regex.match(p) for p in no)


def test_line_numbers_skip_strings():
    with pytest.raises(RuleError, match="line 2"):
        dsl.parse('rule R { desc "a\nb\nc"\n % }')


@pytest.mark.parametrize("pattern", ["[z-a]", "a**", "a*{2}", "x{2", "x{", "(?P<a>x)(?P<a>y)", r"\p{^}", r"\p{L", "x{3,2}"])
def test_more_refused_regexes(pattern):
    with pytest.raises(RuleError):
        java_regex(pattern)


def test_unknown_property_is_refused_where_java_runs(spark):
    with pytest.raises(RuleError):
        java_regex(r"\p{Nope}")
    for pattern, yes, no in ((r"^\p{Greek}+$", "αβ", "ab"), (r"^\p{^L}$", "1", "a"), (r"^\pL$", "a", "1"), (r"^(?P<a_b>x)(?P<ab>y)$", "xy", "x"), (r"^[\p{Lu}\d]{2,}?$", "A1", "a1")):
        got = spark.createDataFrame([(yes,), (no,)], "t string").selectExpr(f"t rlike r'{java_regex(pattern)}' as r").collect()
        assert [r["r"] for r in got] == [True, False], pattern
