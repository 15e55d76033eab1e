"""Lexing no more than rules need of the tokens."""

import pytest

from lexloom import catalogue, corpora
from lexloom.operators import needed
from lexloom.operators.lexing import lex_files
from lexloom.rules.compile import load_dsl

TABLES = "/root/testdata/sf0.001"


def test_lexing_for_columns_and_values(spark):
    """Plain texts and scanned ones, beside all their tokens."""
    texts = [("a.ts", "function f() { debugger; g(1); }"), ("b.ts", "const x = `a${f({ b: 2 })}`; debugger"), ("c.js", None), ("d.txt", "debugger")]
    files = spark.createDataFrame(texts, "file string, text string")
    part = lex_files(files, columns=("file", "pos", "jmp"), wanted={"text": {"debugger", "f"}, "node_kind": {"{"}})
    whole = lex_files(files)
    assert part.schema == whole.schema
    rows = lambda df: sorted(df.select("file", "pos", "text", "node_kind", "jmp").collect())
    assert rows(part) == rows(whole.filter("text in ('debugger', 'f') or node_kind = '{'")) != []
    assert part.filter("start_byte is not null or block_path is not null or class is not null").count() == 0


def test_what_rules_need():
    rule = lambda body: load_dsl(f"rule R {{ {body} }}")[0]
    assert needed.columns(rule("match debugger"), ["text"]) == ("file", "pos", "text")
    assert needed.columns(rule("lang javascript match Token[text_len > 3, colour = \"x\"]"), []) == ("file", "language", "pos", "start_byte", "end_byte")
    assert {"node_kind", "jmp", "block_path"} <= {*needed.columns(rule("sequence in scope { a any * }"), [])}
    assert needed.wanted(rule("match debugger where scope contains release")) == {"text": {"debugger", "release"}, "node_kind": {"{", "}"}}
    assert needed.wanted(rule("sequence { a any * (b | c) any * }")) == {"text": {"a", "b", "c"}}
    for body in ("match /^a/", "match a where scope contains /b/", "sequence { a not b * }", "sequence { not a any * }", "sequence { a b }"):
        assert needed.wanted(rule(body)) is None, body
    rules, _ = load_dsl("rule A { match a } rule B { match b } rule N { count B per function > 1 }")
    assert [r.id for r in needed.rules_for(rules, ["N"])] == ["B", "N"]
    assert needed.columns(rules, []) == ("file", "pos", "text", "function")


@pytest.mark.parametrize("name", ["s_contains", "s_root", "a_count_eq", "a_union", "a_count_less", "q_nested_dedupe"])
def test_queries_over_code_lex_few_columns(spark, name):
    rules, _ = load_dsl(catalogue.RULES[name][1])
    kept = corpora.code_tokens(spark, TABLES, rules, ("text",)).count()
    assert kept < corpora.code_tokens(spark, TABLES).count() / 3
    plan = catalogue.QUERIES[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "start_byte#" not in plan.split("MapInArrow lex")[1].split("\n")[0]


def test_counting_by_function_moves_findings_once(spark):
    plan = catalogue.QUERIES["a_count_eq"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Exchange hashpartitioning") == 1
