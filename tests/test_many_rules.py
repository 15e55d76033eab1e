"""Rules decided per file, and rules for words looked up in a dictionary."""

import random

import pytest

from lexloom.operators import files, literals, primary
from lexloom.plans.engine import Context, check_files, check_tokens, lexed_for, primary_findings
from lexloom.project import Project
from lexloom.rules.compile import load_dsl

from .helpers import source_tokens, tuple_tokens

SOURCES = {f"{folder}/{name}{i}.{ext}": f"function f{i}() {{ debugger; call({i}); call({i % 3}) }}" for folder in ("app", "app/deep", "lib") for name in "ab" for ext in ("ts", "js", "tsx") for i in range(3)}
RULES = """
rule A { lang typescript match debugger }
rule B (warning) { in "app/**" not in "app/deep/*" match @num }
rule C { unless path "lib/*" unless waiver OTHER sequence { call "(" any ")" any * } }
rule D { lang go match debugger }
rule E { match call where scope contains debugger }
rule F { in "lib/**" lang javascript sequence in scope { debugger any * } }
rule G { compose intersection of A, B }
rule H { count E per file > 1 }
rule I { unless adr "done" match debugger }
"""


def rows(df):
    return sorted((r["rule_id"], r["file"], r["span"]["start_byte"], r["severity"]) for r in df.collect())


def context(seed):
    rng = random.Random(seed)
    waivers = [(rng.choice("ABCEFG"), rng.choice(sorted(SOURCES))) for _ in range(30)] + [("OTHER", f) for f in rng.sample(sorted(SOURCES), 5)] + [("C", "nowhere.ts")]
    return Context(waivers=waivers, adrs=[("done", bool(seed % 2))])


@pytest.mark.parametrize("seed", [1, 2])
def test_files_decide_as_tokens_do(spark, seed):
    rules, _ = load_dsl(RULES)
    texts = spark.createDataFrame(sorted(SOURCES.items()), "file string, text string")
    want = rows(check_tokens(source_tokens(spark, SOURCES), rules, context(seed)))
    got = check_files(texts, rules, context(seed))
    assert rows(got) == want and len(want) > 50
    places = [(r["file"].split("/"), r["span"]["start_line"], r["span"]["start_col"], r["rule_id"]) for r in got.collect()]
    assert places == sorted(places)


def test_more_rules_than_one_word_holds(spark):
    text = "\n".join(f'rule R{i} {{ in "*{i % 7}.{"ts" if i % 2 else "js"}" match {"debugger" if i % 3 else "call"} }}' for i in range(150))
    rules, _ = load_dsl(text)
    texts = spark.createDataFrame(sorted(SOURCES.items()), "file string, text string")
    waivers = Context(waivers=[(f"R{i}", "app/a1.ts") for i in range(0, 150, 5)])
    assert rows(check_files(texts, rules, waivers)) == rows(check_tokens(source_tokens(spark, SOURCES), rules, waivers))


def test_files_without_rules_are_not_lexed(spark):
    rules, _ = load_dsl('rule A { in "app/a0.ts" match debugger } rule B { lang go match x }')
    texts = spark.createDataFrame(sorted(SOURCES.items()), "file string, text string")
    tokens = lexed_for(texts, rules)
    assert {r["file"] for r in tokens.select("file").distinct().collect()} == {"app/a0.ts"}
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.rindex("RLIKE")
    none = check_files(texts, load_dsl("rule B { lang go match x }")[0])
    assert none.count() == 0


def test_projects_lex_what_rules_apply_to(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rules, _ = load_dsl(RULES)
    with Project(spark, tmp_path) as project:
        assert rows(project.check(rules, context(2))) == rows(check_tokens(source_tokens(spark, SOURCES), rules, context(2)))


def test_dictionary_of_two_thousand_rules(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2_500)]
    streams = {f"f{i}": [rng.choice(words) for _ in range(60)] for i in range(40)}
    tokens = tuple_tokens(spark, streams)
    bodies = [f'"w{i}"' if i % 3 else f'Token[text in ["w{i}", "w{i + 1}", "w{i}"], start_byte >= {i % 4}]' for i in range(2_000)]
    rules, _ = load_dsl("\n".join(f"rule R{i} {{ match {b} }}" for i, b in enumerate(bodies)) + " rule LONG { match Token[text_len > 0, start_byte = 7] } rule NONE { match Token[text in []] }")
    found = primary_findings(tokens, rules, Context())
    want = []
    for f, stream in streams.items():
        for pos, word in enumerate(stream):
            n = int(word[1:])
            want += [(f"R{n}", f, pos)] if n < 2_000 and n % 3 else []
            want += [(f"R{k}", f, pos) for k in (n, n - 1) if k % 3 == 0 and 0 <= k < 2_000 and pos >= k % 4]
            want += [("LONG", f, pos)] if pos == 7 else []
    assert sorted((r["rule_id"], r["file"], r["emitted"]["pos"]) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "InArrow" not in plan
    looked_up, others = literals.split([(i, r) for i, r in enumerate(rules)])
    assert len(looked_up) == 2_001 and [r.id for _, r in others] == ["LONG"]


def test_dictionary_with_bits(spark):
    text = "\n".join(f'rule R{i} {{ {"lang javascript" if i % 2 else ""} match "{i}" }}' for i in range(20)) + " rule D { match debugger } rule P { match /^ca/ }"
    rules, _ = load_dsl(text)
    texts = spark.createDataFrame(sorted(SOURCES.items()), "file string, text string")
    assert rows(check_files(texts, rules)) == rows(check_tokens(source_tokens(spark, SOURCES), rules))
    assert literals.split(list(enumerate(rules)))[0] and files.decided(lexed_for(texts, rules)) is not None


def test_few_rules_stay_in_one_projection(spark):
    rules, _ = load_dsl('rule A { match "a" } rule B { match "b" }')
    plan = primary.plain_matches(tuple_tokens(spark, {"f": ["a", "b"]}), list(enumerate(rules)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
