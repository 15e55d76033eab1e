"""Scanners, links, positions and Spark's own tokenisation."""

import pytest

from lexloom.corpora import built_in_tokens
from lexloom.operators import text_lexer, tsjs
from lexloom.operators.lexemes import block_paths, links
from lexloom.operators.lexing import extension_of, language_of, lex_files, lex_prose, lex_text, register_lexer, register_table_function, supports
from lexloom.schema import TOKENS

FIELDS = TOKENS.fieldNames()


def lex(text, path="a.ts"):
    return [dict(zip(FIELDS, row)) for row in lex_text(path, text)]


def texts(text, path="a.ts"):
    return [t["text"] for t in lex(text, path)]


def classes(text, path="a.ts"):
    return {t["text"]: t["class"] for t in lex(text, path)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a/b/c", ["a", "/", "b", "/", "c"]),
        ("x = /a\\/[/]b/gi;", ["x", "=", "/", "a\\/[/]b", "/", "gi", ";"]),
        ("if (x) /re/.test(y)", ["if", "(", "x", ")", "/", "re", "/", ".", "test", "(", "y", ")"]),
        ("(a) / b / c", ["(", "a", ")", "/", "b", "/", "c"]),
        ("`a ${ b + `${c}` } d` + e", ["`a ${ b + `${c}` } d`", "+", "e"]),
        ("`${ {a: '}'} }`", ["`${ {a: '}'} }`"]),
        ("a?.b ?? c?.[0]", ["a", "?.", "b", "??", "c", "?.", "[", "0", "]"]),
        ("x >>>= 1; y => z", ["x", ">>>=", "1", ";", "y", "=>", "z"]),
        ("// c\n/* d\n e */ f", ["// c", "/* d\n e */", "f"]),
        ("'it\\'s' \"q\"", ["'it\\'s'", '"q"']),
        ("0xFF 1_000n .5e-3 07", ["0xFF", "1_000n", ".5e-3", "07"]),
        ("#!/usr/bin/env node\na", ["#!/usr/bin/env node", "a"]),
        ("'open\nb", ["'open", "b"]),
        ("`open ${", ["`open ${"]),
        ("/* open", ["/* open"]),
        ("\\ ` \x00", ["\\", "` \x00"]),
    ],
)
def test_lexemes(text, want):
    assert texts(text) == want


@pytest.mark.parametrize("text", ["}{)(][", "((((", "`${`${", "class {", "function (", "a ? : ; =>", "\\u{", "'", "/", "<", "@", "#", "{a:", "for(;;", "é\ud83d"])
def test_malformed_sources_never_fail(text):
    assert tsjs.scan(text, "typescript") and tsjs.scan(text, "javascript")


def test_empty_source_is_one_leaf():
    rows = lex("")
    assert [(r["class"], r["text"], r["node_kind"]) for r in rows] == [("other", "", "program")]


def test_classes():
    got = classes("""const o = { key: val, short, m() {} }; o.prop = this.x; f(true, null, undefined, 1, "s", `t`); // c
class K extends B { field = 1; #p; get(a) { super.m(); } }""")
    want = {
        "const": "symbol", "o": "ident", "key": "prop", "val": "ident", "short": "prop", "m": "prop", "prop": "prop", "this": "other", "x": "prop",
        "f": "ident", "true": "bool", "null": "null", "undefined": "undefined", "1": "num", '"s"': "str", "`t`": "str", "// c": "comment",
        "K": "other", "B": "ident", "field": "prop", "#p": "other", "get": "prop", "a": "ident", "super": "other", "{": "symbol", "=": "symbol",
    }
    assert {k: got[k] for k in want} == want
    assert classes("class K {}", "a.js")["K"] == "ident"


def test_types():
    got = classes("interface I { name: Foo; run(x: Bar): Baz } type T = A | B; let v: Map<C, D> = new E(); function f<G>(p: H): J { return p as L }")
    for name in ("I", "Foo", "Bar", "Baz", "T", "A", "B", "C", "D", "H", "J", "L"):
        assert got[name] == "other", name
    for name in ("v", "E", "f", "p"):
        assert got[name] == "ident", name
    assert got["name"] == got["run"] == "prop"


def test_patterns_and_labels():
    got = classes("const { a, b: c } = d; outer: for (;;) { break outer; }")
    assert got["a"] == "other" and got["b"] == "prop" and got["c"] == "ident" and got["outer"] == "other"


def test_functions():
    source = "async function f() { const g = function h() { x; }; const k = () => y; }\nclass C { static async m(a) { b; } }\nconst o = { n() { c; } };\nfunction* gen() { z; }\nw;"
    by = {t["text"]: t["function"] for t in lex(source)}
    assert (by["x"], by["y"], by["h"], by["f"]) == ("f", "f", "f", "f")
    assert (by["m"], by["static"], by["b"], by["C"]) == ("m", "m", "m", "")
    assert (by["c"], by["n"], by["z"], by["w"]) == ("n", "n", "gen", "")


def test_depths():
    source = "function f(a) { if (a) { g([1, [2]], a[3], { k: 4 }); } for (;;) { 5; } switch (6) { case 7: 8; } }\nclass C { m() { 9; } }"
    by = {t["text"]: (t["curly_depth"], t["round_depth"], t["bracket_depth"]) for t in lex(source)}
    assert by["1"] == (2, 1, 1) and by["2"] == (2, 1, 2) and by["3"] == (2, 1, 0) and by["4"] == (2, 1, 0)
    assert by["5"] == (2, 0, 0) and by["6"] == (1, 1, 0) and by["8"] == (1, 0, 0) and by["9"] == (2, 0, 0)
    brace = next(t for t in lex("{ a }"))
    assert brace["curly_depth"] == 1


def test_spans_count_bytes():
    rows = lex("é = 'ü';\n  b // x\n")
    assert [(r["start_byte"], r["end_byte"], r["start_line"], r["start_col"], r["end_line"], r["end_col"]) for r in rows] == [
        (0, 2, 1, 1, 1, 3), (3, 4, 1, 4, 1, 5), (5, 9, 1, 6, 1, 10), (9, 10, 1, 10, 1, 11), (13, 14, 2, 3, 2, 4), (15, 19, 2, 5, 2, 9),
    ]


def test_cap():
    row = lex("// " + "é" * 200)[0]
    assert row["text"] == "// " + "é" * 117 + "…" and row["end_byte"] - row["start_byte"] == 403
    assert lex("// " + "x" * 117)[0]["text"].endswith("x")


def test_links():
    assert links("( { ) }".split()) == [None, 3, None, 1]
    assert links("{ ( } ) }".split()) == [4, 3, None, 1, 0]
    assert links("( ] )".split()) == [2, None, 0]
    kinds = "{ a { } } b {".split()
    assert block_paths(kinds, links(kinds)) == [[-1], [-1, 0], [-1, 0], [-1, 0], [-1], [-1], [-1]]
    assert [t["jmp"] for t in lex("f('(') // )")] == [None, 3, None, 1, None]


def test_registry():
    assert supports("x/_app.tsx") and not supports("a.py") and not supports("ts")
    assert [language_of(p) for p in ("a.mts", "b.cjs", "c.py", "d.rs", "e.go", "f.txt")] == ["typescript", "javascript", "python", "rust", "go", None]
    assert extension_of(".ts") == "" and extension_of("a.d.ts") == "ts"
    with pytest.raises(ValueError, match="no frontend"):
        lex_text("a.py", "x")
    with pytest.raises(ValueError, match="unknown language"):
        register_lexer("x", "klingon", text_lexer.scan)


def test_registered_lexer():
    from lexloom.operators import lexing

    register_lexer("go", "go", text_lexer.scan)
    try:
        assert [(r[1], r[5]) for r in lex_text("m.go", "func main")] == [("go", "func"), ("go", "main")]
    finally:
        lexing.EXTENSIONS.pop("go"), lexing._LEXERS.pop("go")


def test_prose_lexers_agree(spark):
    rows = [("a", 'He said "yes" <!-- no\n --> 3.14 x_1 été { "k": null, true }'), ("b", ""), ("c", None), ("d", "é" * 130 + " ²³ 一二 a.b")]
    files = spark.createDataFrame(rows, "file string, text string")
    columns = ["file", "pos", "class", "text"]
    by_spark = sorted(map(tuple, built_in_tokens(files).select(columns).collect()))
    by_python = sorted(map(tuple, lex_prose(files).select(columns).collect()))
    assert by_spark == by_python and len(by_spark) > 20


def pieces(text, file="a.tsx"):
    return [(t["node_kind"], t["class"], t["text"]) for t in rows(text, file)]


def rows(text, file):
    from lexloom.schema import TOKENS

    return [dict(zip(TOKENS.fieldNames(), r)) for r in lex_text(file, text)]


@pytest.mark.parametrize("file", ["a.tsx", "a.jsx", "a.js"])
def test_elements(file):
    got = pieces("const el = <div>it's {x} ok</div>; debugger", file)
    assert [t for _, _, t in got] == ["const", "el", "=", "<", "div", ">", "it's ", "{", "x", "}", " ok", "</", "div", ">", ";", "debugger"]
    assert ("jsx_text", "other", "it's ") in got and got[-1] == ("debugger", "symbol", "debugger") and got[4] == ("identifier", "ident", "div")
    got = pieces('x = <Foo.Bar data-a="it\'s" on={() => f(`a`)} {...p} svg:b/>;\nfoo()', file)
    assert [t for _, _, t in got] == ["x", "=", "<", "Foo", ".", "Bar", "data-a", "=", '"it\'s"', "on", "=", "{", "(", ")", "=>", "f", "(", "`a`", ")", "}", "{", "...", "p", "}", "svg", ":", "b", "/>", ";", "foo", "(", ")"]
    assert [c for _, c, t in got if t in ("Bar", "data-a", "on")] == ["prop", "prop", "prop"]


def test_element_text_holds_quotes_backticks_and_slashes():
    text = "function A() {\n  return (\n    <>\n      don't `stop` // now /* or */ &amp; {/* a note */}\n      <b>1</b> {list.map(i => <li key={i}>{i < 2 ? <i/> : 'it'}</li>)}\n    </>\n  )\n}\ncall()"
    got = rows(text, "a.tsx")
    texts = [t["text"] for t in got]
    assert "don't `stop` // now /* or */ " in [t.lstrip() for t in texts] and "&amp;" in texts and "/* a note */" in texts
    assert [t["function"] for t in got if t["text"] in ("li", "call")] == ["A", "A", ""]
    last = got[-3]
    assert (last["text"], last["curly_depth"], last["start_line"]) == ("call", 0, 9)
    links = {t["pos"]: t["jmp"] for t in got if t["jmp"] is not None}
    assert all(links[j] == i for i, j in links.items()) and len(links) == sum(t["text"] in "(){}[]" for t in got)


def test_what_is_no_element():
    for text in ("if (a < b && c > d) { e() }", "const f = <T,>(x: T) => x; g()", "const f = <T extends U>(x: T) => x; g()", "x = a <b> (c)", "for (i = 0; i <n; i++) {}", "x = <"):
        assert not any(t[0].startswith("jsx") for t in pieces(text)), text
    assert [t for _, _, t in pieces("let x = <Foo>y; z()", "a.ts")] == ["let", "x", "=", "<", "Foo", ">", "y", ";", "z", "(", ")"]
    for text in ("<a", "x = <a b={", "x = <a>{", "x = <a></b></a>}", "x = <a>&</a", "x = <a b='", "return <a><b></a>"):
        pieces(text)  # malformed input never fails


def test_long_type_parameters_keep_the_name():
    many = ", ".join(f"T{i} extends {{ a: Map<string, U{i}> }}" for i in range(120))
    got = rows(f"function long<{many}>(x: T0): T1 {{ inside() }}\nclass C {{ m<{many}>(x) {{ within() }} }}", "a.ts")
    assert {t["text"]: t["function"] for t in got if t["text"] in ("inside", "within", "T119")} == {"inside": "long", "within": "m", "T119": "m"}
    returns = " | ".join(f"Map<string, T{i}[]>" for i in range(20))
    got = rows(f"const f = (a: A): {returns} => {{ return 1 }}", "a.ts")
    assert {t["node_kind"] for t in got if t["text"] == "a"} == {"identifier"} and [t["round_depth"] for t in got if t["text"] == "A"] == [1]


BODY = "{ const x = 1; if (x) foo(y); return a }"


@pytest.mark.parametrize(
    ("before", "behind", "path", "depth"),
    [
        ("const g = (a: number): number => ", "", "a.ts", 1),
        ("xs.map((a): number => ", ")", "a.ts", 1),
        ("const h = async (a: A): Promise<void> => ", "", "a.ts", 1),
        ("const h = async <T,>(a: T): Promise<T> => ", "", "a.tsx", 1),
        ("export default (a: A): JSX.Element => ", "", "a.tsx", 1),
        ("const o = { k: (a): { b: number } => ", " }", "a.ts", 1),
        ("const t = [ (a): a is string => ", " ]", "a.ts", 1),
        ("f(1, (a, { b }: P = {}): [A, B] => ", ")", "a.ts", 1),
        ("const q = (a): ((z: number) => void) => ", "", "a.ts", 1),
        ("const q = (a): (z: number) => void => ", "", "a.ts", 1),
        ("const q = (a): (A | B) => ", "", "a.ts", 1),
        ("function k() { return (a): void => ", " }", "a.ts", 2),
        ("const e = <button onClick={(a): void => ", "}>go</button>", "a.tsx", 1),
        ("const u = p ? (a): T => ", " : null", "a.ts", 1),
        ("class C { m = (a: A): void => ", " }", "a.ts", 2),
        ("const n = (a: () => void): Map<string, () => number> => ", "", "a.ts", 1),
        ("const y = (a): typeof z.q | 'x' | 3 => ", "", "a.ts", 1),
        ("const g = (a: number) => ", "", "a.ts", 1),
    ],
)
def test_bodies_of_arrow_functions(before, behind, path, depth):
    got = lex(before + BODY + behind, path)
    at = next(t["pos"] for t in got if t["text"] == "if")
    inside = {t["text"]: (t["node_kind"], t["class"], t["curly_depth"]) for t in got[at - 5 : at + 12]}
    assert inside["if"] == ("if", "symbol", depth) and inside["return"] == ("return", "symbol", depth)
    assert all(inside[name] == ("identifier", "ident", depth) for name in ("x", "foo", "y", "a"))
    first = next(t for t in got if t["text"] == "a")
    assert (first["node_kind"], first["class"]) == ("identifier", "ident") and first["round_depth"] >= 1
    assert not any(t["class"] == "ident" for t in got if t["text"] in ("A", "B", "T", "P", "Promise", "Map", "JSX"))
    assert {t["function"] for t in got if t["text"] in ("if", "foo")} == {"k" if "function k" in before else ""}


def test_colons_of_conditionals_head_no_arrow():
    got = lex("x ? (a) : b => c; y = c ? (a) : { k: 1 }; const r = c ? (a) : (b): T => { if (1) e() }")
    of = {t["text"]: (t["class"], t["curly_depth"], t["round_depth"]) for t in got}
    assert of["k"] == ("prop", 0, 0) and of["T"] == ("other", 0, 0) and of["if"] == ("symbol", 1, 0) and of["e"] == ("ident", 1, 0)
    assert [t["class"] for t in got if t["text"] == "b"] == ["ident", "ident"]
    members = lex("interface I {\n (a: number): T\n m: (b: B) => c\n}\nlet z = { k: 1 }")
    assert {t["text"]: t["class"] for t in members if t["text"] in ("T", "m", "B", "c", "k")} == {"T": "other", "m": "other", "B": "other", "c": "other", "k": "prop"}


def test_lexers_as_a_table_function(spark):
    register_table_function(spark)
    files = [("a.ts", "const g = (a: number): number => { return a }"), ("b/c.tsx", "x = <b>{y}</b>"), ("d.txt", "no lexer"), ("e.js", ""), ("f.ts", None), (None, "x")]
    df = spark.createDataFrame(files, "file string, text string").repartition(3)
    df.createOrReplaceTempView("some_files")
    got = spark.sql("SELECT * FROM lex(TABLE(some_files))")
    want = lex_files(df)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    by_class = spark.sql("SELECT class, count(*) AS n FROM lex(TABLE(SELECT file, text FROM some_files WHERE file = 'a.ts')) GROUP BY class")
    assert {r["class"]: r["n"] for r in by_class.collect()}["ident"] == 3
