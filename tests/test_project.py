"""Source trees, reports, the command line and streams."""

import json

import pytest

from lexloom import cli, project, report
from lexloom.rules.ast import RuleError
from lexloom.rules.compile import load_dsl
from lexloom.sources import repository

STARTER = """function main() {
  debugger;
  console.log("x");
  if (a == b) {
    // TODO tidy up
  }
}
"""


@pytest.fixture
def tree(tmp_path):
    def write(files):
        for name, text in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return tmp_path

    return write


@pytest.fixture
def run(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)

    def call(*argv):
        code = cli.main([str(a) for a in argv])
        out = capsys.readouterr()
        return code, out.out, out.err

    return call


def names(root):
    return [repository.relative(p, root) for p in repository.discover(root)]


def test_discovery(tree):
    root = tree({
        "a-b/x.ts": "", "a/x.ts": "", "a/_app.tsx": "", ".hidden/y.ts": "", "a/.z.ts": "", "b.py": "", "out/gen.js": "", "keep/out.js": "",
        "a/deep/q.cjs": "", "a/deep/skip.mjs": "", "a/deep/keep.mjs": "", ".ignore": "out/\n*.mjs\n!keep.mjs\n/a/deep/nothing\n", "a/deep/.ignore": "skip.*\n",
    })
    (root / "link.ts").symlink_to(root / "a/x.ts")
    assert names(root) == ["a/_app.tsx", "a/deep/keep.mjs", "a/deep/q.cjs", "a/x.ts", "a-b/x.ts", "keep/out.js"]


def test_gitignore_counts_inside_repositories_only(tree):
    root = tree({"a.ts": "", "b.ts": "", ".gitignore": "b.ts\n"})
    assert names(root) == ["a.ts", "b.ts"]
    (root / ".git/info").mkdir(parents=True)
    assert names(root) == ["a.ts"]
    (root / ".git/info/exclude").write_text("a.*\n")
    assert names(root) == []


def test_context(tree, capsys):
    root = tree({
        ".lexloom/waivers/a.yaml": "rule: R\nfile: x.ts\n", ".lexloom/waivers/b.yml": "rule: R\n", ".lexloom/waivers/c.yaml": "{", ".lexloom/waivers/d.txt": "rule: Q",
        "docs/adr/1.yaml": "topic: t\nstatus: ACCEPTED\n", "docs/adr/2.yaml": "topic: u\nstatus: proposed\n", "docs/adr/3.yaml": "status: accepted\n",
        "w/x.yaml": "rule: S\nfile: y.ts\n",
    })
    context = repository.load_context(root)
    assert context.waivers == [("R", "x.ts")] and context.accepts("t") and not context.accepts("u")
    assert "c.yaml" in capsys.readouterr().err
    assert repository.load_context(root, "w", "missing").waivers == [("S", "y.ts")]


def test_check(tree, run):
    root = tree({"apps/x.ts": STARTER})
    assert run("check", root)[0] == 2
    assert run("init", root) == (0, f"{root}/lexloom.yaml: 5 rules to start with\n", "")
    assert run("init", root)[0] == 2
    code, out, _ = run("check", root)
    assert code == 1 and "4 violation(s): 2 error(s), 2 warning(s)" in out
    assert out.startswith('ERROR NO_DEBUGGER\napps/x.ts:2:3\n\nBreakpoints must not be committed.\n\nMatched:\n  node_kind="debugger" class="symbol" text="debugger" function="main"\n')
    code, out, _ = run("check", root, "--format", "json")
    data = json.loads(out)
    assert data["summary"] == {"errors": 2, "warnings": 2, "total": 4}
    assert [v["rule_id"] for v in data["violations"]] == ["NO_DEBUGGER", "NO_CONSOLE", "NO_LOOSE_EQUALITY", "TODO_NEEDS_ISSUE"]
    assert list(data["violations"][0]) == ["rule_id", "severity", "description", "message", "file", "span", "matched"]
    code, out, _ = run("check", root, "--format", "agent")
    assert "ERROR NO_DEBUGGER at apps/x.ts:2:3\n  matched:" in out and out.endswith("2 error(s), 2 warning(s). Fix the errors above before committing.\n")


def test_exit_codes(tree, run):
    root = tree({"x.ts": "a;", "warn.rules": "rule W (warning) { match a }", "bad.rules": "rule {", "none.rules": "rule N { match zzz }"})
    assert run("check", root, "--rules", root / "warn.rules")[0] == 0
    assert run("check", root, "--rules", root / "bad.rules")[0] == 2
    code, out, _ = run("check", root, "--rules", root / "none.rules", "--format", "agent")
    assert (code, out) == (0, "lexloom: no violations.\n")
    with pytest.raises(SystemExit) as e:
        cli.main(["check", "--format", "xml"])
    assert e.value.code == 2


def test_waiver(tree, run):
    root = tree({"apps/x.ts": STARTER, "r.rules": "rule NO_DEBUGGER { match debugger }"})
    assert run("check", root, "--rules", root / "r.rules")[0] == 1
    tree({".lexloom/waivers/w.yaml": "rule: NO_DEBUGGER\nfile: apps/x.ts\n"})
    assert run("check", root, "--rules", root / "r.rules")[0] == 0


def test_rule_files(tree):
    root = tree({"lexloom.rules": "rule A { match a }"})
    assert project.find_rules(root).endswith(".rules")
    tree({"lexloom.yaml": "rules: []"})
    assert project.find_rules(root).endswith(".yaml")
    with pytest.raises(RuleError):
        project.find_rules(root / "missing")


def test_unreadable_files_are_skipped(tree, run):
    root = tree({"a.ts": b"\xff\xfe", "b.ts": "debugger", "r.rules": "rule R { match debugger }"})
    code, out, err = run("check", root, "--rules", root / "r.rules")
    assert code == 1 and "1 violation(s)" in out and "a.ts" in err


def test_tokens(tree, run):
    root = tree({"x.ts": "f(1)", "y.txt": ""})
    code, out, _ = run("tokens", root / "x.ts")
    data = json.loads(out)
    assert code == 0 and data["language"] == "typescript" and data["file"].endswith("x.ts")
    assert [t["jmp"] for t in data["tokens"]] == [None, 3, None, 1]
    assert list(data["tokens"][0]) == ["node_kind", "class", "text", "function", "named", "span", "curly_depth", "round_depth", "bracket_depth", "jmp"]
    assert run("tokens", root / "y.txt")[0] == 2 and run("tokens", root / "missing.ts")[0] == 2


def test_explain(tree, run, monkeypatch):
    root = tree({"lexloom.rules": 'rule A (warning) { lang go desc "d" message "m" unless path "p" unless adr "t" match @ident & /x/ where scope contains y unless waiver B } '
        "rule S { sequence in scope { n:@ident not a * (b | c) } } rule C { compose union of A, S by function } rule N { count A per file > 2 }"})  # fmt: skip
    monkeypatch.chdir(root)
    out = run("explain-rule", "A")[1]
    for part in ("A [WARNING]", "languages: go", "class = ident & text ~ /x/", "contains: text = y", "B is waived", "'t' is accepted", "glob", "remediation: m"):
        assert part in out
    assert "3 step(s) within a scope" in run("explain-rule", "S")[1] and "any number of times" in run("explain-rule", "S")[1]
    assert "composes (union) A, S keyed by function" in run("explain-rule", "C")[1] and "count > 2" in run("explain-rule", "N")[1]
    assert run("explain-rule", "NOPE")[0] == 2
    assert run("explain-rule", "A", "--plan")[0] == 0


def test_json_leaves_out_what_is_absent():
    row = {"rule_id": "R", "severity": "error", "description": None, "message": None, "file": "f", "span": dict.fromkeys(report.SPAN_FIELDS, 1),
           "matched": {"node_kind": "k", "class": "c", "text": 'a"\n​', "named": True, "function": ""}}
    record = report.as_record(row)
    assert "description" not in record and "function" not in record["matched"]
    assert 'text="a\\"\\n\\u{200b}"' in "".join(report.render([row]))


def test_library(spark, tree):
    root = tree({"x.ts": "debugger; debugger;"})
    p = project.Project(spark, root)
    assert [f.name for f in p.discover()] == ["x.ts"] and len(p.lex_file(root / "x.ts")) == 4 and p.lex_all().count() == 4
    assert p.check(load_dsl("rule R { match debugger }")[0]).count() == 2


def test_stream(spark, tree):
    from lexloom.streaming.checks import check_stream, stream_files

    root = tree({"in/a.ts": "debugger;", "in/b.ts": "ok;"})
    rules = load_dsl("rule R { match debugger } rule C { count R per file > 0 }")[0]
    for _ in range(2):  # the second run finds nothing new
        check_stream(stream_files(spark, f"{root}/in"), rules, f"{root}/out", f"{root}/state").awaitTermination()
        rows = spark.read.parquet(f"{root}/out").collect()
        assert sorted((r["rule_id"], r["file"]) for r in rows) == [("C", "a.ts"), ("R", "a.ts")]


def test_global_excludes(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    tree = tmp_path / "tree"
    (tree / ".git").mkdir(parents=True)
    for name in ("a.ts", "b.gen.ts", "c.gen.ts"):
        (tree / name).write_text("x")
    usual = tmp_path / "home/.config/git"
    usual.mkdir(parents=True)
    (usual / "ignore").write_text("*.gen.ts\n")
    assert [p.name for p in repository.discover(tree)] == ["a.ts"]
    (tree / ".gitignore").write_text("!b.gen.ts\n")
    assert [p.name for p in repository.discover(tree)] == ["a.ts", "b.gen.ts"]
    (tmp_path / "home/.gitconfig").write_text("[user]\n name = x\n[core]\n\texcludesFile = ~/own\n")
    (tmp_path / "home/own").write_text("a.ts\n")
    assert [p.name for p in repository.discover(tree)] == ["b.gen.ts", "c.gen.ts"]


def test_files_of_a_store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("debugger")
    (tmp_path / "src/b.js").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("no code")
    got = {r["file"]: (r["text"], r["error"]) for r in repository.read_store(spark, f"file://{tmp_path}").collect()}
    assert got == {"src/a.ts": ("debugger", None), "src/b.js": (None, "no UTF-8")}
