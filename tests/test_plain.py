"""Texts that are lexed many at a time, against the scanner."""

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.operators import lexing, plain, tsjs
from lexloom.operators.lexemes import token_rows
from lexloom.schema import TOKENS

SCHEMA = to_arrow_schema(TOKENS)
PIECES = "{ } ( ) ; , a foo $b _c 0 17 function debugger if while else return f ( ) { }".split()
ODD = "1x 0x1f 1_0 for async class get of type [ ] = . => : ? < / 'a' é true number catch".split() + ["x" * 121, "x" * 120]


def whole(rng, depth=0):
    """Statements whose brackets match."""
    out = []
    for _ in range(rng.randint(0, 4)):
        body = whole(rng, depth + 1) if depth < 5 else ""
        name = rng.choice(["a", "foo", "$b", "o1", "if", "while", "9"])
        out.append(
            rng.choice(
                [f"function {name}({rng.choice(['', 'x', 'x, y'])}) {{ {body} }}", f"{{ {body} }}", f"{name}({rng.randint(0, 99)});", "debugger;", f"if (x) {{ {body} }} else {{ {body} }}",
                 f"return {name};", f"{name}(b)\n{{ {body} }}", f"{name} {{ {body} }}", f"(function a() {{ {body} }})", f"f(a, g() {{ {body} }})", ";", f"a({body})", f"function a\n(b) {body}"]
            )
        )
    return rng.choice([" ", "\n", "\n\t", "\r\n", ""]).join(out)


def texts(seed):
    rng = random.Random(seed)
    out = ["", " \n", "a", "a\n", "{", "}", "function", "function a", "function a(", "function a()", "function a() {}"]
    out += [whole(rng) for _ in range(400)]
    out += [rng.choice([" ", "\n", ""]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    out += [rng.choice([" ", "\n"]).join([*(rng.choice(PIECES) for _ in range(4)), rng.choice(ODD), rng.choice(PIECES)]) for _ in range(200)]
    out += ["{" * 32 + "a" + "}" * 32, "{" * 33 + "a" + "}" * 33]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("ext", ["ts", "js"])
def test_plain_texts_are_lexed_as_by_the_scanner(ext):
    scan = {"ts": tsjs.scan, "js": tsjs.scan_jsx}[ext]
    language = lexing.EXTENSIONS[ext]
    for seed in range(3):
        own = texts(seed)
        files = [f"{i}.{ext}" for i in range(len(own))]
        batch = pa.record_batch([pa.array([*files, "x.ts", "y.txt"]), pa.array([*own, None, "a"])], names=["file", "text"])
        got = {}
        for row in pa.Table.from_batches(list(lexing._batch_lexer(SCHEMA)(batch)), SCHEMA).to_pylist():
            got.setdefault(row["file"], []).append(tuple(row.values()))
        for file, text in zip(files, own):
            assert got[file] == token_rows(file, language, text, scan(text, language)), text
        assert len(got) == len(own)
        assert 100 < len(plain.plain_tokens([t.encode() for t in own])[0]) < len(own)


def test_plain_texts_are_not_scanned(monkeypatch):
    text = "\n".join(f"function o{i}() {{ debugger; {{ release({i}); }} acquire(2); }}" for i in range(2000))
    calls = []
    monkeypatch.setitem(lexing.__dict__, "token_rows", lambda *a: calls.append(a) or token_rows(*a))
    batch = pa.record_batch([pa.array(["a.ts", "b.ts", "c.ts"]), pa.array([text, text + " x = 1", text])], names=["file", "text"])
    found = list(lexing._batch_lexer(SCHEMA)(batch))
    assert [c[0] for c in calls] == ["b.ts"]
    assert sum(b.num_rows for b in found) == 3 * 2000 * 20 + 3 and max(b.num_rows for b in found) <= 65_536 + 40_003
