"""Small sources and tokens for the tests."""

from lexloom.operators.lexemes import block_paths, links
from lexloom.operators.lexing import lex_files
from lexloom.plans.engine import Context, check_tokens, primary_findings
from lexloom.rules.compile import load_dsl
from lexloom.schema import TOKENS


def source_tokens(spark, files):
    return lex_files(spark.createDataFrame(sorted(files.items()), "file string, text string"))


def tuple_tokens(spark, streams, language="typescript"):
    """Tokens from {file: [(node_kind, class, text, function)]}: one byte each, a line each."""
    rows = []
    for file, stream in streams.items():
        stream = [t if isinstance(t, tuple) else (t, "symbol" if not t.isidentifier() else "ident", t, "") for t in stream]
        kinds = [t[2] for t in stream]
        partner = links(kinds)
        for i, ((kind, cls, text, function), path) in enumerate(zip(stream, block_paths(kinds, partner))):
            rows.append((file, language, i, kind, cls, text, function, True, i, i + 1, i + 1, 1, i + 1, 2, 0, 0, 0, partner[i], path))
    return spark.createDataFrame(rows, TOKENS)


def check(tokens, rules, context=None):
    return check_tokens(tokens, load_dsl(rules)[0], context).collect()


def found(tokens, body, context=None):
    """Positions found by one primary rule, as (file, pos)."""
    out = primary_findings(tokens, load_dsl(f"rule R {{ {body} }}")[0], context or Context())
    return sorted((r["file"], r["emitted"]["pos"]) for r in out.collect()) if out is not None else []
