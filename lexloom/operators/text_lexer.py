"""Lexers for prose, markup and JSON by one pattern each.

The pattern is within the common subset of Java's and Python's regexes, so the
same lexemes come from Spark's built-in functions (positions in the stream
only) and from Python (with offsets, depths and links).
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TEXT_CAP
from .lexemes import Lexeme

#: Comments, strings, numbers, words, and any other single visible character.
PATTERN = r'<!--[\s\S]*?-->|"[^"]*"|[0-9]+(?:\.[0-9]+)?|[\p{L}_][\p{L}\p{N}_]*|[^ \t-\r\p{L}\p{N}_]|[\p{N}]'
_PYTHON = regex.compile(PATTERN)
_BOOLS = ("true", "false")


def token_class(text: Column) -> Column:
    """The class of a lexeme, from its text."""
    return (
        F.when(text.startswith("<!--") & (F.length(text) > 6), "comment")
        .when(text.startswith('"') & (F.length(text) > 1), "str")
        .when(text.rlike("^[0-9]"), "num")
        .when(text.isin(*_BOOLS), "bool")
        .when(text == "null", "null")
        .when(text.rlike(r"^[\p{L}_]"), "ident")
        .otherwise("symbol")
    )


def capped(text: Column) -> Column:
    return F.when(F.char_length(text) > TEXT_CAP, F.concat(F.substring(text, 1, TEXT_CAP), F.lit("…"))).otherwise(text)


def lexemes(text: Column) -> Column:
    """The array of a text's lexemes."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def described(found: DataFrame, *kept: str) -> DataFrame:
    """``kept``, pos, class, text (capped) and text_len of lexemes (pos, _raw)."""
    raw = F.col("_raw")
    return found.select(*kept, "pos", token_class(raw).alias("class"), capped(raw).alias("text"), F.octet_length(raw).cast("long").alias("text_len"))


def light_tokens(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, pos, class, text (capped) and text_len, by built-in functions alone.

    Columns of ``files`` other than the text stay.
    """
    kept = [c for c in files.columns if c != text]
    return described(files.select(*kept, F.posexplode(lexemes(F.col(text))).alias("pos", "_raw")), *kept)


def scan(text: str, language: str) -> list[Lexeme]:
    """The same lexemes with offsets; brackets of each kind count as depth."""
    out = []
    depth = {"{": 0, "(": 0, "[": 0}
    closer = {"}": "{", ")": "(", "]": "["}
    for m in _PYTHON.finditer(text):
        w = m[0]
        if w.startswith("<!--") and len(w) > 6:
            cls = "comment"
        elif w[0] == '"' and len(w) > 1:
            cls = "str"
        elif w[0] in "0123456789":
            cls = "num"
        elif w in _BOOLS:
            cls = "bool"
        elif w == "null":
            cls = "null"
        else:
            cls = "ident" if w[0].isalpha() or w[0] == "_" else "symbol"
        if w in depth:
            depth[w] += 1
        kind = {"ident": "identifier", "num": "number", "str": "string", "comment": "comment"}.get(cls, w)
        out.append(Lexeme(m.start(), m.end(), w, kind, cls, cls != "symbol", "", depth["{"], depth["("], depth["["]))
        if w in closer and depth[closer[w]]:
            depth[closer[w]] -= 1
    return out
