"""Schemas of the four relations: tokens, violations, waivers and decision records."""

from __future__ import annotations

from pyspark.sql import types as T

LANGUAGES = ("typescript", "javascript", "go", "python", "rust")
SPAN_FIELDS = ("start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col")
MATCHED_FIELDS = ("node_kind", "class", "text", "named", "function")
#: Depths saturate here.
MOST_DEPTH = 65_535
#: Token texts keep so many characters, and an ellipsis where more were cut.
TEXT_CAP = 120

TOKENS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("node_kind", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("named", T.BooleanType()),
        *(T.StructField(f, T.LongType()) for f in SPAN_FIELDS),
        *(T.StructField(f, T.IntegerType()) for f in ("curly_depth", "round_depth", "bracket_depth")),
        T.StructField("jmp", T.IntegerType()),
        # Positions of the enclosing matched "{", the root -1 first, the innermost last.
        T.StructField("block_path", T.ArrayType(T.IntegerType(), False)),
    ]
)
SPAN = T.StructType([T.StructField(f, T.LongType()) for f in SPAN_FIELDS])
MATCHED = T.StructType([T.StructField(f, T.BooleanType() if f == "named" else T.StringType()) for f in MATCHED_FIELDS])
WAIVERS = "rule string, file string"
ADRS = "topic string, accepted boolean"
#: Columns of the result of a check.
VIOLATIONS = ("rule_id", "severity", "description", "message", "file", "span", "matched")


def cap(text: str) -> str:
    return text if len(text) <= TEXT_CAP else text[:TEXT_CAP] + "…"
