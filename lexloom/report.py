"""Violations as text for people, for programs and for coding agents."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .schema import MATCHED_FIELDS, SPAN_FIELDS

FORMATS = ("human", "json", "agent")
#: Escapes of quoted text.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def quoted(text: str) -> str:
    out = (_ESCAPES.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text)
    return '"' + "".join(out) + '"'


def _evidence(matched: Any) -> str:
    parts = [f"{f}={quoted(matched[f])}" for f in ("node_kind", "class", "text")]
    if matched["function"]:
        parts.append(f"function={quoted(matched['function'])}")
    return " ".join(parts)


class _Totals:
    """Counts rows that pass through: errors, and everything else."""

    def __init__(self, rows: Iterable[Any]):
        self.rows, self.errors, self.others = rows, 0, 0

    def __iter__(self) -> Iterator[Any]:
        for row in self.rows:
            if row["severity"] == "error":
                self.errors += 1
            else:
                self.others += 1
            yield row


def _place(row: Any) -> str:
    return f"{row['file']}:{row['span']['start_line']}:{row['span']['start_col']}"


def _human(row: Any) -> str:
    out = f"{row['severity'].upper()} {row['rule_id']}\n{_place(row)}\n"
    if row["description"] is not None:
        out += f"\n{row['description']}\n"
    out += f"\nMatched:\n  {_evidence(row['matched'])}\n"
    if row["message"] is not None:
        out += f"\nRemediation:\n  {row['message']}\n"
    return out + "\n"


def _agent(row: Any) -> str:
    out = f"{row['severity'].upper()} {row['rule_id']} at {_place(row)}\n  matched: {_evidence(row['matched'])}\n"
    for name, column in (("why", "description"), ("fix", "message")):
        if row[column] is not None:
            out += f"  {name}: {row[column]}\n"
    return out + "\n"


def _record(row: Any) -> str:
    return "    " + json.dumps(as_record(row), indent=2, ensure_ascii=False).replace("\n", "\n    ")


_PIECES = {"human": _human, "agent": _agent, "json": _record}


def _head(style: str, total: int) -> str:
    return "" if style != "json" else '{\n  "violations": [\n' if total else '{\n  "violations": []'


def _foot(style: str, errors: int, others: int, tool: str) -> str:
    if style == "human":
        return f"{errors + others} violation(s): {errors} error(s), {others} warning(s)\n"
    if style == "agent":
        return f"{tool}: {errors} error(s), {others} warning(s). Fix the errors above before committing.\n" if errors + others else f"{tool}: no violations.\n"
    summary = json.dumps({"errors": errors, "warnings": others, "total": errors + others}, indent=2).replace("\n", "\n  ")
    return ("  ]" if errors + others else "") + ',\n  "summary": ' + summary + "\n}\n"


def as_record(row: Any) -> dict:
    """One violation as JSON has it: absent texts and an empty function are left out."""
    out = {c: row[c] for c in ("rule_id", "severity")}
    out |= {c: row[c] for c in ("description", "message") if row[c] is not None}
    matched = {f: row["matched"][f] for f in MATCHED_FIELDS if f != "function" or row["matched"][f]}
    return out | {"file": row["file"], "span": {f: row["span"][f] for f in SPAN_FIELDS}, "matched": matched}


def render(rows: Iterable[Any], style: str = "human", tool: str = "lexloom") -> Iterator[str]:
    """Pieces of the report on ordered violations."""
    totals, piece, held = _Totals(rows), _PIECES[style], None
    for row in totals:
        if style != "json":
            yield piece(row)
            continue
        yield _head(style, 1) if held is None else held + ",\n"
        held = piece(row)
    if style == "json":
        yield _head(style, 0) if held is None else held + "\n"
    yield _foot(style, totals.errors, totals.others, tool)


def report(violations: DataFrame, style: str = "human") -> Iterator[str]:
    """The same from a DataFrame, partition by partition."""
    return render(violations.toLocalIterator(), style)


def write(violations: DataFrame, path: str, style: str = "human", tool: str = "lexloom") -> tuple[int, int]:
    """Write the report on ordered ``violations`` below ``path``, a folder in any store; returns (errors, others).

    Executors render their parts and write them.  The files, joined in the order of
    their names, are what ``render`` gives; ``_offsets.jsonl`` says where each begins.
    The driver sees one row per part, and no violation.
    """
    piece = _PIECES[style]

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            text = [piece(r).removesuffix("\n") for r in rows]
            yield pa.record_batch([pa.array(text, pa.string()), pa.array([r["severity"] == "error" for r in rows], pa.bool_())], names=["value", "error"])

    place = F.monotonically_increasing_id()
    rows = violations.mapInArrow(rendered, "value string, error boolean").withColumn("place", place).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = rows.agg(F.count_if("error"), F.count_if(~F.col("error")), F.max("place")).first()
        errors, others, last = counts[0], counts[1], counts[2]
        # Every record of a JSON list but the last is followed by a comma.
        value = F.when(F.col("place") != F.lit(last), F.concat("value", F.lit(","))).otherwise(F.col("value")) if style == "json" and last is not None else F.col("value")
        rows.select(value.alias("value")).write.mode("overwrite").text(path)
    finally:
        rows.unpersist()
    _put(violations, f"{path}/{_FIRST}", _head(style, errors + others))
    _put(violations, f"{path}/{_LAST}", _foot(style, errors, others, tool))
    _put(violations, f"{path}/_offsets.jsonl", "".join(json.dumps(x) + "\n" for x in parts(violations, path)))
    return errors, others


#: Names before and behind those of the parts.
_FIRST, _LAST = "head.txt", "tail.txt"


def _store(df: DataFrame, path: str):
    spark = df.sparkSession.sparkContext
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(df: DataFrame, path: str, text: str) -> None:
    where, store = _store(df, path)
    out = store.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def parts(df: DataFrame, path: str) -> list[dict]:
    """(name, offset, bytes) of a written report's files, in order."""
    where, store = _store(df, path)
    found = [(f.getPath().getName(), f.getLen()) for f in store.listStatus(where)]
    out, offset = [], 0
    for name, size in sorted(x for x in found if not x[0].startswith(("_", "."))):
        out.append({"name": name, "offset": offset, "bytes": size})
        offset += size
    return out
