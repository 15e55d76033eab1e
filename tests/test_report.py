"""Reports written in parts, against the report in one piece."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom import report
from lexloom.cli import main
from lexloom.plans.engine import check_tokens
from lexloom.rules.compile import load_dsl

from .helpers import tuple_tokens

PACK = 'rule W (warning) { desc "why" match a } rule E { message "mend\\nit" match "(" } rule Z { match b }'


@pytest.fixture(scope="module")
def violations(spark):
    rng = random.Random(5)
    streams = {f"d{i % 4}/é{i}.ts": [("x", "ident", rng.choice(["a", "b", "(", "é\"\n​"]), rng.choice(["", "f"])) for _ in range(20)] for i in range(30)}
    return check_tokens(tuple_tokens(spark, streams), load_dsl(PACK)[0]).cache()


def joined(folder):
    names = sorted(f.name for f in folder.iterdir() if not f.name.startswith(("_", ".")))
    return b"".join((folder / n).read_bytes() for n in names), names


@pytest.mark.parametrize("style", report.FORMATS)
@pytest.mark.parametrize("keep", ["true", "rule_id = 'Z' and file = 'd0/é0.ts'", "false"])
def test_parts_joined_are_the_report(violations, tmp_path, style, keep):
    df = violations.filter(keep)
    rows = df.collect()
    errors, others = report.write(df, str(tmp_path / "out"), style)
    got, names = joined(tmp_path / "out")
    assert got.decode() == "".join(report.render(rows, style))
    assert (errors, others) == (sum(r["severity"] == "error" for r in rows), sum(r["severity"] != "error" for r in rows))
    offsets = [json.loads(line) for line in (tmp_path / "out" / "_offsets.jsonl").read_text().splitlines()]
    assert [o["name"] for o in offsets] == names and offsets[-1]["offset"] + offsets[-1]["bytes"] == len(got)
    if style == "json":
        assert len(json.loads(got)["violations"]) == len(rows)


def test_many_parts_some_of_them_empty(violations, tmp_path):
    ordered = violations.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(9, "n").sortWithinPartitions("n").drop("n")
    ordered = ordered.filter("file not like 'd1/%'")
    report.write(ordered, str(tmp_path / "out"), "json")
    got, names = joined(tmp_path / "out")
    assert got.decode() == "".join(report.render(ordered.collect(), "json")) and len(names) > 4


def test_command_writes_to_a_folder(spark, tmp_path, capsys):
    (tmp_path / "a.ts").write_text("debugger; call()")
    (tmp_path / "lexloom.rules").write_text("rule D { match debugger }")
    assert main(["check", str(tmp_path), "--format", "agent", "--output", str(tmp_path / "out")]) == 1
    assert joined(tmp_path / "out")[0].decode().startswith("ERROR D at a.ts:1:1") and capsys.readouterr().out == ""
