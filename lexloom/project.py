"""Checks of source trees: the library's front door."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from .operators.lexing import lex_files, lex_text
from .plans.engine import Context, check_tokens, lexed_for
from .rules.ast import Rule, RuleError
from .rules.compile import load_path
from .schema import SPAN_FIELDS, TOKENS
from .sources import datasource, repository

#: Rule files that are looked for, in this order.
RULE_FILES = ("lexloom.yaml", "lexloom.rules")


class Project:
    """A source tree.

    What it lexes stays persisted until ``close``, or until a ``with`` block that
    holds the project ends; results are to be read before.
    """

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self._held: list[DataFrame] = []

    def __enter__(self) -> Project:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Give up what is persisted."""
        while self._held:
            self._held.pop().unpersist()

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def discover(self) -> list[Path]:
        return repository.discover(self.root)

    def lex_file(self, path: str | Path) -> list[tuple]:
        """Token rows of one file, named relative to the root."""
        path = Path(path)
        return lex_text(repository.relative(path, self.root), path.read_bytes().decode())

    def texts(self) -> DataFrame:
        """(file, text) of every file that can be read; others are warned of and skipped."""
        if self.root.is_dir():
            datasource.register(self.spark)
            files = self._hold(self.spark.read.format("sourcetree").load(str(self.root.resolve())))
        else:
            files = self._hold(repository.read_files(self.spark, self.root))
        for row in files.filter("error is not null").select("file", "error").toLocalIterator():
            print(f"warning: {row['file']}: {row['error']}", file=sys.stderr)
        return files.filter("error is null").select("file", "text")

    def lex_all(self) -> DataFrame:
        """Tokens of every file that can be read."""
        return lex_files(self.texts())

    def load_context(self, waivers_dir: str | None = None, adr_dir: str | None = None) -> Context:
        return repository.load_context(self.root, waivers_dir, adr_dir)

    def check(self, rules: list[Rule], context: Context | None = None) -> DataFrame:
        """Violations in report order.

        Tokens are lexed once and shared by all rules; files that no rule applies to are not lexed.
        """
        context = self.load_context() if context is None else context
        return check_tokens(self._hold(lexed_for(self.texts(), rules, context)), rules, context)


def find_rules(root: str | Path, given: str | None = None) -> str:
    """The rule file: the given one, or YAML before the textual form."""
    if given:
        return given
    named = [Path(root) / name for name in RULE_FILES]
    found = next((p for p in named if p.exists()), None)
    if found is None:
        raise RuleError(f"{root} holds none of {', '.join(RULE_FILES)}: write one with `init`, or name a file by --rules")
    return str(found)


def check(spark: SparkSession, root: str | Path, rules: str | None = None, project: Project | None = None) -> DataFrame:
    """Violations of the rules of a source tree.

    Without ``project`` the tokens stay persisted as long as the session.
    """
    compiled, file = load_path(find_rules(root, rules))
    project = project or Project(spark, root)
    return project.check(compiled, project.load_context(file.waivers_dir, file.adr_dir))


def token_record(row: tuple) -> dict:
    """One token as the dump has it."""
    t = dict(zip(TOKENS.fieldNames(), row))
    span = {f: t[f] for f in SPAN_FIELDS}
    first = {f: t[f] for f in ("node_kind", "class", "text", "function", "named")}
    return first | {"span": span} | {f: t[f] for f in ("curly_depth", "round_depth", "bracket_depth", "jmp")}


def tokens(path: str | Path) -> dict:
    """The token dump of one file."""
    path = Path(path)
    rows = lex_text(path.as_posix(), path.read_bytes().decode())
    return {"file": path.as_posix(), "language": rows[0][1], "tokens": [token_record(r) for r in rows]}
