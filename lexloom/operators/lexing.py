"""Files to tokens, and the registry of lexers by file extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import LANGUAGES, TOKENS
from . import text_lexer, tsjs
from .lexemes import Lexeme, token_rows
from .plain import plain_tokens

Lexer = Callable[[str, str], list[Lexeme]]
#: Extensions and their languages; the last two have no lexer of their own.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
}
OTHER_EXTENSIONS = {"go": "go", "py": "python", "rs": "rust"}
#: Extensions whose files hold no elements, where "<" may begin a type.
_PLAIN = ("ts", "mts", "cts")
_LEXERS: dict[str, Lexer] = {ext: tsjs.scan if ext in _PLAIN else tsjs.scan_jsx for ext in EXTENSIONS}
#: Rows from which tokens are sent on, rows of a batch at most, and bytes of the texts that are lexed together.
_BATCH_ROWS, _MOST_ROWS, _PART_BYTES = 20_000, 65_536, 262_144


def register_lexer(extension: str, language: str, lexer: Lexer) -> None:
    """Add a lexer: a function from (text, language) to lexemes, used for files with the extension."""
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language}")
    EXTENSIONS[extension] = language
    _LEXERS[extension] = lexer


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1] if "." in name[1:] else ""


def supports(path: str) -> bool:
    return extension_of(path) in EXTENSIONS


def language_of(path: str) -> str | None:
    """The language of a path, by its extension; None if it has none."""
    ext = extension_of(path)
    return EXTENSIONS.get(ext) or OTHER_EXTENSIONS.get(ext)


def language_column(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for name, language in {**EXTENSIONS, **OTHER_EXTENSIONS}.items():
        out = F.when(ext == name, language).otherwise(out)
    return out


def lex_text(path: str, text: str) -> list[tuple]:
    """Token rows of one file; ValueError if no lexer takes its extension."""
    ext = extension_of(path)
    if ext not in _LEXERS:
        raise ValueError(f"{path}: there is no frontend for files like it")
    return token_rows(path, EXTENSIONS[ext], text, _LEXERS[ext](text, EXTENSIONS[ext]))


def lex_files(
    files: DataFrame,
    lexer: Lexer | None = None,
    language: str | None = None,
    carried: tuple[str, ...] = (),
    columns: tuple[str, ...] | None = None,
    wanted: dict[str, set[str]] | None = None,
) -> DataFrame:
    """Tokens of ``files`` (file, text), each file whole in one task.

    Without ``lexer`` the extension chooses one and other files give no tokens.
    Columns that are ``carried`` are the same for all tokens of a file.  If
    ``columns`` are named, the others are null.  If values of columns are ``wanted``,
    tokens that have none of them are left out; ``needed`` finds both for rules.
    """
    fields = T.StructType([*TOKENS, *(files.schema[c] for c in carried)])
    made = fields if columns is None else T.StructType([f for f in fields if f.name in (*columns, *(wanted or ()), *carried)])
    own = _batch_lexer(to_arrow_schema(fields), lexer, language, carried, to_arrow_schema(made), wanted)

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from own(batch)

    tokens = files.select("file", "text", *carried).mapInArrow(lex, made)
    if columns is None:
        return tokens
    return tokens.select(*(F.col(f.name) if f.name in made.names else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def _batch_lexer(
    schema: pa.Schema,
    lexer: Lexer | None = None,
    language: str | None = None,
    carried: tuple[str, ...] = (),
    made: pa.Schema | None = None,
    wanted: dict[str, set[str]] | None = None,
) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A function from files to their tokens: plain statements many texts at a time, other texts one by one.

    Of the columns of ``schema`` those of ``made`` are sent on, of tokens with ``wanted`` values.
    """
    made = made or schema
    values = {c: pa.array(sorted(v), pa.string()) for c, v in (wanted or {}).items()}
    lexers, languages = dict(_LEXERS), dict(EXTENSIONS)
    scanned = {ext for ext, own in _LEXERS.items() if own in (tsjs.scan, tsjs.scan_jsx)} if lexer is None else set()

    def lex(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files = batch.column("file").to_pylist()
        left = []
        for part in _parts(batch.column("text")):
            own = [i for i in part if extension_of(files[i] or "") in scanned]
            left += sorted({*part} - {*own})
            texts = batch.column("text").take(pa.array(own, pa.int64())).cast(pa.binary()).to_pylist()
            taken, of, columns = plain_tokens([t or b"" for t in texts])
            left += [own[i] for i in range(len(own)) if i not in {*taken.tolist()}]
            if columns:
                if wanted is not None:
                    kept = pa.array(np.flatnonzero(asked_for(columns)))
                    of, columns = of[kept.to_numpy()], {c: v.take(kept) for c, v in columns.items() if c in made.names}
                rows = pa.array(np.array(own, np.int64)[of])
                columns["file"] = batch.column("file").take(rows)
                if "language" in made.names:
                    names = [language or languages.get(extension_of(files[i] or "")) or "javascript" for i in own]
                    columns["language"] = pa.array(names).take(pa.array(of))
                columns |= {c: batch.column(c).take(rows) for c in carried}
                found = pa.record_batch([columns[f.name].cast(f.type) for f in made], schema=made)
                yield from (found.slice(at, _MOST_ROWS) for at in range(0, found.num_rows, _MOST_ROWS))
        for found in one_by_one(batch.take(pa.array(left, pa.int64()))):
            found = found if wanted is None else found.filter(pa.array(asked_for({c: found.column(c) for c in values})))
            yield found.select(made.names)

    def asked_for(columns: dict[str, pa.Array]) -> np.ndarray:
        out = np.zeros(len(next(iter(columns.values()))), bool)
        for c, own in values.items():
            out |= pc.is_in(columns[c], value_set=own).to_numpy(zero_copy_only=False)
        return out

    def one_by_one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        more = zip(*(batch.column(c).to_pylist() for c in carried)) if carried else [()] * batch.num_rows
        for file, text, own_columns in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), more):
            ext = extension_of(file or "")
            own = lexer or lexers.get(ext)
            if own is None or text is None:
                continue
            name = language or languages.get(ext) or "javascript"
            found = token_rows(file, name, text, own(text, name))
            rows += [(*row, *own_columns) for row in found] if carried else found
            if len(rows) >= _BATCH_ROWS:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return lex


def _parts(text: pa.Array) -> Iterator[list[int]]:
    """Rows in parts of about _PART_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) // _PART_BYTES
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(size)) + 1) if len(size) else ():
        yield part.tolist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def lex_prose(files: DataFrame, language: str = "javascript") -> DataFrame:
    """Tokens of prose, markup or JSON, whatever the extension."""
    return lex_files(files, text_lexer.scan, language)


def register_table_function(spark: SparkSession, name: str = "lex") -> None:
    """Make ``SELECT * FROM lex(TABLE(files))`` give the tokens of a relation with the columns file and text.

    As in ``lex_files`` the extension chooses the lexer, each file is lexed whole by
    the task that holds its row, and files without a lexer or a text give no tokens.
    """
    own = _batch_lexer(to_arrow_schema(TOKENS))

    class Lex:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
            for found in own(files.select(["file", "text"])):
                yield pa.Table.from_batches([found])

    spark.udtf.register(name, F.arrow_udtf(Lex, returnType=TOKENS))
