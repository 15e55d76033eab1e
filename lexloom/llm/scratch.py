"""Tables written to the cluster's shared folder, and size-checked broadcasts.

Intermediate results that are read more than once are written as Parquet under
``spark.checkpoint.dir``: that cuts the lineage, and a lost executor costs a
re-read instead of a recomputation.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, and files of a table, where the number of rows is bounded.
FILE_ROWS, LEAST_FILES = 50_000, 12
#: Rows that may be broadcast; callers keep them to about a hundred bytes each.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session may do without the setting: it gets a folder of its
    own, which driver and executors share because they are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexloom-")


#: Runs that begin inside ``temporary``.
_made: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Delete, at the end, the tables of all runs that began inside: what is needed of them must be written elsewhere by then."""
    mark = _made.set([])
    try:
        yield
    finally:
        runs = _made.get()
        _made.reset(mark)
        for run in runs:
            run.keep()


class Scratch:
    """Tables of one run of an operator, each written once and then reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _made.get() is not None:
            _made.get().append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, rows: int | None = None, texts: bool = False) -> DataFrame:
        """Write and reread ``df``; where a bound on its rows is known, not in more files than they fill.

        With ``texts`` the light rows are made from whole texts: they are dealt
        anew, so that the work on the texts keeps the tasks of their scan.
        """
        path = self.path(table)
        if rows is not None:
            files = max(LEAST_FILES, rows // FILE_ROWS)
            df = df.repartition(files) if texts else df.coalesce(files)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        """Delete a table that nothing will read again."""
        where, files = self._at(self.path(table))
        files.delete(where, True)

    def keep(self, *tables: str) -> None:
        """Delete all tables but these."""
        where, files = self._at(self.root)
        if files.exists(where):
            for found in files.listStatus(where):
                if found.getPath().getName() not in tables:
                    files.delete(found.getPath(), True)

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is.

    Without the hint the join shuffles and the planner may split hot keys.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside ``more``, so that no names clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``gone``; nulls equal each other."""
    rows, gone = packed(docs, **keys), small(gone)
    same = [rows[k].eqNullSafe(gone[k]) for k in keys]
    return rows.join(gone, same, "left_anti").select("row.*")


def sampled(rows: DataFrame, key: Column, limit: int, total: int) -> DataFrame:
    """Of ``total`` rows at most ``limit``, those whose ``key``, a hash, is least.

    A bound on the hash leaves few more than ``limit`` rows, so that tasks do not
    each send as many; where it leaves fewer, the sample is the smaller.
    """
    if total > limit:
        bound = -(2**63) + min(2**64 - 1, int(2**64 * (limit + 6 * limit**0.5 + 10) / total))
        rows = rows.filter(key <= F.lit(bound))
    return rows.orderBy(key).limit(limit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
