"""Arrow-batch functions over DataFrames, with bounded batches.

Spark hands a task Arrow batches of thousands of rows.  Texts may be very long,
so work goes through slices that hold about ``CHARS`` characters at most, or
one row where that is longer by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a slice holds, unless a single row has more.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that the texts of each part stay near SLICE_BYTES."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: str | None = None) -> DataFrame:
    """``df.mapInArrow`` with a function that ``make()`` builds once per task.

    With ``text`` the function gets slices bounded by that column's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch, text) if text else [batch]:
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
